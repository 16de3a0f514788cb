"""Main text of HTML pages by a tree-structured graphical model.

A page is parsed into its tree of elements and text blocks. Every node is content or not; what a node shows (tag, share
of the page's text, linked text, sentences, place, depth, like siblings, the landmark around it, and hashed words of its
class and id) gives a unary potential, and a potential for each pair of parent and child says how much more likely they
are to agree than not. As the graph is a tree, one pass of messages from the leaves up and one from the root down give
every node's exact marginal (sum-product). Text blocks whose marginal of content is at least one half make the main
text, in page order.

The potentials are trained by gradient ascent on the likelihood of labelled pages, where the expectations come from
the same two passes. Labelled pages are written by ``labelled_pages``, a generator of page layouts whose boilerplate
and article parts are known. No words of the running text are features. No list of names decides: what words of classes
and ids are worth is learned, apart for elements that hold most of the page, and they are averaged over an element's
names, so that one odd class on an article does not outweigh its structure.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_layouts import MARK, labelled_pages

#: Elements without content, elements that show no running text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template textarea title iframe svg select option datalist noframes annotation".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul br xmp".split()
)
#: An open element of the first kind is closed when one of the second begins.
CLOSED_BY = {
    "p": BLOCKS - {"br"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}
#: Elements nest at most this deep, as in browsers; deeper ones become siblings, their text stays.
DEEPEST = 512

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"\s(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
HIDDEN = re.compile(r"\shidden(?=[\s=>/])", re.I)
UNSEEN = re.compile(r"\sstyle\s*=\s*(?:\"[^\"]*|'[^']*|\S*)display\s*:\s*none", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: str = ""  # the values of class, id and role
    text: str = ""  # of text nodes, whose tag is empty
    hidden: bool = False


def parse(page: str | None) -> list[Node]:
    """The nodes of a page in page order, the root first. Comments, markup declarations and elements that show no running
    text are left out; unclosed and misnested elements are closed as browsers do. An element of the first kind that is
    never closed is a lone tag, except for scripts and styles, which end with the page."""
    page = page or ""
    nodes, stack, at, lead = [Node("html", -1)], [0], 0, ""
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()

    def close(depth: int) -> None:
        opened.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:]

    for m in TOKEN.finditer(page):
        start, token = m.start(), m.group()
        if start < at:
            continue  # inside an element that is not read
        if start > at:
            lead = _text(nodes, stack[-1], lead, entities.unescape(page[at:start]))
        at = m.end()
        if token[1] in "!?":
            continue
        name = NAME.match(token).group(1).lower()
        if token[1] == "/":
            if opened[name] <= 0:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == name:
                    close(depth)
                    break
                if name not in BLOCKS and nodes[stack[depth]].tag in BLOCKS:
                    break
            continue
        if name in UNREAD:
            if not token.endswith("/>") and name not in unclosed:
                if (end := _past(page, at, name)) is None:
                    unclosed.add(name)
                at = end or (len(page) if name in ("script", "style") else at)
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(nodes[stack[-1]].tag, ()):
            close(len(stack) - 1)
        if name in BLOCKS and name != "br":  # an open paragraph further out ends, too
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == "p" and name in CLOSED_BY["p"]:
                    close(depth)
                    break
                if nodes[stack[depth]].tag in BLOCKS:
                    break
        names = " ".join(filter(None, (x for a in ATTR.findall(token) for x in a[1:]))) if "=" in token else ""
        nodes.append(Node(name, stack[-1], names, "", nodes[stack[-1]].hidden or _hidden(token, name)))
        if name == "xmp":
            end = _past(page, at, name) or len(page)
            lead = _text(nodes, len(nodes) - 1, lead, re.sub(r"(?i)</xmp[^>]*>\Z", "", page[at:end]))
            at = end
        elif name not in VOID and not token.endswith("/>") and len(stack) < DEEPEST:
            stack.append(len(nodes) - 1)
            opened[name] += 1
    if at < len(page):
        _text(nodes, stack[-1], lead, entities.unescape(page[at:]))
    return nodes


def _hidden(token: str, name: str) -> bool:
    """Whether a tag hides its element, by the attribute or by its style. Pages that hide all until a script has run
    do so at the outermost elements; there it does not count."""
    lower = token.lower()
    if name in ("html", "body", "main", "article") or ("hidden" not in lower and "none" not in lower):
        return False
    return bool(HIDDEN.search(QUOTED.sub("", token)) or UNSEEN.search(token))


def _past(page: str, at: int, name: str) -> int | None:
    """Behind the end tag of an element that is not read (None without one); other elements than text ones may nest."""
    nests, depth = name not in ("script", "style", "title", "textarea", "xmp"), 1
    for m in re.compile(rf"<(/?){re.escape(name)}\b[^>]*>?", re.I).finditer(page, at):
        if m.group(1) or nests:
            depth += -1 if m.group(1) else 1
        if depth == 0:
            return m.end()
    return None


def _text(nodes: list[Node], parent: int, lead: str, text: str) -> str:
    """Adds a text node; white space alone is handed on to the next text instead."""
    if not text.strip():
        return lead + " " if text else lead
    nodes.append(Node("", parent, text=lead + text, hidden=nodes[parent].hidden))
    return ""


#: Tags that are features; 0 is a text, the last number any other tag.
TAGS = (
    "#text html body article main section p h1 h2 h3 h4 blockquote pre figure figcaption table tr td th ul ol li dl dt "
    "dd a div span nav header footer aside form button label details address dialog menu b em strong i code"
).split()
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)} | {"": 0}
OTHER = len(TAGS)
LANDMARKS = {t: i + 1 for i, t in enumerate("article main nav header footer aside form dialog li".split())}
#: Kinds of nodes: text, inline, plain block, container, landmark. Each has pair potentials of its own.
KINDS = 5
_CONTAINERS = frozenset("div section article main td table tbody tr ul ol dl body html center fieldset".split())


def kind(tag: str) -> int:
    if not tag:
        return 0
    if tag not in BLOCKS:
        return 1
    return 4 if tag in ("nav", "header", "footer", "aside", "form") else 3 if tag in _CONTAINERS else 2


#: Features that take one of so many values each; every node has one value of each.
WIDTHS = {
    "tag": OTHER + 1,
    "tag with most of the text": OTHER + 2,
    "tag of the parent": OTHER + 1,
    "length of a text": 7,
    "share of the page": KINDS * 6,
    "linked": KINDS * 5,
    "sentences": KINDS * 4,
    "place": KINDS * 5,
    "depth": 5,
    "like siblings": 3 * 4,
    "landmark around": KINDS * (len(LANDMARKS) + 1),
    "heading": KINDS * 4,
    "in the bulk": KINDS * 3,
}
STARTS = dict(zip(WIDTHS, np.cumsum([0, *WIDTHS.values()])[:-1].tolist(), strict=True))
FEATURES = sum(WIDTHS.values())
#: Buckets of names, once for elements that hold most of the page's text and once for others.
BUCKETS = 1 << 12
STOPS = re.compile(r"[.!?,;:。！？，؟।]")


@lru_cache(maxsize=20_000)
def name_buckets(names: str) -> tuple[np.ndarray, int]:
    """Hash buckets of the names of an element and their count. A name gives itself, its last word with its beginning
    and end, and the words before that, as these say what the last one belongs to."""
    out, found = [], set(names.split())
    for name in sorted(found):
        words = [w.lower() for w in WORD.findall(name)] or [""]
        last = words[-1]
        parts = [f"={name.lower()}", f"l{last}", f"b{last[:4]}", f"e{last[-3:]}", *(f"f{w}" for w in words[:-1])]
        out += [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]
    return np.array(out, np.int64), len(found)


class Forest:
    """Nodes of several pages as arrays, with the nodes of each depth, so that passes go by depths over all pages."""

    def __init__(self, pages: Sequence[list[Node]]) -> None:
        sizes = [len(p) for p in pages]
        first = np.cumsum([0, *sizes])[:-1]
        self.nodes = [x for p in pages for x in p]
        n = len(self.nodes)
        self.root = np.repeat(first, sizes)
        self.parent = np.fromiter((x.parent for x in self.nodes), np.int64, n) + self.root
        self.is_root = np.zeros(n, bool)
        self.is_root[first] = True
        self.parent[first] = first
        self.kinds = np.fromiter((kind(x.tag) for x in self.nodes), np.int64, n)
        self.tags = np.fromiter((TAG_NUMBER.get(x.tag, OTHER) for x in self.nodes), np.int64, n)
        depth = [0] * n
        for i, p in enumerate(self.parent.tolist()):
            if p < i:
                depth[i] = depth[p] + 1
        self.depth = np.array(depth)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if n else []

    def up(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = own.copy()
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.parent[level], out[level])
        return out

    def handed_down(self, own: np.ndarray) -> np.ndarray:
        """The value of the nearest node at or above that has one (not 0)."""
        out = own.copy()
        for level in self.levels[1:]:
            out[level] = np.where(own[level] > 0, own[level], out[self.parent[level]])
        return out


def features(forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node its values of all ``WIDTHS`` as columns of one long vector; of each name bucket of a node, the node,
    the bucket and its share of the node's names."""
    nodes, n = forest.nodes, len(forest.nodes)
    lengths = [len(x.text.strip()) for x in nodes]
    chars = np.array(lengths, np.int64)
    stops = np.fromiter((len(STOPS.findall(x.text)) if size else 0 for x, size in zip(nodes, lengths, strict=True)), np.int64, n)
    tags, kinds, parent, root = forest.tags, forest.kinds, forest.parent, forest.root
    before = np.cumsum(chars) - chars
    link = TAG_NUMBER["a"]
    in_link = forest.handed_down((tags == link).astype(np.int64)) > 0
    total, linked, marks = forest.up(chars), forest.up(np.where(in_link, chars, 0)), forest.up(stops)
    plain = total - linked
    page, page_plain = np.maximum(1, total[root]), np.maximum(1, plain[root])
    big = (2 * plain >= page_plain) & (tags > 0)
    place = (before - before[root] + total / 2) / page
    top = np.isin(tags, [TAG_NUMBER["h1"]])
    tops = forest.up(top.astype(np.int64))
    seen = np.cumsum(top) - top
    heading = np.where(tops[root] == 0, 0, np.where(tops > 0, 1, np.where(seen - seen[root] == 0, 2, 3)))
    # like siblings: same parent, tag and names
    same = np.fromiter((hash((x.tag, x.names)) for x in nodes), np.int64, n)
    keys = (parent * 1_000_003) ^ same
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    alike = np.digitize(count[which], [2, 4, 8])
    share = total / page
    linkage = np.where(total > 0, linked / np.maximum(1, total), 0)
    rate = np.where(total > 0, marks * 100 / np.maximum(1, total), 0)
    marked = np.fromiter((LANDMARKS.get(x.tag, 0) for x in nodes), np.int64, n)
    marked[big & np.isin(tags, [TAG_NUMBER[t] for t in ("form", "dialog", "li")])] = 0  # a form around the page is no part of it
    around = forest.handed_down(marked)[parent]
    # the deepest elements that hold most of the page: below them, one of them, or elsewhere
    bulky = forest.up(big.astype(np.int64))
    core = big & (bulky == 1)
    bulk = np.where(big, 1, np.where(forest.handed_down(core.astype(np.int64)) > 0, 2, 0))
    values = {
        "tag": tags,
        "tag with most of the text": np.where(big, tags + 1, 0),
        "tag of the parent": np.where(forest.is_root, OTHER, tags[parent]),
        "length of a text": np.where(tags > 0, 0, 1 + np.digitize(chars, [15, 40, 90, 180, 400])),
        "share of the page": 6 * kinds + np.digitize(share, [0.01, 0.05, 0.2, 0.5, 0.9]),
        "linked": 5 * kinds + np.digitize(linkage, [0.01, 0.25, 0.6, 0.95]),
        "sentences": 4 * kinds + np.digitize(rate, [0.1, 0.8, 3.0]),
        "place": 5 * kinds + np.digitize(place, [0.05, 0.2, 0.8, 0.95]),
        "depth": np.digitize(forest.depth, [3, 5, 8, 12]),
        "like siblings": 4 * np.digitize(linkage, [0.25, 0.95]) + alike,
        "landmark around": (len(LANDMARKS) + 1) * kinds + around,
        "heading": 4 * kinds + heading,
        "in the bulk": 3 * kinds + bulk,
    }
    columns = np.stack([values[k] + STARTS[k] for k in WIDTHS], axis=1)
    owner, bucket, weight = [], [], []
    for i, x in enumerate(nodes):
        if x.names and x.tag not in ("html", "body"):  # there they tell about the page
            found, names = name_buckets(x.names)
            owner.append(np.full(len(found), i))
            bucket.append(found + BUCKETS * int(big[i]))
            weight.append(np.full(len(found), 1 / names))
    none = np.zeros(0, np.int64)
    return columns, np.concatenate([none, *owner]), np.concatenate([none, *bucket]), np.concatenate([np.zeros(0), *weight])


@dataclass
class Model:
    """``unary``: weights of the features for content; ``names``: of the buckets of names; ``pairs``: log-potentials by
    kind of child for parent's and child's states."""

    unary: np.ndarray
    names: np.ndarray
    pairs: np.ndarray

    def unaries(self, found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        columns, owner, bucket, weight = found
        return self.unary[columns].sum(axis=1) + np.bincount(owner, self.names[bucket] * weight, len(columns))

    def marginals(self, forest: Forest, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node the probability of content, and of each pair (parent's state, child's state)."""
        n = len(unary)
        up, sent = np.zeros((n, 2)), np.zeros((n, 2))
        up[:, 1] = unary
        for level in reversed(forest.levels[1:]):
            sent[level] = np.logaddexp.reduce(self.pairs[forest.kinds[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, forest.parent[level], sent[level])
        joint, belief = np.zeros((n, 2, 2)), up.copy()
        for level in forest.levels[1:]:
            rest = belief[forest.parent[level]] - sent[level]
            cells = rest[:, :, None] + self.pairs[forest.kinds[level]] + up[level][:, None, :]
            whole = np.logaddexp.reduce(cells, axis=(1, 2))
            joint[level] = np.exp(cells - whole[:, None, None])
            belief[level] = np.logaddexp.reduce(cells, axis=1)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def train(pages: list[tuple[str, list[bool]]], steps: int = 220, rate: float = 0.1, decay: float = 2e-4, name_decay: float = 3e-3) -> Model:
    """Maximum likelihood on pages whose nodes are labelled (in the order of ``parse``), by Adam on exact gradients of
    an eighth of the pages a step."""
    model = Model(np.zeros(FEATURES), np.zeros(2 * BUCKETS), np.zeros((KINDS, 2, 2)))
    deals = []
    many = 8 if len(pages) >= 80 else 1
    for k in range(many):
        some = pages[k::many]
        forest = Forest([parse(p) for p, _ in some])
        deals.append((forest, features(forest), np.array([y for _, own in some for y in own], float), len(some)))
    params = [model.unary, model.names, model.pairs]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        forest, found, y, count = deals[t % len(deals)]
        columns, owner, bucket, weight = found
        p, joint = model.marginals(forest, model.unaries(found))
        off = y - p
        unary = np.bincount(columns.ravel(), np.repeat(off, columns.shape[1]), FEATURES)
        names = np.bincount(bucket, off[owner] * weight, 2 * BUCKETS)
        pairs, at = np.zeros((KINDS, 2, 2)), np.flatnonzero(~forest.is_root)
        np.add.at(pairs, (forest.kinds[at], y[forest.parent[at]].astype(int), y[at].astype(int)), 1)
        np.subtract.at(pairs, forest.kinds[at], joint[at])
        grads = [unary / count - decay * params[0], names / count - name_decay * params[1], pairs / count - decay * params[2]]
        slow = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += slow * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
    return model


def labels(nodes: list[Node]) -> list[bool]:
    """Of a generated page: text is content if it bears the mark, an element if any text in it is, and one without
    text if its parent is."""
    good = [MARK in node.text for node in nodes]
    filled = [bool(node.text) for node in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] |= good[i]
        filled[nodes[i].parent] |= filled[i]
    for i in range(1, len(nodes)):
        if not filled[i]:
            good[i] = good[nodes[i].parent]
    return good


@lru_cache(maxsize=4)
def trained(pages: int = 1200, seed: int = 5) -> Model:
    """The model trained on generated layouts; the same arguments give the same model."""
    found = list(labelled_pages(pages, seed))
    return train([(p, labels(parse(p))) for p in found])


def extract(page: str | None, model: Model) -> str:
    """The main text of one page."""
    return next(extract_all([page], model))


def extract_all(pages: Sequence[str | None], model: Model, most: int = 100_000) -> Iterator[str]:
    """The main texts of pages: white space inside a block is one blank, blocks are joined by one. Pages are worked on
    together up to ``most`` nodes."""
    held: list[list[Node]] = []
    size = 0
    for page in pages:
        nodes = parse(page)
        if held and size + len(nodes) > most:
            yield from _texts(held, model)
            held, size = [], 0
        held.append(nodes)
        size += len(nodes)
    yield from _texts(held, model)


def _texts(pages: list[list[Node]], model: Model) -> Iterator[str]:
    if not pages:
        return
    forest = Forest(pages)
    content = (model.marginals(forest, model.unaries(features(forest)))[0] >= 0.5).tolist()
    at = 0
    for nodes in pages:
        yield " ".join("".join(_spaced(nodes, content[at : at + len(nodes)])).split())
        at += len(nodes)


def _spaced(nodes: list[Node], content: list[bool]) -> Iterator[str]:
    """Content with blanks wherever the block changes."""
    block, last = [0] * len(nodes), -1
    for i, node in enumerate(nodes):
        block[i] = i if node.tag in BLOCKS else block[max(0, node.parent)]
        if node.tag in BLOCKS:
            yield " "
        elif not node.tag:
            if block[i] != last:
                yield " "
                last = block[i]
            if content[i] and not node.hidden:
                yield node.text


def main_text(pages: DataFrame, model: Model, html: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``, the main text of every whole page (a column of that name is replaced).

    Null, empty and contentless pages have an empty text. Repeated rows and other columns stay, no rows give no rows.
    Texts that the page hides are no part of it. A page of any length is read whole, in a worker's memory: some 20 times
    its own size.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(found: pd.Series) -> pd.Series:
        return pd.Series(list(extract_all(found, shared.value)), dtype="object")

    return pages.withColumn(out, text(F.col(html)))
