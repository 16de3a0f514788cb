"""Exact Jaccard join of word shingle sets with skipping by set relations, down to components.

Two sets of sizes a and b link when common / joint is a fraction p/q or more, that is when they have at least
p(a + b)/(p + q) in common. Everything is counted in integers.

1. *Who may have a partner.* In the order of shingle hashes, partners share at least ``Rule.needed`` of their first
   ``Rule.first`` shingles. Those first shingles are packed into arrays, shuffled by ranges of hashes, and each batch of
   texts learns how many of each text's some other text has. A key that several texts of one batch have is sent once, so
   a frequent shingle costs one entry a batch. A key is sent as 32 bits besides its range, and its text by its place in
   the batch: keys that meet by chance let a text too many through, never one too few. Texts with too few shared ones
   are done.
2. The same over whole sets of what is left: p/q of a set must be in other sets. These sets are made of the texts once
   more and not written; only those that are left after it are.
3. *Blocks.* Partners differ in so few shingles that, with the hashes cut into a few more ranges than that, they agree
   in all of a range that is not empty. Sets that do are candidates; common passages alone seldom fill a range. A set
   with too many empty ranges is also a candidate by its first shingles. Components of candidates are dealt to blocks
   of about ``BLOCK`` shingles. A component that is larger gets several blocks, each with the same few hubs, so that
   what is near a hub is joined at once; what is left outside a component's largest part meets all its blocks.
4. *Within a block*, inverted lists hold each shingle's sets by position, in short runs with the bounds of their sizes
   and positions; a run is skipped when no set of it can reach the overlap from there. Only leaders search the lists,
   with a slack; the answers of sets that differ from a leader in no more than that slack are derived from the leader's
   overlaps by the lists of the few shingles in which they differ.

Hashes have 64 bits: different texts of equal hashes would be taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables
from .components import components
from .segments import Memo

SEED = 42
#: Shingles of a block, and hashes of a packed batch and range.
BLOCK = 1 << 20
#: Entries of a run of an inverted list.
RUN = 32
#: Sets that each block of a large component has besides its own.
HUBS = 4
#: Rows of two hashes, 16 bytes, up to which a table of them is broadcast.
SENT = 4_000_000
#: Bytes of a text whose words are held at once.
TEXT_BLOCK = 1 << 20
#: Capitals of ASCII in lower case and its white space as blanks.
_PLAIN = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Rule(NamedTuple):
    """Shingles of ``size`` words, linked at a similarity of ``p/q`` or more."""

    size: int = 4
    p: int = 17
    q: int = 20

    def least_common(self, n: int) -> int:
        """What a set of ``n`` has at least in common with any partner."""
        return -(-self.p * n // self.q)

    def prefix(self, n: int) -> int:
        """So many first shingles, in any order common to all, hold one of any partner's."""
        return n - self.least_common(n) + 1

    def first(self, n: int) -> int:
        """How many first shingles of a set of ``n`` are compared in step 1."""
        return min(n, self.prefix(n) + self.prefix(n) // 4)

    def needed(self, n: str = "n") -> str:
        """How many of them some partner shares, in SQL: a partner has at least p/q of the size, and of the first
        shingles of both, one more than what the smaller set's first ones go beyond its prefix is common."""
        least = f"(({self.p} * {n} + {self.q - 1}) div {self.q})"
        return f"({least} - ({self.p} * {least} + {self.q - 1}) div {self.q} + 1) div 4 + 1"

    def near(self, common: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
        return (self.p + self.q) * common >= self.p * (n + others)


def word_hashes() -> Memo:
    """Hashes of words that recur; a task has its own and drops it at its end."""
    return Memo(lambda word: xxhash.xxh64_intdigest(word, SEED), 1 << 17)


def shingles(text: str | None, size: int, known: Memo | None = None) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words (split at ASCII white space, A-Z lower-cased), ascending. Fewer
    words are one shingle; no words, none."""
    plain, at, parts, known = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN), 0, [], word_hashes() if known is None else known
    while at < len(plain):
        end = plain.find(b" ", at + TEXT_BLOCK) if len(plain) - at > TEXT_BLOCK else -1
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    size = min(size, len(hashes))
    if not size:
        return hashes
    joint = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        joint = joint * _FACTOR + hashes[i : len(hashes) - size + 1 + i]
    joint ^= joint >> np.uint64(29)
    joint *= _MIX
    joint ^= joint >> np.uint64(32)
    return np.unique(joint)


def _lists(values: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(kind.to_pandas_dtype()), kind))


def signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows with their ``text`` replaced by ``node``, ``n`` and ``keys``: the hash of the text's set, its size and its
    first shingles. Texts without words share a node."""
    others = [c for c in docs.columns if c != "text"]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            sets = [shingles(t.as_py(), rule.size, known) for t in batch.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = _lists([s[: rule.first(len(s))] for s in sets])
            columns = [*(batch.column(c) for c in others), pa.array(nodes), pa.array(sizes), keys]
            yield pa.RecordBatch.from_arrays(columns, [*others, "node", "n", "keys"])

    kept = T.StructType([docs.schema[c] for c in others]).add("node", T.LongType()).add("n", T.LongType()).add("keys", T.ArrayType(T.LongType()))
    return docs.mapInArrow(sign, kept)


def _signer(rule: Rule):
    """Rows ``(text)`` -> ``(node, n, hashes)``."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            sets = [shingles(t.as_py(), rule.size, known) for t in batch.column("text")]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["node", "n", "hashes"])

    return sign


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs(text)`` -> ``(node, n, hashes)``."""
    return docs.select("text").mapInArrow(_signer(rule), "node long, n long, hashes array<long>")


_PACKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("keys", "owners", "told")), ("rows", pa.list_(pa.int64()))])


def _place(mixed: np.ndarray, parts: int) -> np.ndarray:
    """The range, of ``parts``, of hashes that a multiplication has mixed."""
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(parts: int, rule: Rule | None = None):
    """Rows ``(row, keys)`` -> entries by ranges of keys, each key once a batch. A batch is named by its first row; one of
    its entries tells its rows and how many keys of each the batch itself has twice. With a rule, rows ``(text)``: their
    nodes and whole sets, made here, as a second Python worker beside this one would take as much memory again."""

    def flush(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        lists, rows = table["keys"].combine_chunks(), table["row"].to_numpy()
        keys, owners = lists.flatten().to_numpy(), np.repeat(np.arange(len(rows), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(keys)))
        told = np.bincount(owners[np.repeat(counts > 1, counts)], minlength=len(rows)).astype(np.int32)
        mixed, owner = keys[starts].view(np.uint64) * _FACTOR, np.where(counts > 1, np.int32(-1), owners[starts])
        place = _place(mixed, parts)
        order = np.argsort(place, kind="stable")
        used, at = np.unique(place[order], return_index=True)
        columns = [np.split(x[order], at[1:]) if len(used) else [] for x in (mixed.astype(np.uint32).view(np.int32), owner)]
        teller = _place(rows[:1].view(np.uint64) * _FACTOR, len(used))
        columns += [[x if i in teller else x[:0] for i in range(len(used))] for x in (told, rows)]
        batch = np.full(len(used), rows[0], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(batch), *(_lists(x, t.type.value_type) for x, t in zip(columns, list(_PACKED)[2:], strict=True))], schema=_PACKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches if rule is None else _signer(rule)(batches):
            if batch.num_rows:
                batch = batch if rule is None else batch.select(["node", "hashes"]).rename_columns(["row", "keys"])
                waiting.append(batch)
                size += len(batch.column("keys").flatten())
            if size >= BLOCK:
                yield flush(waiting)
                waiting, size = [], 0
        if waiting:
            yield flush(waiting)

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Of one range of keys: of each batch, how many keys of each of its rows others have too."""
    lists = group["keys"].combine_chunks()
    keys, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    owners, counts = [], []
    for mark, own in zip(*(np.split(x, ends[:-1]) for x in (shared, group["owners"].combine_chunks().flatten().to_numpy())), strict=True):
        found, n = np.unique(own[mark & (own >= 0)], return_counts=True)
        owners.append(found)
        counts.append(n.astype(np.int32))
    return pa.table({"batch": group["batch"], "owners": _lists(owners, pa.int32()), "counts": _lists(counts, pa.int32()), "told": group["told"], "rows": group["rows"]})


def _add(group: pa.Table) -> pa.Table:
    """The counts of a batch's rows over all ranges."""
    owners, counts, told, rows = (group[c].combine_chunks().flatten().to_numpy() for c in ("owners", "counts", "told", "rows"))
    shared = told + np.bincount(owners, counts, len(rows)).astype(np.int64)
    return pa.table({"row": pa.array(rows[shared > 0], pa.int64()), "shared": pa.array(shared[shared > 0], pa.int64())})


def _shared(rows: DataFrame, total: int, rule: Rule | None = None) -> DataFrame:
    """``rows(row, keys)``, or with a rule ``rows(text)``, each row once, with ``total`` keys -> ``(row, shared)``: how
    many keys of a row some other row has, or a few more; rows without any are left out."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK))
    told = "told array<int>, rows array<long>"
    given = rows.select("row", "keys") if rule is None else rows.select("text")
    met = given.mapInArrow(_pack(parts, rule), f"part int, batch long, keys array<int>, owners array<int>, {told}")
    met = met.groupBy("part").applyInArrow(_meet, f"batch long, owners array<int>, counts array<int>, {told}")
    return met.groupBy("batch").applyInArrow(_add, "row long, shared long")


class Block:
    """Sets of a block with inverted lists by position; ``roots`` are the components of its links."""

    def __init__(self, sets: list[np.ndarray], rule: Rule) -> None:
        self.rule = rule
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.n = np.array([len(sets[i]) for i in self.order], np.int64)
        self.ends = np.cumsum(self.n)
        flat = np.concatenate([sets[i] for i in self.order]) if sets else np.zeros(0, np.int64)
        _, codes, df = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        owner = np.repeat(np.arange(len(self.n)), self.n)
        self.codes = rank[codes][np.lexsort((rank[codes], owner))]  # each set's shingles, rare ones first
        where = np.arange(len(owner)) - np.repeat(self.ends - self.n, self.n)
        by = np.lexsort((where, self.codes))
        self.sets, self.places = owner[by], where[by]
        self.heads = np.searchsorted(self.codes[by], np.arange(len(df) + 1))
        # runs of each list: where they start, their least position, their least and greatest size
        sizes = np.diff(self.heads)
        self.run_heads = np.concatenate(([0], np.cumsum(-(-sizes // RUN))))
        inside = np.arange(self.run_heads[-1]) - np.repeat(self.run_heads[:-1], np.diff(self.run_heads))
        self.runs = np.repeat(self.heads[:-1], np.diff(self.run_heads)) + RUN * inside
        self.run_ends = np.minimum(self.runs + RUN, np.repeat(self.heads[1:], np.diff(self.run_heads)))
        if len(self.runs):
            self.run_place = self.places[self.runs]
            self.run_least = np.minimum.reduceat(self.n[self.sets], self.runs)
            self.run_most = np.maximum.reduceat(self.n[self.sets], self.runs)
        self.root = np.arange(len(self.n))
        self.marked = np.zeros(len(df), bool)
        self.searched = self.derived = 0

    def own(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] - self.n[i] : self.ends[i]]

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _link(self, i: int, others: np.ndarray) -> None:
        mine = self._find(i)
        for j in np.unique(self.root[others]).tolist():
            theirs = self._find(j)
            if theirs != mine:
                low, high = min(mine, theirs), max(mine, theirs)
                self.root[high] = low
                mine = low

    def search(self, i: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """What may be a partner of any set that differs from set ``i`` in at most ``slack`` shingles either way, and how
        much each has in common with ``i``."""
        n, mine = int(self.n[i]), self.own(i)
        p, q = self.rule.p, self.rule.q
        first = mine[: n - self.rule.least_common(n - slack) + slack + 1]
        spans = self.run_heads[first + 1] - self.run_heads[first]
        runs = np.arange(int(spans.sum())) + np.repeat(self.run_heads[first] - (np.cumsum(spans) - spans), spans)
        left = n - np.repeat(np.arange(len(first)), spans)  # of set i from this shingle on
        least = self.run_least[runs]
        good = self.rule.near(left + slack, n - slack, least) & self.rule.near(self.run_most[runs] - self.run_place[runs] + slack, n - slack, least)
        good &= (q * self.run_most[runs] >= p * (n - slack)) & (q * (n + slack) >= p * least)
        runs, left = runs[good], left[good]
        sizes = self.run_ends[runs] - self.runs[runs]
        at = np.arange(int(sizes.sum())) + np.repeat(self.runs[runs] - (np.cumsum(sizes) - sizes), sizes)
        z = self.sets[at]
        reach = np.minimum(np.repeat(left, sizes), self.n[z] - self.places[at]) + slack
        z = np.unique(z[self.rule.near(reach, n - slack, self.n[z])])
        self.marked[mine] = True
        sizes = self.n[z]
        at = np.arange(int(sizes.sum())) + np.repeat(self.ends[z] - sizes - (np.cumsum(sizes) - sizes), sizes)
        common = np.add.reduceat(self.marked[self.codes[at]].astype(np.int64), np.cumsum(sizes) - sizes) if len(z) else z
        self.marked[mine] = False
        return z, common

    def _counted(self, shingles_: np.ndarray) -> np.ndarray:
        """How many of some shingles each set has, by their whole lists."""
        sizes = self.heads[shingles_ + 1] - self.heads[shingles_]
        at = np.arange(int(sizes.sum())) + np.repeat(self.heads[shingles_] - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.sets[at], minlength=len(self.n))

    def join(self) -> np.ndarray:
        """The component of each set, as the smallest place of a member, in the order in which sets were given."""
        done = np.zeros(len(self.n), bool)
        for i in range(len(self.n)):
            if done[i]:
                continue
            n = int(self.n[i])
            slack = n // 16
            z, common = self.search(i, slack)
            self.searched += 1
            done[i] = True
            self._link(i, z[self.rule.near(common, n, self.n[z])])
            # the answers of sets that are as near as the slack follow from these
            mine = self.own(i)
            for j in z[(self.n[z] - common <= slack) & (n - common <= slack) & ~done[z]].tolist():
                theirs = self.own(j)
                more, less = (np.setdiff1d(a, b, assume_unique=True) for a, b in ((theirs, mine), (mine, theirs)))
                found = common + self._counted(more)[z] - self._counted(less)[z]
                self._link(j, z[self.rule.near(found, int(self.n[j]), self.n[z])])
                done[j] = True
                self.derived += 1
        out = np.empty(len(self.n), np.int64)
        out[self.order] = [self.order[self._find(i)] for i in range(len(self.n))]
        return out


def _joined(members: DataFrame, sets: DataFrame, rule: Rule, tables: Tables) -> DataFrame:
    """The links of ``members(block, node)``, found block by block: each node to one of its component."""

    def links(group: pa.Table) -> pa.Table:
        lists, nodes = group["hashes"].combine_chunks(), group["node"].to_numpy()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        own = np.split(lists.flatten().to_numpy(), np.cumsum(sizes)[:-1])
        roots = nodes[Block(own, rule).join()]
        linked = roots != nodes
        return pa.table({"a": nodes[linked], "b": roots[linked]})

    members = tables.write(members)
    members = F.broadcast(members) if members.count() <= SENT else members
    dealt = sets.join(members, "node").select("block", "node", "hashes")
    return tables.write(dealt.groupBy("block").applyInArrow(links, "a long, b long"))


@cache
def _classes(rule: Rule) -> list[int]:
    """Least sizes of size classes: partners are in the same or in neighbouring classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(rule.q * out[-1] // rule.p + 1)
    return out


def _range_keys(hashes: np.ndarray, c: int, rule: Rule) -> tuple[np.ndarray, bool]:
    """The keys of a set for pairs whose smaller set has size class ``c``: one for each range of hashes that is not
    empty. And whether so many are empty that a pair of such sets could agree in empty ones only."""
    differ = (rule.q - rule.p) * (_classes(rule)[c + 1] - 1) // rule.p
    if not differ:  # only equal sets are partners
        return hashes[:0], False
    spare = 2 + differ // 16
    parts = differ + 1 + spare
    place = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    sums = np.add.reduceat((hashes ^ hashes >> np.uint64(31)) * _MIX, heads)
    tags = (place[heads].astype(np.uint64) + np.uint64(c + 1 << 40)) * _FACTOR
    keys = (sums ^ tags) * _MIX
    return keys ^ keys >> np.uint64(30), parts - len(heads) > spare


def candidate_keys(hashes: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of which any two partners of different sets share one."""
    own = int(np.searchsorted(_classes(rule), len(hashes), side="right")) - 1
    found = [_range_keys(hashes, c, rule) for c in (own, own - 1) if c >= 0]
    keys = [k for k, _ in found]
    if any(sparse for _, sparse in found):
        keys.append((hashes[: rule.prefix(len(hashes))] * _FACTOR) ^ _MIX)
    return np.unique(np.concatenate(keys))


def _to_least(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: the distinct keys and the least node of each; and links of other nodes to those, without repeats."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    least = np.repeat(nodes[heads], np.diff(np.append(heads, len(keys))))
    pairs = np.unique(np.stack([nodes, least], axis=1)[nodes != least], axis=0)
    return keys[heads], nodes[heads], pairs[:, 0], pairs[:, 1]


_STARS = pa.schema([("part", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("keys", "nodes", "a", "b"))])


def _spread_keys(parts: int, rule: Rule):
    """``(node, hashes)`` -> candidate keys by ranges, each once a batch, with the links that the batch has told."""

    def flush(keys: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(keys).view(np.int64)
        flat, owners, a, b = _to_least(flat, np.repeat(np.array(nodes, np.int64), [len(k) for k in keys]))
        place = _place(flat.view(np.uint64) * _FACTOR, parts)
        order = np.argsort(place, kind="stable")
        used, at = np.unique(place[order], return_index=True)
        shares = np.array_split(np.arange(len(a)), max(1, len(used)))[: len(used)]
        columns = [np.split(x[order], at[1:]) if len(used) else [] for x in (flat, owners)] + [[x[i] for i in shares] for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(_lists, columns)], schema=_STARS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, size = [], [], 0
        for batch in batches:
            lists = batch.column("hashes")
            hashes, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for node, own in zip(batch.column("node").to_pylist(), np.split(hashes, ends[:-1]), strict=True):
                keys.append(candidate_keys(own, rule))
                nodes.append(node)
                size += len(keys[-1])
                if size >= BLOCK:
                    yield flush(keys, nodes)
                    keys, nodes, size = [], [], 0
        if keys:
            yield flush(keys, nodes)

    return run


def _meet_keys(group: pa.Table) -> pa.Table:
    flat = [group[c].combine_chunks().flatten().to_numpy() for c in ("keys", "nodes", "a", "b")]
    _, _, a, b = _to_least(flat[0], flat[1])
    return pa.table({"a": np.concatenate([flat[2], a]), "b": np.concatenate([flat[3], b])})


def _candidates(sets: DataFrame, rule: Rule) -> DataFrame:
    """Links ``(a, b)`` that bring together all sets that share a candidate key."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * BLOCK)))
    kind = "part int, keys array<long>, nodes array<long>, a array<long>, b array<long>"
    dealt = sets.select("node", "hashes").mapInArrow(_spread_keys(parts, rule), kind)
    return dealt.groupBy("part").applyInArrow(_meet_keys, "a long, b long").distinct()


def _components(sets: DataFrame, rule: Rule, tables: Tables) -> DataFrame:
    """``sets(node, n, hashes)`` -> ``(node, root)`` of nodes that have a link."""
    placed = components(_candidates(sets, rule), tables).withColumnRenamed("root", "candidate")
    placed = tables.write(placed.join(sets.select("node", "n"), "node"))
    sized = placed.groupBy("candidate").agg(F.sum("n").alias("total"))
    sized = sized.select("candidate", "total", F.expr(f"cast(if(total > {BLOCK}, ceil(2 * total / {BLOCK}), 0) as bigint)").alias("parts"))
    small = sized.filter("parts = 0").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bins = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * small // BLOCK))
    block = F.expr(f"if(parts = 0, pmod(xxhash64(candidate), {bins}), xxhash64(candidate, pmod(xxhash64(node), parts)))")
    placed = tables.write(placed.join(sized, "candidate").select("node", "n", "candidate", "parts", block.alias("block")))
    large = placed.filter("parts > 0")
    own_hub = large.groupBy("candidate", F.expr(f"pmod(xxhash64(node, 2), {HUBS})").alias("h")).agg(F.min_by("node", F.xxhash64("node")).alias("node"))
    hubs = large.select("candidate", "block").distinct().join(own_hub, "candidate").select("block", "node")
    members = placed.select("block", "node").unionByName(hubs).distinct()
    links = _joined(members, sets, rule, tables)
    found = components(links, tables)
    if large.isEmpty():
        return found
    # large components: what is outside their largest part against all their blocks
    labels = tables.write(large.join(found, "node", "left").select("node", "n", "candidate", "block", F.coalesce("root", "node").alias("root")))
    parts = labels.groupBy("candidate", "root").agg(F.count("*").alias("nodes"))
    main = parts.groupBy("candidate").agg(F.max_by("root", F.struct("nodes", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    outside = labels.join(main, "candidate").filter("root <> main").select("candidate", "node", "n")
    chunks = outside.groupBy("candidate").agg(F.expr(f"cast(ceil(2 * sum(n) / {BLOCK}) as bigint)").alias("chunks"))
    chunked = outside.join(chunks, "candidate").select("candidate", "node", F.expr("pmod(xxhash64(node, 3), chunks)").alias("chunk"))
    blocks = labels.join(main.select("candidate"), "candidate", "left_semi").select("candidate", F.col("block").alias("own")).distinct()
    met = chunked.join(blocks, "candidate").select(F.xxhash64("candidate", "own", "chunk").alias("block"), "node")
    kinds = chunked.select("candidate", "chunk").distinct()
    other = labels.join(kinds, "candidate").select(F.xxhash64("candidate", "block", "chunk").alias("block"), "node")
    more = _joined(met.unionByName(other).distinct(), sets, rule, tables)
    return components(links.unionByName(more), tables)


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes of a row, by which it is found again; nulls count, and entries of a map in any order."""
    parts: list[Column] = []
    for c in docs.columns:
        value = F.array_sort(F.map_entries(c)) if isinstance(docs.schema[c].dataType, T.MapType) else F.col(c)
        parts += [value, value.isNull()]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def _once(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Of ``texts(d1, d2, text)`` those of a written table ``rows(d1, d2, times)``, each once. Only texts of rows that
    repeat are shuffled, up to ``SENT`` rows."""
    found = []
    for repeat in (False, True):
        part = rows.filter("times > 1" if repeat else "times = 1").select("d1", "d2")
        count = part.count()
        if count or not repeat:
            met = texts.join(F.broadcast(part) if count <= SENT else part, ["d1", "d2"], "left_semi")
            found.append(met.dropDuplicates(["d1", "d2"]) if repeat else met)
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def links(base: DataFrame, texts: DataFrame, rule: Rule, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``(node, root)`` of nodes that have a link, from a written table ``base(row, node, n, keys, d1, d2)``, whose rows
    have the hashes ``d1`` and ``d2``, and the ``texts(d1, d2, text)`` that it was made of, which are read again where
    they may have a partner. In place of ``base``, which goes, one without ``keys`` is given beside it."""
    total = base.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    shared = tables.write(_shared(base.filter("n > 0"), total))
    slim = tables.write(base.drop("keys"))
    tables.drop(base)
    rich = slim.join(shared, "row").filter(f"shared >= {rule.needed()}").groupBy("node", "n", "d1", "d2").agg(F.count("*").alias("times"))
    lead = tables.write(rich.groupBy("node").agg(F.min(F.struct("d1", "d2", "times", "n")).alias("lead")).select("node", "lead.*"))
    total = lead.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rich = _shared(_once(texts, lead), total, rule).join(lead.withColumnRenamed("node", "row"), "row").filter(f"{rule.q} * shared >= {rule.p} * n")
    left = tables.write(rich.select("d1", "d2", "times"))
    return slim, _components(tables.write(_sets(_once(texts, left), rule)), rule, tables)


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rule: Rule = Rule(), name: str = "set_join") -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id``, the smallest id that links reach.

    Documents of equal sets are linked and compared once. Those without words, null texts included, are linked with
    nothing. Repeated rows stay rows. A null id stays, with the smallest id of its component (null if that has none).
    No rows give no rows; other columns, whatever their names, are not read. Of a long text 8 bytes a word are held.
    """
    tables = Tables(docs.sparkSession, name)
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    own = own.withColumns(dict(zip(("d1", "d2"), row_hashes(own), strict=True)))
    base = tables.write(signed(own, rule).withColumn("row", F.monotonically_increasing_id()))
    base, found = links(base, own.select("d1", "d2", "text"), rule, tables)
    nodes = base.filter("n > 0").groupBy("node").agg(F.min("id").alias("least")).join(found, "node", "left")
    nodes = tables.write(nodes.select("node", "least", F.coalesce("root", "node").alias("root")))
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    reach = tables.write(nodes.join(least, "root").select("node", "component"))
    joined = base.select("id", "node", "n").join(reach, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
