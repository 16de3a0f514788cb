"""Exact ranked lexical search: inner products against ball trees of sparse document vectors.

A document is the sparse vector of its saturated term counts, a query the vector of its term weights; the score is
their inner product, in integers. Each weight is shared by square root between the two sides, so that rare terms shape
the trees. A tree holds ``TREE`` documents of one task; a node knows the centroid c of its documents and two kinds of
radius around it: r, of the whole ball, and for each term the largest excess over c. No document below has more than
c.q + r|q| in common with a query q, nor more than c.q plus the excesses of q's terms; the lesser of the two counts.
The whole ball is wide where vectors are sparse; the excess is nought for terms that no document below has, so texts of
another language or subject go together. Rounding is covered by slack, so a bound is never too low. Each query walks a
tree best-first and leaves what lies below its current k-th best score; leaves are scored in 64-bit integers.

Queries come in blocks of at most ``ITEMS`` queries and about ``TERMS`` distinct terms. Only the terms of a block's
queries are kept of a document, so what is sent to tasks and held by them is bounded whatever the tables' sizes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables

TOP = 50
#: Queries, and their distinct terms, of a block.
ITEMS, TERMS = 512, 8192
#: Documents of a tree and of a leaf.
TREE, LEAF = 2048, 16
#: About so many rows give each query a first k-th best score.
PROBE = 4096
#: Relative slack of computed bounds; the sums of at most 2^13 terms err by less than 1e-12.
SLACK = 1e-9
#: Bytes of a text whose terms are held at once.
BLOCK = 1 << 20
#: Letters of ASCII in lower case, digits and all bytes of other code points stay; the rest separates terms.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time; null has none."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(_KEPT)
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= BLOCK else plain.find(b" ", at + BLOCK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _items(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of queries as ``(id, distinct terms)``."""
    block: list[tuple[object, list[bytes]]] = []
    known: set[bytes] = set()
    for row in items.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator():
        own = {t for terms in term_blocks(row["text"]) for t in terms}
        if block and (len(block) == ITEMS or len(known | own) > TERMS):
            yield block
            block, known = [], set()
        block.append((row["item"], sorted(own)))
        known |= own
    if block:
        yield block


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``docs(doc, text)`` -> ``(doc, n, terms, counts)``: the number of all terms and the counts of those in
    ``vocabulary``."""
    kind = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text"):
                n, found = 0, Counter()
                for words in term_blocks(text.as_py()):
                    n += len(words)
                    found.update(map(vocabulary.get, words))
                found.pop(None, None)
                lengths.append(n)
                terms.append(list(found))
                counts.append(list(found.values()))
            columns = [batch.column("doc"), *(pa.array(x, f.type) for x, f in zip((lengths, terms, counts), list(kind)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return docs.mapInArrow(count, "doc long, n long, terms array<int>, counts array<long>")


class Tree:
    """A ball tree over sparse rows: row i has ``values[ends[i-1]:ends[i]]`` at ``terms`` of the same places."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int) -> None:
        self.ends, self.terms, self.values, self.n_terms = ends, terms, values, n_terms
        self.sizes = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(ends)), self.sizes)
        self.norms = np.bincount(owner, values * values, len(ends))
        self.order = np.arange(len(ends))
        #: Of each node: first and last place in ``order``, children (0: a leaf), radius, centroid, excess by term.
        self.spans: list[tuple[int, int]] = []
        self.below: list[tuple[int, int]] = []
        self.radii: list[float] = []
        self.centroids: list[np.ndarray] = []
        self.excesses: list[np.ndarray] = []
        todo = [(0, len(ends), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            node = len(self.spans)
            if parent >= 0:
                first, _ = self.below[parent]
                self.below[parent] = (first, node) if first else (node, 0)
            self.spans.append((lo, hi))
            self.below.append((0, 0))
            if self._ball(lo, hi):
                middle = (lo + hi) // 2
                todo += [(lo, middle, node), (middle, hi, node)]

    def _ball(self, lo: int, hi: int) -> bool:
        """Centroid and radius of a span; a large one is also ordered so that its halves are apart."""
        rows = self.order[lo:hi]
        sizes = self.sizes[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        places = np.arange(len(owner)) + np.repeat(self.ends[rows] - sizes - (np.cumsum(sizes) - sizes), sizes)
        terms, values, norms = self.terms[places], self.values[places], self.norms[rows]
        centroid = np.bincount(terms, values, self.n_terms) / len(rows)
        near = np.bincount(owner, values * centroid[terms], len(rows))
        far = norms - 2 * near + centroid @ centroid
        slack = SLACK * (norms + 2 * near + centroid @ centroid)
        most = np.zeros(self.n_terms)
        np.maximum.at(most, terms, values)
        self.centroids.append(centroid)
        self.excesses.append(np.maximum(most - centroid, 0))
        self.radii.append(math.sqrt(float(np.max(np.maximum(far, 0) + slack))) * (1 + SLACK))
        if len(rows) <= LEAF:
            return False

        def to(row: int) -> np.ndarray:
            """Inner products with one of the rows."""
            dense = np.zeros(self.n_terms)
            own = slice(self.ends[row] - self.sizes[row], self.ends[row])
            dense[self.terms[own]] = self.values[own]
            return np.bincount(owner, values * dense[terms], len(rows))

        one = int(np.argmax(far))
        to_one = to(rows[one])
        other = int(np.argmax(norms - 2 * to_one))
        side = to(rows[other]) - to_one
        self.order[lo:hi] = rows[np.argsort(side, kind="stable")]
        return True

    def bounds(self, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """At least the inner product of any row below each node (rows) with each query (columns)."""
        reach = np.array(self.radii)[:, None] * lengths[None, :]
        reach = np.minimum(reach, np.array(self.excesses) @ queries)
        return (np.array(self.centroids) @ queries + reach) * (1 + SLACK) + 1


class Search:
    """The best documents of each query of a block so far."""

    def __init__(self, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_all: int, floors: list[int], k: int) -> None:
        self.weights, self.n_docs, self.n_all, self.k = weights, n_docs, n_all, k
        self.terms = [np.array(q, np.int64) for q in queries]
        self.own = [weights[q] for q in self.terms]
        self.sides = np.zeros((len(weights), len(queries)))
        for i, q in enumerate(self.terms):
            self.sides[q, i] = np.sqrt(weights[q])
        self.lengths = np.sqrt([float(w.sum()) for w in self.own]) * (1 + SLACK)
        self.least = [max(1, f) for f in floors]
        none = np.zeros(0, np.int64)
        #: Of each query: scores, ids (the least for null ids) and whether the id is null.
        self.best = [(none, none, none.astype(bool)) for _ in queries]
        self.scored = self.leaves = 0

    def add(self, docs: pa.Table) -> None:
        """The documents ``(doc, n, terms, counts)`` of one tree."""
        lists = docs["terms"].combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        terms = lists.flatten().to_numpy().astype(np.int64)
        counts = docs["counts"].combine_chunks().flatten().to_numpy()
        m = np.array([50 + 50 * n * self.n_docs // max(1, self.n_all) for n in docs["n"].to_pylist()], np.int64)
        sizes = np.diff(ends, prepend=0)
        full = 10**9 * counts // (1000 * counts + 20 * np.repeat(m, sizes))
        tree = Tree(ends, terms, full * np.sqrt(self.weights)[terms], len(self.weights))
        place = np.empty(len(ends), np.int64)
        place[tree.order] = np.arange(len(ends))
        dense = np.zeros((len(self.weights), len(ends)), np.int32)  # below 10^6 each
        dense[terms, np.repeat(place, sizes)] = full
        nulls = np.asarray(docs["doc"].is_null())[tree.order]
        ids = docs["doc"].fill_null(np.iinfo(np.int64).min).to_numpy()[tree.order]
        bounds = tree.bounds(self.sides, self.lengths)
        self.leaves += len(self.terms) * sum(b == (0, 0) for b in tree.below)
        for i in range(len(self.terms)):
            self._walk(i, tree, bounds[:, i].tolist(), dense, ids, nulls)

    def _walk(self, i: int, tree: Tree, bounds: list[float], dense: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if not len(self.terms[i]):
            return
        open_nodes = [(-bounds[0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if -bound < self.least[i]:
                return
            if tree.below[node] != (0, 0):
                for child in tree.below[node]:
                    heapq.heappush(open_nodes, (max(bound, -bounds[child]), child))
                continue
            self.scored += 1
            lo, hi = tree.spans[node]
            scores = self.own[i] @ dense[self.terms[i], lo:hi].astype(np.int64)
            good = np.flatnonzero(scores >= self.least[i])
            if len(good):
                new = (scores[good], ids[lo:hi][good], nulls[lo:hi][good])
                joint = [np.concatenate(pair) for pair in zip(self.best[i], new, strict=True)]
                first = np.lexsort((~joint[2], joint[1], -joint[0]))[: self.k]
                self.best[i] = tuple(x[first] for x in joint)
                if len(first) == self.k:
                    self.least[i] = max(self.least[i], int(self.best[i][0][-1]))


def _search(vectors: DataFrame, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_all: int, floors: list[int], k: int) -> DataFrame:
    """``(item, doc, score)``: of each task, the best documents of each query of the block."""
    kind = pa.schema([("item", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, waiting, rows = Search(queries, weights, n_docs, n_all, floors, k), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                waiting.append(batch.slice(at, TREE))
                rows += waiting[-1].num_rows
                if rows >= TREE:
                    table = pa.Table.from_batches(waiting)
                    search.add(table.slice(0, TREE))
                    waiting, rows = table.slice(TREE).to_batches(), rows - TREE
        if rows:
            search.add(pa.Table.from_batches(waiting))
        for i, (scores, ids, nulls) in enumerate(search.best):
            columns = [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return vectors.filter("size(terms) > 0").select("doc", "n", "terms", "counts").mapInArrow(run, "item int, doc long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank``, up to ``k``; first by task, so that no task gets all candidates of a query."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_first()]
    dealt = found.withColumn("part", F.expr("pmod(xxhash64(doc), 64)"))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(f"rank <= {k}")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(f"rank <= {k}").drop("part")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    name: str = "ball_tree",
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``k`` best documents of each item, those with a score above 0.

    Each row of ``items`` is a query of its own, whether or not its id or text recurs; null and empty texts find
    nothing. Repeated rows of ``docs`` are documents of their own. Ids of documents are integers; equal scores go by
    ascending id, null first. Empty tables give no rows. Other columns, whatever their names, are not read. Texts are
    counted by blocks, so a long text costs its bytes and its distinct terms.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, name)
    item_type, id_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    out = None
    for block in _items(items, item_col, item_text):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        queries = [[vocabulary[t] for t in terms] for _, terms in block]
        vectors = tables.write(_vectors(own, vocabulary))
        total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([weight(total["docs"], df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        args = (queries, weights, total["docs"], total["terms"])
        every = max(1, total["docs"] // PROBE)
        probe = vectors.filter(F.expr(f"pmod(xxhash64(doc, n, terms), {every}) = 0"))
        seen = _first(_search(probe, *args, [0] * len(block), k), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floors = [0] * len(block)
        for row in seen.filter(f"n = {k}").collect():
            floors[row["item"]] = row["least"]
        found = _first(_search(vectors, *args, floors, k), k)
        names = spark.createDataFrame([Row(item=i, name=x) for i, (x, _) in enumerate(block)], T.StructType().add("item", T.IntegerType()).add("name", item_type))
        named = found.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").cast(id_type).alias(id_col), "score"
        )
        out = named if out is None else out.unionByName(named)
    if out is None:
        kind = T.StructType().add(item_col, item_type).add("rank", T.IntegerType()).add(id_col, id_type).add("score", T.LongType())
        return spark.createDataFrame([], kind)
    return out


#: The same ranking in DuckDB's SQL, over all pairs that share a term.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_all FROM d WHERE len(terms) > 0),
t AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
      FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term),
x AS (SELECT q, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
      sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all))))::BIGINT AS score
      FROM b JOIN t USING (term) JOIN w USING (term), s GROUP BY q, r)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
"""
