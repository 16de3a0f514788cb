"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a partial aggregation and a
join that adaptive execution may split, so a node with very many neighbours needs no task of its own; the number of
steps grows with the logarithm of the size of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)").alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the smallest of them."""
    down = edges.filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tables: Tables, max_steps: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs, a != b, in any direction -> ``(node, root)`` for every node that has an edge.

    ``root`` is the smallest node of the component. Null ends and self-loops are left out. An empty table gives an
    empty table. Raises if ``max_steps`` is too few.
    """
    now = tables.write(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _digest(now)
    for _ in range(max_steps):
        if seen[0] == 0:
            break
        step = tables.write(_small_star(_large_star(now)))
        digest = _digest(step)
        tables.drop(now)
        now = step
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"components need more than {max_steps} steps")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
