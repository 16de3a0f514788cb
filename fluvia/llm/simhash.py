"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most two bits have a 64-bit word between them that differs from each in at
most one. So every *distinct* fingerprint emits itself and its 64 one-bit variants, the variants are the shuffle key,
and what meets on a variant is verified. A variant has at most 65 distinct fingerprints around it, each named by the
bit in which it differs: a bucket is one mask, made by a hash aggregation with ``bit_or``, whatever the number of
copies. All members of a bucket lie within two bits of each other, so linking each to the smallest keeps components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .components import components

SEED = 42
MAX_DISTANCE = 2


def simhash(text: str | None, size: int = 3) -> int:
    """The unsigned 64-bit fingerprint: words split at ASCII white space, A-Z lower-cased, ``size``-word shingles with
    repeats; a bit is set if more than half of the shingles' XXH64 have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = 3) -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        found = np.fromiter((simhash(t, size) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text)))


def ball_edges(fps: DataFrame) -> DataFrame:
    """Distinct ``fps(fp)`` -> ``(a, b)``: links between fingerprints at one or two differing bits that keep every
    component whole (each bucket is linked as a star)."""
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ball = spread.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")).select(
        F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end").alias("variant"),
        F.expr("case when bit < 0 then 0L else shiftleft(1L, bit) end").alias("flip"),
    )
    buckets = (
        ball.groupBy("variant")
        .agg(F.expr("bit_or(flip)").alias("mask"), F.max(F.expr("flip = 0")).alias("own"))
        .filter("bit_count(mask) + cast(own as int) >= 2")
    )
    members = F.expr(
        "concat(if(own, array(variant), cast(array() as array<bigint>)), transform("
        "filter(sequence(0, 63), i -> (shiftrightunsigned(mask, i) & 1L) = 1L), i -> variant ^ shiftleft(1L, i)))"
    )
    return (
        buckets.select(members.alias("members"))
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .filter(f"a <> b and bit_count(a ^ b) <= {MAX_DISTANCE}")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, name: str = "simhash"
) -> DataFrame:
    """One row per document: ``id_col, fp, component_id``, the smallest id that links of at most two bits reach.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay rows. A null id stays,
    with the smallest id of its component (null if that has none). Other columns, whatever their names, are not read.
    """
    tables = Tables(docs.sparkSession, name)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    base = tables.write(fingerprints(own, "_text", "fp", size).select("_id", "fp"))
    fps = base.groupBy("fp").agg(F.min("_id").alias("least"))
    links = components(ball_edges(fps.select("fp")), tables)
    linked = fps.join(links.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    joined = linked.join(least, "root").select("fp", "component")
    reach = fps.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return base.join(tables.write(reach), "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def hex16(fp: str = "fp"):
    """The 16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
