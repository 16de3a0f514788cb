"""Rows dealt by ranges of an order, so that numbering and accumulating need no task with all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key that any task takes; only keys with more, and with more than an even task's share, are split.
TASK_ROWS = 1_000_000


def range_bucket(df: DataFrame, order_by: Sequence[str], parts: int | None = None, per_part: int = 40) -> Column:
    """The number of the range that a row falls in, ascending with ``order_by``, as an expression on the row.

    Bounds are drawn from a sample of about ``per_part`` rows a range, which the driver holds; they are literals in
    the expression, so every evaluation of it agrees, also when a lost task runs again. ``parts`` is four times the
    shuffle partitions by default. The sample takes one scan of the order's columns: rows with the least hashes.
    """
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order_by)
    known = keys.dropna().withColumn("__fluvia_at", F.xxhash64(*order_by, F.monotonically_increasing_id()))
    drawn = known.orderBy("__fluvia_at").limit(parts * per_part).drop("__fluvia_at").collect()
    drawn = sorted({tuple(r) for r in drawn})
    bounds = [drawn[i * len(drawn) // parts] for i in range(1, parts)] if len(drawn) >= parts else drawn
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    kinds = [keys.schema[c].dataType for c in order_by]
    listed = F.array(*(F.struct(*(F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(b, kinds, strict=True)))) for b in bounds))
    own = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    past = lambda at, p: F.coalesce(F.get(listed, at + p - 1) <= own, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, p: F.when(past(at, p), at + p).otherwise(at))


def _seen(df: DataFrame) -> Column:
    """A number that depends on every column, so that none can be left out of what it is computed from."""

    def plain(field: T.StructField) -> Column:
        text = field.dataType.simpleString()
        if "variant" in text:
            return F.col(field.name).cast("string")
        return F.to_json(F.struct(field.name)) if "map<" in text else F.col(field.name)

    return F.xxhash64(*map(plain, df.schema.fields))


def numbered(df: DataFrame, order_by: Sequence[str], start: int, out: str) -> DataFrame:
    """Row numbers in the order of ``order_by``, by one shuffle into ranges. A row's place in its range is where it lies;
    what lies before a range comes from a table of counts, a row a range, made from the same shuffle.

    That Spark runs that shuffle once for both matters, as its ranges are drawn anew each time. So both sides need the
    same columns, and a row outside the counted bounds of its range is an error, never a wrong number. Where a session
    does not share shuffles, ranges with fixed bounds are used.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse", "true") != "true":
        return _numbered_by_bounds(df, order_by, start, out)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lying = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    named = lying.select("*", F.spark_partition_id().alias("__fluvia_part"), place.alias("__fluvia_place"), _seen(df).alias("__fluvia_seen"))
    own = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)))
    counts = named.groupBy("__fluvia_part").agg(
        F.count("*").alias("__fluvia_rows"), F.min(own).alias("__fluvia_low"), F.max(own).alias("__fluvia_high"), F.max("__fluvia_seen").alias("__fluvia_most")
    )
    earlier = Window.orderBy("__fluvia_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__fluvia_rows").over(earlier), F.lit(0)).alias("__fluvia_before")
    table = counts.select("__fluvia_part", "__fluvia_low", "__fluvia_high", "__fluvia_most", before)
    joined = named.join(F.broadcast(table), "__fluvia_part", "left")  # a row for each shuffle partition
    known = (own >= F.col("__fluvia_low")) & (own <= F.col("__fluvia_high")) & (F.col("__fluvia_seen") <= F.col("__fluvia_most"))
    number = F.col("__fluvia_before") + F.col("__fluvia_place") + start
    failed = F.raise_error(F.lit("ranges changed while rows were numbered")).cast("long")
    return joined.select(*df.columns, F.when(F.coalesce(known, F.lit(False)), number).otherwise(failed).alias(out))


def _numbered_by_bounds(df: DataFrame, order_by: Sequence[str], start: int, out: str) -> DataFrame:
    one = df.withColumn("__fluvia_all", F.lit(0))
    first = running(one, ["__fluvia_all"], order_by, {out: F.lit(1).cast("long")})
    return first.withColumn(out, F.col(out) + (start - 1)).drop("__fluvia_all")


def before_each(totals: DataFrame, part: str, value: Column, out: str) -> DataFrame:
    """``part`` with ``value`` aggregated over all earlier parts (null for the first); ``totals`` has a row a range."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, value.over(earlier).alias(out))


def with_part(df: DataFrame, table: DataFrame, on: Sequence[str] = ("__fluvia_part",)) -> DataFrame:
    """``df`` with the columns that ``table`` has for a row's range; ``on`` is never null. The comparison is null-safe, as
    from a plain equality Spark infers that the expression of ``range_bucket`` equals the table's column, and can filter
    the table by it, though the rows' columns are not there."""
    named = table.withColumnsRenamed({c: f"{c}_t" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_t")) for c in on))
    return df.join(named, same).drop(*(f"{c}_t" for c in on))


def split_hot(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and those of keys with so many rows that one task should not take them (None if there are
    none). Counts every key once, on the key's columns alone; there are at most as many hot keys as shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*key).agg(F.count("*").alias("__fluvia_rows"))
    total, most = counts.agg(F.coalesce(F.sum("__fluvia_rows"), F.lit(0)), F.coalesce(F.max("__fluvia_rows"), F.lit(0))).first()
    limit = max(TASK_ROWS, total // parts)
    if most <= limit:
        return df, None
    found = counts.filter(F.col("__fluvia_rows") > limit).select(*key).collect()
    same = lambda row: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType)) for k, v in zip(key, row, strict=True)))
    hot = reduce(lambda a, b: a | b, map(same, found))
    return df.filter(~hot), df.filter(hot)


def running(df: DataFrame, key: Sequence[str], order_by: Sequence[str], sums: Mapping[str, Column], before: Mapping[str, Column] | None = None) -> DataFrame:
    """Running sums by key up to each row, and values of the row before it (null for a key's first), dealt by ranges of
    key and order: a key with many rows lies in several ranges, so no task holds it whole. Of each range and key only
    the sums and the last row's values meet others. Null keys are one key."""
    before = dict(before or {})
    parted = df.withColumns({f"__fluvia_v{i}": c for i, c in enumerate([*sums.values(), *before.values()])})
    parted = parted.select("*", range_bucket(df, [*key, *order_by]).alias("__fluvia_part"), F.struct(*key).alias("__fluvia_key"))
    values, lasts = [f"__fluvia_v{i}" for i in range(len(sums))], [f"__fluvia_v{i}" for i in range(len(sums), len(sums) + len(before))]
    order = F.struct(*order_by)
    totals = parted.groupBy("__fluvia_part", "__fluvia_key").agg(*(F.sum(v).alias(v) for v in values), *(F.max_by(v, order).alias(v) for v in lasts), F.count("*").alias("__fluvia_n"))
    parts = Window.partitionBy("__fluvia_key").orderBy("__fluvia_part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_b") for v in values] + [F.lag(v).over(parts).alias(f"{v}_b") for v in lasts]
    carry = totals.select("__fluvia_part", "__fluvia_key", *carried)
    inside = Window.partitionBy("__fluvia_part", "__fluvia_key").orderBy(*order_by)
    own = parted.withColumns(
        {f"{v}_o": F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for v in values}
        | {f"{v}_o": F.lag(v).over(inside) for v in lasts}
        | ({"__fluvia_i": F.row_number().over(inside)} if lasts else {})
    )
    joined = with_part(own, carry, ["__fluvia_part", "__fluvia_key"])
    out = {n: F.col(f"{v}_o") + F.col(f"{v}_b") for n, v in zip(sums, values, strict=True)}
    out |= {n: F.when(F.col("__fluvia_i") == 1, F.col(f"{v}_b")).otherwise(F.col(f"{v}_o")) for n, v in zip(before, lasts, strict=True)}
    return joined.select(*df.columns, *(c.alias(n) for n, c in out.items()))


def row_number_by_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str], out: str) -> DataFrame:
    """Row numbers from 1 within each key, dealt by ranges (see ``running``)."""
    return running(df, key, order_by, {out: F.lit(1).cast("long")})
