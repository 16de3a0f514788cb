"""Writers for batches, and functions for ``foreachBatch`` of streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Sink = Callable[[DataFrame], None]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share, ``spark.checkpoint.dir``. Only a local session without
    the setting gets a temporary folder; a cluster without it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def routed_files(df: DataFrame, path: str, route: dict[str, Column], line: Column | None = None, fmt: str = "text", mode: str = "append") -> None:
    """Files in folders named by the values of ``route``; ``line`` is the text of a row (default: the row as JSON)."""
    if fmt == "text":
        text = F.to_json(F.struct(*df.columns)) if line is None else line
        df = df.select(*(c.alias(k) for k, c in route.items()), text.alias("value"))
    else:
        df = df.withColumns(route)
    df.write.mode(mode).partitionBy(*route).format(fmt).save(path)


def string_hash(c: Column) -> Column:
    """The 32-bit hash of a text that multiplies by 31 and adds each character's UTF-16 code.

    Characters beyond U+FFFF count as their two halves. The running value is kept in 32 bits as a long.
    """

    def add(h: Column, code: Column) -> Column:
        return F.pmod(h * 31 + code, F.lit(1 << 32))

    def step(h: Column, ch: Column) -> Column:
        code = F.ascii(ch).cast("long")
        high = add(h, F.lit(0xD800) + F.shiftright(code - 0x10000, 10))
        return F.when(code < 0x10000, add(h, code)).otherwise(add(high, F.lit(0xDC00) + (code - 0x10000) % 1024))

    chars = F.filter(F.split(F.coalesce(c.cast("string"), F.lit("")), ""), lambda x: x != "")
    total = F.aggregate(chars, F.lit(0).cast("long"), step)
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total)


def topic_partition(df: DataFrame, partitions: int, mode: str = "hashed", field: Column | None = None, out: str = "partition", order_by: Sequence[str] = ()) -> DataFrame:
    """The partition of each row: ``hashed`` by the text hash of ``field``, ``fixed`` by its number, or ``roundrobin``
    in the order of ``order_by``, numbered by ranges, else 0."""
    if mode == "hashed":
        part = F.pmod(string_hash(field), F.lit(partitions))
    elif mode == "fixed":
        part = F.coalesce(field.try_cast("int"), F.lit(0))
    elif mode == "roundrobin":
        from ..operators.enrich import sequence

        numbered = sequence(df, order_by, out="__fluvia_n")
        return numbered.withColumn(out, F.pmod("__fluvia_n", F.lit(partitions)).cast("int")).drop("__fluvia_n")
    else:
        part = F.lit(0)
    return df.withColumn(out, part.cast("int"))


def topic_columns(df: DataFrame, topic: Column, value: Column, key: Column | None = None) -> DataFrame:
    """Columns that the Kafka writer takes."""
    kept = ["partition"] if "partition" in df.columns else []
    named = [topic.cast("string").alias("topic"), value.cast("string").alias("value"), *kept]
    return df.select(*named, *([] if key is None else [key.cast("string").alias("key")]))


def collections(df: DataFrame, path: str, collection: Column, batch_id: int | None = None, fmt: str = "parquet") -> None:
    """Rows in one table by collection; columns that start with ``$`` are dropped.

    With ``batch_id`` (in ``foreachBatch``) a batch that is written again replaces itself, so retries leave no copies.
    """
    df = df.drop(*(c for c in df.columns if c.startswith("$"))).withColumn("collection", collection)
    if batch_id is None:
        df.write.mode("append").partitionBy("collection").format(fmt).save(path)
    else:
        df.write.mode("overwrite").partitionBy("collection").format(fmt).save(f"{path}/batch={batch_id}")


def all_of(sinks: Sequence[Sink], serial: bool = False) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes a batch to every sink. ``serial`` writes one after the other and stops
    at the first that fails; else all write the same persisted batch at once, each from a thread of its own, and the
    first error is raised when all are done."""

    def write(batch: DataFrame, batch_id: int = 0) -> None:
        batch.persist()
        try:
            if serial:
                for sink in sinks:
                    sink(batch)
                return
            with ThreadPoolExecutor(max(1, len(sinks))) as pool:
                jobs = [pool.submit(inheritable_thread_target(batch.sparkSession)(sink), batch) for sink in sinks]
            for error in filter(None, (job.exception() for job in jobs)):
                raise error
        finally:
            batch.unpersist()

    return write


def null(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def console(df: DataFrame, rows: int = 20, as_json: bool = False) -> None:
    """Shows the first rows."""
    (df.select(F.to_json(F.struct(*df.columns)).alias("row")) if as_json else df).show(rows, truncate=False)


def counted(df: DataFrame, name: str, **when: Column) -> tuple[DataFrame, Observation]:
    """Counts rows that pass a stage, and of those where each condition holds, while any action runs."""
    seen = Observation(name)
    parts = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in when.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *parts), seen


def progress(df: DataFrame, name: str = "progress") -> DataFrame:
    """A stream whose progress reports have the number of rows of each batch under ``name``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def retries(sink: Sink, times: int) -> Sink:
    """A sink that is tried again up to ``times`` times."""

    def write(df: DataFrame) -> None:
        for left in reversed(range(times + 1)):
            try:
                return sink(df)
            except Exception:
                if not left:
                    raise

    return write
