"""Readers. Batch readers return the rows there are; stream readers take ``readStream`` options as arguments."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbered import excluded, named, numbered_lines, text_of

LINE = "path string, filename string, ln long, original_message string"


def line_files(spark: SparkSession, glob: str, exclude: Sequence[str] = (), encoding: str = "UTF-8", since: str | None = None) -> DataFrame:
    """One row a line with the file's path and name and the line's number from 1: ``path, filename, ln,
    original_message``.

    Large files are numbered by ranges of bytes that many tasks read (see ``numbered``). ``encoding`` is one in which a
    line break is one byte. ``since`` reads only files changed after a time (``2024-01-01T00:00:00``).
    """
    rows = numbered_lines(spark, glob, exclude, since)
    return rows.select("path", "filename", "ln", text_of(encoding=encoding).alias("original_message"))


def lines(spark: SparkSession, glob: str, exclude: Sequence[str] = ()) -> DataFrame:
    """One row a line without numbers; files of any size are split over tasks."""
    return excluded(named(spark.read.text(glob)), exclude).select("path", "filename", F.col("value").alias("original_message"))


def line_stream(spark: SparkSession, folder: str, glob: str = "*", most_files: int | None = None) -> DataFrame:
    """Lines of closed files as they appear in a folder; resumes from the query's checkpoint."""
    reader = spark.readStream.option("pathGlobFilter", glob)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return named(reader.text(folder)).select("path", "filename", F.col("value").alias("original_message"))


def topic_options(servers: str, topics: Sequence[str] | str, offset: str = "latest", group: str | None = None, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for the Kafka reader: topic names, or a pattern written as ``/.../``."""
    names = [topics] if isinstance(topics, str) else list(topics)
    patterns = [t[1:-1] for t in names if t.startswith("/") and t.endswith("/") and len(t) > 2]
    if patterns:
        plain = [re.escape(t) for t in names if not (t.startswith("/") and t.endswith("/"))]
        chosen = {"subscribePattern": "|".join([*patterns, *plain])}
    else:
        chosen = {"subscribe": ",".join(names)}
    return {"kafka.bootstrap.servers": servers, "startingOffsets": offset, **chosen, **({"kafka.group.id": group} if group else {}), **dict(extra or {})}


def topic_stream(spark: SparkSession, **options) -> DataFrame:
    """Messages of topics as a stream; needs Spark's Kafka connector on the class path."""
    return topic_rows(spark.readStream.format("kafka").options(**topic_options(**options)).load())


def topic_rows(raw: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """Rows in the Kafka reader's schema as ``topic, partition, offset, timestamp, key, headers, original_message``."""
    headers = F.col("headers") if "headers" in raw.columns else F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers")
    return raw.select("topic", "partition", "offset", "timestamp", F.decode("key", encoding).alias("key"), headers, F.decode("value", encoding).alias("original_message"))


def inline_rows(spark: SparkSession, rows: Sequence[str]) -> DataFrame:
    """Given texts as rows with their number from 1."""
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(rows)], "ln long, original_message string")


def inline_stream(spark: SparkSession, rows: Sequence[str], per_second: int = 1) -> DataFrame:
    """Given texts again and again, ``per_second`` of them each second."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    texts = F.array(*map(F.lit, rows))
    return ticks.select("timestamp", F.get(texts, F.pmod("value", F.lit(len(rows))).cast("int")).alias("original_message"))


def frame_records(df: DataFrame, blob: str, by: str = "linebreak", out: str = "original_message") -> DataFrame:
    """Cuts blobs into records, one row each: at line breaks (empty lines are dropped), or at priority tags ``<n>``
    (what comes before the first tag is dropped)."""
    if by == "linebreak":
        pieces = F.filter(F.split(blob, r"\r?\n"), lambda x: x != "")
    elif by == "priority":
        pieces = F.regexp_extract_all(F.col(blob), F.lit(r"<\d+>(?:(?!<\d+>)[\s\S])*"), F.lit(0))
    else:
        raise ValueError(f"unknown framing {by}")
    return df.select(*(c for c in df.columns if c != blob), F.posexplode(pieces).alias("record", out))


@dataclass
class Mark:
    """The last value that an incremental pull has read, None before the first, and those of its ``ties``."""

    value: object = None
    ties: tuple = ()


def pull(source: DataFrame, column: str, mark: Mark, batch: int | None = None, ties: Sequence[str] = ()) -> tuple[DataFrame, Mark]:
    """Rows above the mark in ascending order, and the mark behind them. Rows without a value are not read.

    The bound is a filter on the source, so it reaches files and databases. With ``batch`` about so many rows are read:
    ``column`` and ``ties`` together put rows in order, and all rows equal to the last one of the batch come along, so
    none is left behind. ``ties`` must not be null. Read the rows before the source changes, or write them first: the
    bounds of both ends are fixed, but rows that are added later between them would be read, too.
    """
    order = [column, *ties]
    after = lambda name, value: F.col(name) > F.lit(value)
    fresh = source.filter(F.col(column).isNotNull())
    if mark.value is not None:
        known = list(zip(order, (mark.value, *mark.ties), strict=False))
        above = F.lit(False)
        for name, value in reversed(known):
            above = after(name, value) | ((F.col(name) == F.lit(value)) & above)
        fresh = fresh.filter(F.col(column) >= F.lit(mark.value)).filter(above)
    named = F.struct(*order)
    ends = fresh.select(*order) if batch is None else fresh.select(*order).orderBy(*order).limit(batch)
    last = ends.agg(F.max(named)).first()[0]
    if last is None:
        return fresh.limit(0), mark
    upto = F.lit(True)
    for name in reversed(order):
        upto = (F.col(name) < F.lit(last[name])) | ((F.col(name) == F.lit(last[name])) & upto)
    return fresh.filter(F.col(column) <= F.lit(last[column])).filter(upto).orderBy(*order), Mark(last[column], tuple(last)[1:])


def pull_tables(sources: Mapping[str, DataFrame], pattern: str, column: str, marks: Mapping[str, Mark], batch: int | None = None) -> tuple[DataFrame | None, dict[str, Mark]]:
    """``pull`` over all tables whose name matches, with a mark each; rows carry their table in ``collection``."""
    out, after = None, dict(marks)
    for name, source in sources.items():
        if not re.search(pattern, name):
            continue
        rows, after[name] = pull(source, column, marks.get(name, Mark()), batch)
        rows = rows.withColumn("collection", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, after


_KINDS = {
    "int": (str, int),
    "float": (repr, float),
    "str": (str, str),
    "bool": (str, lambda v: v == "True"),
    "Decimal": (str, Decimal),
    "datetime": (datetime.isoformat, datetime.fromisoformat),
    "date": (date.isoformat, date.fromisoformat),
    "bytes": (bytes.hex, bytes.fromhex),
}
_MARKS = "name string, kinds array<string>, parts array<string>"


def _written(value: object) -> tuple[str, str | None]:
    kind = type(value).__name__
    if value is None:
        return "None", None
    if kind not in _KINDS:
        raise TypeError(f"a mark cannot be a {kind}")
    return kind, _KINDS[kind][0](value)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Complete versions of a mark log, oldest first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [str(x.getPath().toString()) for x in fs.listStatus(top)]
    numbered = [(int(m[1]), f) for f in found if (m := re.search(r"/version=(\d+)$", f))]
    return sorted(x for x in numbered if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{x[1]}/_SUCCESS")))


def load_marks(spark: SparkSession, path: str) -> dict[str, Mark]:
    """The marks of the latest complete version that ``save_marks`` wrote, by name, with their types; empty if there is
    none yet. A version that was cut off while it was written does not count."""
    versions = _versions(spark, path)
    if not versions:
        return {}
    rows = spark.read.schema(_MARKS).json(versions[-1][1]).collect()
    read = lambda kind, text: None if kind == "None" else _KINDS[kind][1](text)
    values = {r["name"]: [read(k, t) for k, t in zip(r["kinds"], r["parts"], strict=True)] for r in rows}
    return {name: Mark(v[0], tuple(v[1:])) for name, v in values.items()}


def save_marks(spark: SparkSession, path: str, marks: Mapping[str, Mark], keep: int = 10) -> None:
    """Adds a version with all ``marks``. Call it once the rows before the marks are written: if anything fails between
    the two, the old marks stand and the rows are read again. Nothing is overwritten; the newest ``keep`` versions stay."""
    rows = []
    for name, mark in marks.items():
        kinds, parts = zip(*map(_written, (mark.value, *mark.ties)), strict=True)
        rows.append((name, list(kinds), list(parts)))
    versions = _versions(spark, path)
    number = versions[-1][0] + 1 if versions else 0
    spark.createDataFrame(rows, _MARKS).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/version={number}")
    for _, old in versions[: max(0, len(versions) + 1 - keep)]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def pull_into(source: DataFrame, column: str, path: str, name: str, sink: Callable[[DataFrame, int], None], batch: int | None = None, ties: Sequence[str] = ()) -> bool:
    """One step of a pull: rows above the stored mark go to ``sink(rows, step)``, then the mark moves. A step that failed
    anywhere is done again with the same number, so a sink that replaces what a step wrote gets no row twice and misses
    none. False if there was nothing new."""
    spark = source.sparkSession
    marks = load_marks(spark, path)
    versions = _versions(spark, path)
    rows, after = pull(source, column, marks.get(name, Mark()), batch, ties)
    if after == marks.get(name, Mark()):
        return False
    sink(rows, versions[-1][0] + 1 if versions else 0)
    save_marks(spark, path, marks | {name: after})
    return True
