"""Lines of text files with numbers and byte offsets, where many tasks read parts of one file.

Spark's text reader cuts files into byte ranges and hands a line that crosses a boundary to the range in which it
begins. One pass counts the lines and bytes of each range, and a running sum over the ranges of a file says what lies
before each; the other pass counts within ranges as they stream by. So a file of any size is numbered without a shuffle
of its lines. What lies before a range depends on where it begins alone, so both passes may cut files differently; a
line whose range was not counted is an error, never a wrong number.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges, of about 200 bytes, up to which the table of what lies before them is broadcast.
SENT = 200_000


def named(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"))


def excluded(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Without the files whose path or name is like one of the globs as a whole. The pattern is bound at both ends, so a
    path is tried once and not from each of its characters."""
    for glob in exclude:
        pattern = F.lit("^" + re.sub(r"\\[zZ]$", r"\\z", fnmatch.translate(glob)))
        df = df.filter(~F.rlike("path", pattern) & ~F.rlike("filename", pattern))
    return df


def _ranges(spark: SparkSession, glob: str, exclude: Sequence[str], since: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    raw = (reader.option("modifiedAfter", since) if since else reader).text(glob)
    meta = {"start": "file_block_start", "size": "file_size"}
    return excluded(named(raw).select("path", "filename", F.col("value").cast("binary").alias("value"), *(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items())), exclude)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds how many lines and bytes of a row's range come before it."""
    last, lines, size = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column("path"), batch.column("start").to_numpy()
        codes = paths.dictionary_encode().indices.to_numpy()
        lengths = pa.compute.binary_length(batch.column("value")).to_numpy().astype(np.int64) + 1
        heads = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]))))
        rows = np.diff(np.append(heads, batch.num_rows))
        ends = np.cumsum(lengths)
        at = np.arange(batch.num_rows) - np.repeat(heads, rows)
        skipped = ends - lengths - np.repeat(ends[heads] - lengths[heads], rows)
        if last == (paths[0].as_py(), starts[0]):  # the range goes on
            at[: rows[0]] += lines
            skipped[: rows[0]] += size
        last, lines, size = (paths[-1].as_py(), starts[-1]), int(at[-1]) + 1, int(skipped[-1] + lengths[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(skipped)], [*batch.schema.names, "at", "skipped"])


def _sent(raw: DataFrame, before: DataFrame) -> DataFrame:
    """``before`` to broadcast if few ranges are possible: a file has one at least, a task's worth of bytes few."""
    most = len(raw.inputFiles()) + 2 * raw.rdd.getNumPartitions() + 1
    return F.broadcast(before) if most <= SENT else before


def numbered_lines(spark: SparkSession, glob: str, exclude: Sequence[str] = (), since: str | None = None) -> DataFrame:
    r"""``path, filename, size, ln, offset, value``: each line as bytes without its ``\n``, its number from 1 and the
    byte at which it begins; ``size`` is the file's. Compressed files are one range; their offsets are those of the
    unpacked bytes."""
    raw = _ranges(spark, glob, exclude, since)
    totals = raw.groupBy("path", "start").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("bytes"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("path", "start", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("lines", "bytes")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema) + ", at long, skipped long"
    joined = raw.mapInArrow(_count, schema).join(_sent(raw, before), ["path", "start"], "left")
    known = lambda c: F.coalesce(c, F.raise_error(F.lit("files changed while their lines were numbered")).cast("long"))
    ln, offset = known(F.col("lines_before")) + F.col("at") + 1, known(F.col("bytes_before")) + F.col("skipped")
    return joined.select("path", "filename", "size", ln.alias("ln"), offset.alias("offset"), "value")


def text_of(value: str = "value", encoding: str = "UTF-8") -> Column:
    r"""A line's bytes as text, without a ``\r`` at its end."""
    text = F.col(value).cast("string") if encoding.upper().replace("-", "") == "UTF8" else F.decode(value, encoding)
    return F.regexp_replace(text, r"\r\z", "")


def tail(spark: SparkSession, glob: str, marks: DataFrame | None = None, exclude: Sequence[str] = (), encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """The whole lines that files have gained, and the marks behind them.

    ``marks(path, offset, ln)`` say how far each file has been read; a file without one is read from its start, and so
    is one that is shorter than its mark (cut off, or replaced). A last line without an end waits for its end. Returns
    ``path, filename, ln, offset, original_message`` and the new marks of all files that are there, to be stored once the
    rows are written; marks of files that are gone are kept. Both must be used before the files change.
    """
    kinds = "path string, offset long, ln long"
    marks = spark.createDataFrame([], kinds) if marks is None else marks.select("path", "offset", "ln")
    known = marks.select("path", F.col("offset").alias("read"), F.col("ln").alias("lines_read"))
    rows = numbered_lines(spark, glob, exclude).withColumn("end", F.col("offset") + F.octet_length("value") + 1)
    whole = rows.filter("end <= size").join(known, "path", "left").withColumn("read", F.expr("if(size < read, 0, coalesce(read, 0))"))
    fresh = whole.filter("offset >= read").select("path", "filename", "ln", "offset", text_of(encoding=encoding).alias("original_message"))
    ends = rows.filter("end <= size").groupBy("path").agg(F.max("end").alias("offset"), F.max("ln").alias("ln"))
    kept = marks.join(ends.select("path"), "path", "left_anti")
    return fresh, ends.unionByName(kept)
