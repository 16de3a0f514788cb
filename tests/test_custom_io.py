"""Custom streaming sources that resume, and custom sinks that write all or nothing."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fluvia.sinks import committed, writers
from fluvia.sources import splits


def test_stream_resumes(spark, tmp_path):
    """Each row once over three runs of a query on a source that grows, read in parts of at most four rows."""
    grown, seen = tmp_path / "size", tmp_path / "done"

    def latest(options):
        return {"n": int(open(options["size"]).read())}

    def parts(start, end, options):
        return [(i, min(i + 4, end["n"])) for i in range(start["n"], end["n"], 4)]

    def rows(part, options):
        return ((i, f"row {i}") for i in range(*part))

    def done(end, options):
        with open(options["done"], "a") as f:
            f.write(f"{end['n']}\n")

    splits.register_stream(spark, "growing", "n long, word string", latest, parts, rows, lambda options: {"n": 0}, done)
    out, where = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for size in (6, 6, 17):
        grown.write_text(str(size))
        stream = spark.readStream.format("growing").option("size", str(grown)).option("done", str(seen)).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
        assert sorted((r["n"], r["word"]) for r in spark.read.parquet(out).collect()) == [(i, f"row {i}") for i in range(size)]
    assert seen.read_text().split()


def file_sink(spark, name):
    """Files that are staged under hidden names; a commit renames them and leaves a mark of the micro-batch."""

    def stage(rows, options):
        handle, path = tempfile.mkstemp(prefix=".staged-", dir=options["path"])
        with os.fdopen(handle, "w") as f:
            for r in rows:
                if r["n"] == int(options.get("fails", -1)):
                    raise ValueError("broken row")
                f.write(json.dumps({"n": r["n"]}) + "\n")
        return path

    def commit(staged, options, batch):
        mark = f"{options['path']}/.batch-{batch}"
        if batch is not None and os.path.exists(mark):
            return
        for path in staged:
            os.rename(path, path.replace(".staged-", "part-"))
        if batch is not None:
            open(mark, "w").close()

    def abort(staged, options):
        for path in staged:
            os.remove(path)

    committed.register(spark, name, stage, commit, abort)


def found(folder):
    return sorted(json.loads(line)["n"] for f in os.listdir(folder) if f.startswith("part-") for line in open(f"{folder}/{f}"))


def test_all_or_nothing(spark, tmp_path):
    file_sink(spark, "staged_files")
    df = spark.range(20).select(F.col("id").alias("n")).repartition(4)
    df.write.format("staged_files").option("path", str(tmp_path)).mode("append").save()
    assert found(tmp_path) == list(range(20))
    with pytest.raises(Exception, match="broken row"):
        df.write.format("staged_files").option("path", str(tmp_path)).option("fails", "7").mode("append").save()
    assert found(tmp_path) == list(range(20))


def test_stream_into_a_committed_sink(spark, tmp_path):
    file_sink(spark, "staged_stream")
    source, out, where = f"{tmp_path}/in", tmp_path / "out", f"{tmp_path}/checkpoint"
    out.mkdir()
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).select(F.col("id").alias("n")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("n long").parquet(source)
        query = stream.writeStream.format("staged_stream").option("path", str(out)).option("checkpointLocation", where).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert found(out) == list(range(10 * i + 10))


def test_parallel_sinks_overlap(spark):
    """All sinks run at once, on one persisted batch, and the first error comes after all are done."""
    import threading

    gate, rows = threading.Barrier(2, timeout=60), []

    def sink(df):
        gate.wait()  # only passes if both are inside
        rows.append(df.count())

    def broken(df):
        gate.wait()
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        writers.all_of([broken, sink])(spark.range(6))
    assert rows == [6]
