"""Marks of incremental pulls: types, versions, and steps that fail on the way."""

import datetime
import decimal
import os
import shutil

import pytest
from pyspark.sql import functions as F

from fluvia.sources import readers
from fluvia.sources.readers import Mark


def test_types_come_back(spark, tmp_path):
    values = [7, 0.1, float("inf"), "é\n", True, decimal.Decimal("12345678901234567890.123456789"), datetime.datetime(2024, 5, 6, 7, 8, 9, 123456), datetime.date(2024, 1, 2), b"\x00\xff", None]
    marks = {str(i): Mark(v, (v, "tie")) for i, v in enumerate(values)}
    readers.save_marks(spark, f"{tmp_path}/m", marks)
    assert readers.load_marks(spark, f"{tmp_path}/m") == marks
    with pytest.raises(TypeError):
        readers.save_marks(spark, f"{tmp_path}/m", {"x": Mark([1])})


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/m"
    assert readers.load_marks(spark, path) == {}
    for i in range(5):
        readers.save_marks(spark, path, {"a": Mark(i)}, keep=3)
    assert sorted(f for f in os.listdir(path) if f.startswith("version")) == ["version=2", "version=3", "version=4"]
    os.remove(f"{path}/version=4/_SUCCESS")  # cut off while it was written
    assert readers.load_marks(spark, path) == {"a": Mark(3)}
    readers.save_marks(spark, path, {"a": Mark(9)})
    assert readers.load_marks(spark, path) == {"a": Mark(9)}


@pytest.mark.parametrize("fails", ["in_sink", "before_mark"])
def test_no_row_twice_or_lost(spark, tmp_path, monkeypatch, fails):
    source = spark.range(10).withColumn("v", F.floor(F.col("id") / 2))
    path, out, broken = f"{tmp_path}/m", f"{tmp_path}/out", [1]

    def sink(rows, step):
        rows.write.mode("overwrite").parquet(f"{out}/step={step}")
        if fails == "in_sink" and step == 1 and broken:
            broken.pop()
            shutil.rmtree(f"{out}/step={step}")
            raise RuntimeError("down")

    save = readers.save_marks

    def dying(*args, **kw):
        if fails == "before_mark" and broken and readers.load_marks(spark, path):
            broken.pop()
            raise RuntimeError("killed")
        save(*args, **kw)

    monkeypatch.setattr(readers, "save_marks", dying)
    failures = 0
    while True:
        try:
            if not readers.pull_into(source, "v", path, "numbers", sink, batch=3):
                break
        except RuntimeError:
            failures += 1
            assert readers.load_marks(spark, path) == {"numbers": Mark(1)}
    assert failures == 1
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(10))
