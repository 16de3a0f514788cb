"""Texts joined from a key's rows stay bounded when one key holds most rows."""

from pyspark.sql import functions as F

from fluvia.operators import extract
from fluvia.plans import catalogue
from fluvia.sources import readers


def hot_events(spark, sf, folder):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(1)
    rows = spark.range(2500).select(F.col("id").alias("event_id"), F.when(F.col("id") < 2450, 1).otherwise(2).cast("long").alias("user_id"))
    rows.join(events.drop("event_id", "user_id"), how="cross").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_blobs_are_bounded(spark, sf, tmp_path, monkeypatch):
    folder, sizes = hot_events(spark, sf, tmp_path), []

    def seen(own, column):
        def call(df, *args):
            sizes.append(df.agg(F.max(F.length(column))).first()[0])
            return own(df, *args)

        return call

    monkeypatch.setattr(readers, "frame_records", seen(readers.frame_records, "blob"))
    monkeypatch.setattr(extract, "xml_rows", seen(extract.xml_rows, "text"))
    got = sorted((r["user_id"], r["record"], int(r["original_message"].split("n=")[1])) for r in catalogue.queries()["frame_priority"](spark, folder).collect())
    assert got == [(1, i, i) for i in range(2450)] + [(2, i, 2450 + i) for i in range(50)]
    found = {r["user_id"]: (r["n"], r["ids"]) for r in catalogue.queries()["xml_tags"](spark, folder).collect()}
    assert found == {1: (2450, sum(range(2450))), 2: (50, sum(range(2450, 2500)))}
    assert len(sizes) == 2 and sizes[0] < 40_000 and sizes[1] < 70_000
