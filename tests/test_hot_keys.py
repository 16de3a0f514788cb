"""Keys with very many rows: the split forms equal the plain ones, and no task gets a key whole."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.operators import enrich, keyed, parallel_replay, ranges


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data, at = [], 0
    for i in range(3000):
        at += rng.choice((0, 1, 5, 60, 600)) * 1000
        key = rng.choice((1, 1, 1, 1, None, 2, 3))
        data.append((i, key, rng.choice("abcd"), rng.choice((1.0, 2.0, 5.0, None)), at))
    df = spark.createDataFrame(data, "id long, k long, kind string, v double, ms long")
    return df.select("id", "k", "kind", "v", F.timestamp_millis("ms").alias("ts")).repartition(6).persist()


@pytest.fixture
def hot(monkeypatch):
    """All keys above 300 rows count as hot."""
    monkeypatch.setattr(ranges, "TASK_ROWS", 300)


def plain(df):
    return sorted(map(repr, (r.asDict(True) for r in df.collect())))


FORMS = {
    "every_n": lambda d: keyed.every_n(d, 7, {"n": F.lit(1), "v": F.col("v")}, ["id"], ["k"], ts="ts"),
    "every_n_all_later": lambda d: keyed.every_n(d, 7, {"v": F.col("v")}, ["id"], ["k"], "kind <> 'a'", first=False),
    "every_n_ttl": lambda d: keyed.every_n_ttl(d, 7, 300_000, {"n": F.lit(1)}, ["id"], ["k"], "ts"),
    "join_lines": lambda d: keyed.join_lines(d, "kind", "kind = 'a'", ["id"], ["k"], "+", most=3),
    "join_lines_idle": lambda d: keyed.join_lines(d, "kind", "kind = 'a'", ["id"], ["k"], "+", most=3, wait_ms=50_000, ts="ts"),
    "window_time": lambda d: keyed.window_alert(d, 8, ["k"], "ts", ["id"], time="5 minutes"),
    "window_size": lambda d: keyed.window_alert(d, 14, ["k"], "ts", ["id"], size=6, amount=F.col("v")),
    "window_reset": lambda d: keyed.window_alert(d, 8, ["k"], "ts", ["id"], time="5 minutes", size=20, reset=True),
    "array_by_time": lambda d: keyed.array_by_time(d, "1 day", 11, "ts", ["id"]),
    "rules": lambda d: keyed.rules(d, {"a": {"key": ["k"], "threshold": 9, "size": 5, "amount": F.col("v")}, "b": {"key": ["kind"], "threshold": 4, "time": "2 minutes"}}, "ts", ["id"]),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_equals_plain(rows, monkeypatch, form):
    want = plain(FORMS[form](rows))
    assert want
    monkeypatch.setattr(ranges, "TASK_ROWS", 300)
    assert plain(FORMS[form](rows)) == want


def test_split(rows, hot):
    few, many = ranges.split_hot(rows, ["k"])
    counts = dict(rows.groupBy("k").count().collect())
    share = max(300, 3000 // 4)
    assert {r["k"] for r in many.select("k").distinct().collect()} == {k for k, n in counts.items() if n > share}
    assert few.count() + many.count() == 3000


def test_no_task_has_a_hot_key_whole(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), "id")
    numbered = ranges.running(df, ["k"], ["id"], {"n": F.lit(1).cast("long")})
    sizes = [r["count"] for r in df.select(ranges.range_bucket(df, ["k", "id"]).alias("part")).groupBy("part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    assert numbered.filter("n <> id + 1").count() == 0


def test_rounds_and_rest(spark):
    class Phase:
        """Its state depends on all rows before: ranges never agree."""

        def __init__(self):
            self.n = 0

        def row(self, row):
            self.n += 1
            return [row | {"n": self.n}] if self.n % 50 == 0 else []

        def end(self):
            return [{"id": -1, "n": self.n}]

    df = spark.range(1000).select(F.when(F.col("id") < 990, 1).otherwise(2).alias("k"), "id")
    schema = T.StructType().add("k", T.IntegerType()).add("id", T.LongType()).add("n", T.LongType())
    made, rest = parallel_replay.replay_by_ranges(df, ["k"], ["id"], schema, Phase, rounds=2)
    assert rest == [(1,)]
    assert [(r["k"], r["id"], r["n"]) for r in made.collect()] == [(None, -1, 10)]
    made, rest = parallel_replay.replay_by_ranges(df, ["k"], ["id"], schema, Phase, rounds=50)
    want = [(1, 50 * i - 1, 50 * i) for i in range(1, 20)] + [(None, -1, 990), (None, -1, 10)]
    assert rest == [] and sorted(map(repr, ((r["k"], r["id"], r["n"]) for r in made.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_numbers_by_one_shuffle(spark, reuse):
    """Nulls, maps, columns that nobody asks for, filters behind; with and without shared shuffles."""
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(5000).select(
            F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(50))).alias("a"), "id", F.create_map(F.lit("k"), "id").alias("m"), F.lit("x").alias("wide")
        )
        made = enrich.sequence(df.repartition(6, "id"), ["a", "id"], 3)
        want = sorted(((r["a"] is not None, r["a"] or 0), r["id"]) for r in df.collect())
        got = {r["id"]: r["seq"] for r in made.select("id", "seq").collect()}
        assert got == {i: n for n, (_, i) in enumerate(want, 3)}
        some = made.filter("id % 100 = 5").select("seq", "id").collect()
        assert len(some) == 50 and all(got[r["id"]] == r["seq"] for r in some)
        assert made.columns == [*df.columns, "seq"] and enrich.sequence(df.limit(0), ["a", "id"]).count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_one_shuffle_of_rows(spark):
    """Both sides read the same shuffle, whatever is asked of the result."""
    df = spark.range(100_000).select("id", F.lit("x").alias("wide"))
    made = enrich.sequence(df, ["id"]).select("seq")
    made.write.format("noop").mode("overwrite").save()
    assert made.filter("seq < 0").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = enrich.sequence(df, ["id"]).select("seq")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shuffles = [line for line in plan.split("\n") if "Exchange rangepartitioning" in line]
    assert sorted("ReusedExchange" in line for line in shuffles) == [False, True]
