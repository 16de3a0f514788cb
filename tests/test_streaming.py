"""Streams give what batches over the same rows give: in order, shuffled over micro-batches, and after a restart."""

import math
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvia.operators import keyed
from fluvia.streaming import stateful


@pytest.fixture(scope="module")
def events(spark, sf):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # each partition of each batch starts a worker
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).alias("cents"))
    rows = rows.filter("user_id < 4").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = tempfile.mkdtemp(prefix="spark-") + "/events"
    for i in range(2):  # the file source takes files in the order in which they came
        rows.filter(F.floor(F.col("event_id") / 500) == i).coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(folder)
    yield spark.read.parquet(folder), lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(stream, name):
    where = tempfile.mkdtemp(prefix="spark-")
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", where).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_every_n(events):
    batch, stream = events
    sums = {"n": F.lit(1), "total": F.col("cents")}
    want = keyed.every_n(batch, 5, sums, ["event_id"], ["user_id"], "event_type <> 'view'").select("event_id", F.col("aggregate.n").cast("double").alias("n"), "aggregate.total")
    got = run(stateful.every_n(stream(), 5, sums, ["event_id"], ["user_id"], "event_type <> 'view'"), "every_n")
    assert rows(got, "event_id", "n", "total") == rows(want, "event_id", "n", "total")


def test_every_n_ttl(events):
    batch, stream = events
    sums = {"n": F.lit(1)}
    want = keyed.every_n_ttl(batch, 5, 3_600_000 * 24, sums, ["event_id"], ["user_id"], "ts", tail=False)
    got = run(stateful.every_n(stream(), 5, sums, ["event_id"], ["user_id"], ttl_ms=3_600_000 * 24, ts="ts"), "every_ttl")
    assert rows(got, "event_id", "n", "flushed") == rows(want, "event_id", "n", "flushed")


@pytest.mark.parametrize("reset", [True, False])
def test_window_alert(events, reset):
    batch, stream = events
    want = keyed.window_alert(batch, 3, ["user_id"], "ts", ["event_id"], time="36 hours", size=50, reset=reset)
    got = run(stateful.window_alert(stream(), 3, ["user_id"], "ts", ["event_id"], "36 hours", 50, reset=reset), f"alert_{reset}")
    assert rows(got, "event_id", "window_value") == rows(want, "event_id", "window_value")


def test_array_by_size(events):
    batch, stream = events
    want = keyed.array_by_size(batch, 7, ["event_id"], ["user_id"]).select("user_id", F.transform("rows", lambda r: r["event_id"]).alias("ids"))
    got = run(stateful.array_by_size(stream(), 7, ["event_id"], ["user_id"]), "arrays").select("user_id", F.transform("rows", lambda r: r["event_id"]).alias("ids"))
    assert rows(got, "user_id", "ids") == rows(want, "user_id", "ids")


def test_join_lines(events):
    batch, stream = events
    want = keyed.join_lines(batch, "event_type", "event_type = 'signup'", ["event_id"], ["user_id"], "+", most=4)
    made = stateful.join_lines(stream(), "event_type", "event_type = 'signup'", ["event_id"], ["user_id"], "+", most=4, idle_ms=None)
    got = rows(run(made, "joined"), "event_id", "out")
    # the last event of each key still waits for its end
    assert set(got) < set(rows(want, "event_id", "out"))
    assert len(got) == want.count() - batch.select("user_id").distinct().count()


def test_global_value(events):
    batch, stream = events
    from fluvia.operators.enrich import global_value

    stored = batch.filter("event_type = 'signup'").select("user_id", "event_id", "cents")
    want = global_value(batch.filter("event_type <> 'signup'"), stored, "event_id", "cents", "latest", ["user_id"])
    got = run(stateful.global_value(stream(), "event_type = 'signup'", F.col("cents"), ["user_id"], ["event_id"], "latest"), "latest")
    assert rows(got, "event_id", F.coalesce("latest", F.lit(-1.0)).alias("latest")) == rows(want, "event_id", F.coalesce("latest", F.lit(-1.0)).alias("latest"))


def test_throttle(events):
    batch, stream = events
    want = [keyed.throttle(batch.filter(F.col("user_id") == u), 3_600_000, "ts", ["event_id"]) for u in range(4)]
    got = run(stateful.throttle(stream(), 3_600_000, "ts", ["event_id"], ["user_id"]), "throttled")
    assert rows(got, "event_id", "release_ms") == sorted(r for w in want for r in rows(w, "event_id", "release_ms"))


@pytest.fixture(scope="module")
def shuffled(spark, events):
    """The same events in four micro-batches without any order, and what a batch holds up to the last watermark."""
    batch, _ = events
    folder = tempfile.mkdtemp(prefix="spark-") + "/events"
    for i in range(4):
        batch.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(folder)
    yield batch, lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)


ORDER = ["ts", "event_id"]


def test_shuffled_every_n(shuffled):
    batch, stream = shuffled
    sums = {"n": F.lit(1), "total": F.col("cents")}
    want = keyed.every_n(batch, 5, sums, ORDER, ["user_id"]).select("event_id", "ts", F.col("aggregate.n").cast("double").alias("n"), "aggregate.total")
    got = run(stateful.every_n(stream(), 5, sums, ["event_id"], ["user_id"], ts="ts", late="400 days"), "late_every")
    assert rows(got, "event_id") == []  # all still waits
    ends = closing(batch)
    got = run(stateful.every_n(ends, 5, sums, ["event_id"], ["user_id"], ts="ts", late="400 days"), "late_every_all").filter("user_id < 4")
    assert rows(got, "event_id", "n", "total") == rows(want, "event_id", "n", "total")


def closing(batch):
    """Events without any order over micro-batches, and a far later row of another key that moves the watermark on."""
    folder = tempfile.mkdtemp(prefix="spark-") + "/end"
    last = batch.limit(1).withColumns({"user_id": F.lit(99).cast("long"), "ts": F.lit("2200-01-01 00:00:00").cast("timestamp")})
    last.select(batch.columns).coalesce(1).write.parquet(folder)
    spark, both = batch.sparkSession, tempfile.mkdtemp(prefix="spark-") + "/both"
    for i in range(4):
        batch.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(both)
    spark.read.parquet(folder).coalesce(1).write.mode("append").parquet(both)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(both)


def test_shuffled_join_lines(shuffled):
    batch, stream = shuffled
    want = keyed.join_lines(batch, "event_type", "event_type = 'signup'", ORDER, ["user_id"], "+", most=4)
    made = stateful.join_lines(closing(batch), "event_type", "event_type = 'signup'", ["event_id"], ["user_id"], "+", most=4, idle_ms=None, ts="ts", late="400 days")
    got = rows(run(made, "late_joined"), "event_id", "out")
    assert set(got) < set(rows(want, "event_id", "out"))
    assert len(got) == want.count() - batch.select("user_id").distinct().count()


def test_shuffled_global_value(shuffled):
    batch, stream = shuffled
    from fluvia.operators.enrich import global_value

    numbered = batch.withColumn("at", F.struct("ts", "event_id"))
    stored = numbered.filter("event_type = 'signup'").select("user_id", "at", "cents")
    want = global_value(numbered.filter("event_type <> 'signup'"), stored, "at", "cents", "latest", ["user_id"])
    made = stateful.global_value(closing(batch), "event_type = 'signup'", F.col("cents"), ["user_id"], ["event_id"], "latest", late="400 days", ts="ts")
    got = run(made, "late_latest").filter("user_id < 4")
    latest = F.coalesce("latest", F.lit(-1.0)).alias("latest")
    assert rows(got, "event_id", latest) == rows(want, "event_id", latest)


FORMS = {
    "every_n": lambda s: stateful.every_n(s, 5, {"n": F.lit(1)}, ["event_id"], ["user_id"], ttl_ms=3_600_000 * 24, ts="ts"),
    "array_by_size": lambda s: stateful.array_by_size(s, 7, ["event_id"], ["user_id"]).select("user_id", F.transform("rows", lambda r: r["event_id"]).alias("ids")),
    "join_lines": lambda s: stateful.join_lines(s, "event_type", "event_type = 'signup'", ["event_id"], ["user_id"], "+", most=4, idle_ms=None),
    "window_alert": lambda s: stateful.window_alert(s, 3, ["user_id"], "ts", ["event_id"], "36 hours", 50),
    "global_value": lambda s: stateful.global_value(s, "event_type = 'signup'", F.col("cents"), ["user_id"], ["event_id"], "latest"),
    "throttle": lambda s: stateful.throttle(s, 3_600_000, "ts", ["event_id"], ["user_id"]),
    "assemble_xml": lambda s: stateful.assemble_xml(s.withColumn("t", F.expr("case when event_id % 3 = 0 then '<e><e/>' when event_id % 3 = 1 then 'x' else '</e>' end")), "t", "e", ["event_id"], ["user_id"]),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_stop_and_resume(spark, events, form):
    """A query that is stopped and started again from its checkpoint gives the rows of one that was not, each once."""
    batch, _ = events
    thirds = batch.withColumn("part", F.ntile(3).over(Window.orderBy("event_id")) - 1)
    out, where = tempfile.mkdtemp(prefix="spark-") + "/out", tempfile.mkdtemp(prefix="spark-")
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    for i in range(3):
        thirds.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = FORMS[form](source).writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    whole = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    want = run(FORMS[form](whole), f"whole_{form}").collect()
    assert want and sorted(map(repr, spark.read.parquet(out).collect())) == sorted(map(repr, want))


def test_no_value_is_lost(spark):
    """NaN, nulls beside long integers and users' own columns named like helpers come out as they were."""
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    kinds = "k long, id long, x double, big long, _begins long, _stored long, _ts string, tags map<string,long>"
    data = [(1, i, [float("nan"), None, 1.5][i % 3], [None, (1 << 60) + i][i % 2], 8, 9, "own", {"a": i}) for i in range(6)]
    spark.createDataFrame(data, kinds).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(kinds).parquet(folder)
    plain = lambda rs: sorted(repr([None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v for v in r]) for r in rs)
    columns = ["k", "id", "x", "big", "_begins", "_stored", "_ts", "tags"]
    made = {
        "joined": stateful.join_lines(stream(), "_ts", "true", ["id"], ["k"], idle_ms=None),
        "latest": stateful.global_value(stream(), "false", F.col("x"), ["k"], ["id"], "latest"),
        "every": stateful.every_n(stream(), 1, {"n": F.lit(1)}, ["id"], ["k"]),
    }
    for name, df in made.items():
        want = data[:-1] if name == "joined" else data  # the last event waits
        assert plain(run(df, f"kept_{name}").select(columns).collect()) == plain(want)
    arrays = run(stateful.array_by_size(stream(), 6, ["id"], ["k"]), "kept_arrays").select(F.explode("rows").alias("r")).select("r.*")
    assert plain(arrays.collect()) == plain(data)
    nan = stateful.global_value(stream(), "id = 0", F.col("x"), ["k"], ["id"], "latest")
    assert all(math.isnan(r["latest"]) for r in run(nan, "kept_nan").collect())


def test_flow_counts(events):
    batch, stream = events
    tag = lambda d: d.withColumn("flows", F.array("event_type"))
    want = rows(keyed.flow_counts(tag(batch), "flows", "ts", "1 day"), "flow", "start", "n")
    got = rows(run(stateful.flow_counts(tag(stream()), "flows", "ts", "1 day"), "counts"), "flow", "start", "n")
    assert got and set(got) <= set(want)


def test_idle_sessions(events):
    batch, stream = events
    got = rows(run(stateful.idle_sessions(stream(), "event_type", "ts", "event_id", ["user_id"], "6 hours", "+"), "sessions"), "user_id", "out")
    want = keyed.join_lines(batch, "event_type", "false", ["event_id"], ["user_id"], "+", wait_ms=6 * 3_600_000 - 1, ts="ts")
    assert got and set(got) <= set(rows(want, "user_id", "out"))
