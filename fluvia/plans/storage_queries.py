"""Queries that write to the shared folder through the sinks and read back through the sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import enrich, ruleset
from ..sinks import writers
from ..sources import numbered, readers, splits
from .registry import read, registrar

QUERIES: dict = {}
query = registrar(QUERIES)


def _line():
    return F.concat_ws(",", F.col("event_id").cast("string"), F.col("event_type"))


def _event_files(spark, sf_dir):
    """Events as text in files that follow one another by id; the folder."""
    path = writers.scratch(spark, "lines")
    ordered = read(spark, sf_dir, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.select(_line().alias("value")).write.text(path)
    return path


@query(
    "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS n, CAST(coalesce(sum(strlen(event_id || ',' || event_type) + 1) "
    "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM events"
)
def numbered_lines(spark, sf_dir):
    """Line numbers and byte offsets of many files, as if they were one."""
    rows = numbered.numbered_lines(spark, _event_files(spark, sf_dir))
    totals = rows.groupBy("filename").agg(F.max("ln").alias("lines"), F.max("size").alias("bytes"))
    earlier = Window.orderBy("filename").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = totals.select("filename", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("lines", "bytes")))
    event = F.split_part(numbered.text_of(), F.lit(","), F.lit(1)).cast("long")
    return rows.join(before, "filename").select(event.alias("event_id"), (F.col("ln") + F.col("lines")).alias("n"), (F.col("offset") + F.col("bytes")).alias("at"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 >= 3")
def tailed_lines(spark, sf_dir):
    """What files have beyond their marks: the lines of the first three of ten events are marked as read."""
    path = writers.scratch(spark, "lines")
    rows = read(spark, sf_dir, "events").withColumn("late", F.col("event_id") % 10 >= 3)
    rows.repartition("user_id").sortWithinPartitions("late").select(_line().alias("value")).write.text(path)
    known = numbered.numbered_lines(spark, path).withColumn("id", F.split_part(numbered.text_of(), F.lit(","), F.lit(1)).cast("long"))
    old = known.withColumn("end", F.col("offset") + F.octet_length("value") + 1).filter("id % 10 < 3")
    marks = old.groupBy("path").agg(F.max("end").alias("offset"), F.max("ln").alias("ln"))
    fresh, _ = numbered.tail(spark, path, marks)
    parts = F.split("original_message", ",")
    return fresh.select(parts[0].cast("long").alias("event_id"), parts[1].alias("event_type"))


@query("SELECT event_type, user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type NOT IN ('view', 'error') GROUP BY event_type, user_id")
def routed_and_excluded(spark, sf_dir):
    """Lines routed to folders by type, read back without two of them."""
    path = writers.scratch(spark, "routed")
    route = {"kind": F.col("event_type")}
    writers.routed_files(read(spark, sf_dir, "events"), path, route, F.concat_ws(",", F.col("event_id"), F.col("user_id")))
    rows = readers.lines(spark, f"{path}/*/*.txt", exclude=["*/kind=view/*", "*/kind=error/*"])
    parts = F.split("original_message", ",")
    each = rows.select(F.regexp_extract("path", "kind=([^/]+)", 1).alias("event_type"), parts[1].cast("long").alias("user_id"), parts[0].cast("long").alias("id"))
    return each.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 7 AS INTEGER) AS partition FROM events")
def topic_round_robin(spark, sf_dir):
    return writers.topic_partition(read(spark, sf_dir, "events"), 7, "roundrobin", order_by=["event_id"]).select("event_id", "partition")


@query("SELECT event_type AS collection, event_id % 3 AS batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")
def collections_retried(spark, sf_dir):
    """Three batches into collections, each written twice, as after a failure."""
    path, events = writers.scratch(spark, "collections"), read(spark, sf_dir, "events")
    for i in (0, 1, 1, 2, 0, 2):
        batch = events.filter(F.col("event_id") % 3 == i).withColumn("$note", F.lit(1))
        writers.collections(batch, path, F.col("event_type"), batch_id=i)
    kept = spark.read.parquet(path)
    if "$note" in kept.columns:
        raise AssertionError("a column with $ was written")
    return kept.groupBy("collection", F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT sink, event_type, count(*) AS n FROM events, (VALUES ('a'), ('b')) AS s(sink) GROUP BY sink, event_type")
def parallel_sinks(spark, sf_dir):
    """One batch to two sinks at once."""
    paths = {s: writers.scratch(spark, f"sink-{s}") for s in "ab"}
    sinks = [lambda df, p=p: df.write.parquet(p) for p in paths.values()]
    writers.all_of(sinks)(read(spark, sf_dir, "events").select("event_type"))
    each = [spark.read.parquet(p).withColumn("sink", F.lit(s)) for s, p in paths.items()]
    return each[0].unionByName(each[1]).groupBy("sink", "event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE value >= 100) AS BIGINT) AS large FROM events")
def stage_counts(spark, sf_dir):
    """Counters of a stage, seen while its rows are written."""
    counted, seen = writers.counted(read(spark, sf_dir, "events"), "stage", errors=F.col("event_type") == "error", large=F.col("value") >= 100)
    writers.null(counted)
    return spark.createDataFrame([tuple(seen.get[k] for k in ("rows", "errors", "large"))], "rows long, errors long, large long")


@query(
    "SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)] AS nums, [o_orderstatus] AS status, ['nums', 'status'] AS names FROM orders"
)
def parsed_lists(spark, sf_dir):
    """All values of each name that a rule set finds."""
    rules = ruleset.from_document({"start": [{"name": "nums", "regex": r"(\d+) "}, {"name": "nums", "regex": r"(\d+);"}, {"name": "status", "regex": r"([A-Z])$"}]})
    line = F.concat(F.col("o_custkey").cast("string"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(";"), F.col("o_orderstatus"))
    made = ruleset.as_map(ruleset.extract(read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"), "o_custkey", "o_orderstatus"), "line", rules), "parsed", single=False)
    return made.select("o_orderkey", F.col("parsed")["nums"].alias("nums"), F.col("parsed")["status"].alias("status"), F.array_sort(F.map_keys("parsed")).alias("names"))


@query(
    "SELECT 'orders_2' AS collection, o_orderkey AS id FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders) UNION ALL SELECT 'orders_3', o_orderkey FROM orders"
)
def pulled_tables(spark, sf_dir):
    """All tables that match a pattern, each above its own mark."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    middle = orders.agg(F.expr("max(id) div 2")).first()[0]
    found, _ = readers.pull_tables({"orders_2": orders, "orders_3": orders, "other": orders}, "^orders_", "id", {"orders_2": readers.Mark(middle)})
    return found.select("collection", "id")


@query("SELECT o_orderkey, o_orderkey // 1000 AS part, o_orderkey * o_orderkey AS square FROM orders")
def split_source(spark, sf_dir):
    """A source of one's own, in parts of a thousand numbers up to the largest key, joined with the keys."""

    def parts(options):
        return list(range(int(options["most"]) // 1000 + 1))

    def numbers(part, options):
        for i in range(part * 1000, (part + 1) * 1000):
            yield i, part, i * i

    splits.register(spark, "fluvia_squares", "o_orderkey long, part long, square long", parts, numbers)
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    most = orders.agg(F.max("o_orderkey")).first()[0] or 0
    return orders.join(spark.read.format("fluvia_squares").option("most", most).load(), "o_orderkey")


@query(
    "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN round(value * 100) END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS latest "
    "FROM events QUALIFY event_type <> 'signup'"
)
def latest_of_all(spark, sf_dir):
    """The latest stored value without keys, by ranges."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.round(F.col("value") * 100).alias("cents"))
    stored = events.filter("event_type = 'signup'").select("event_id", "cents")
    return enrich.global_value(events.filter("event_type <> 'signup'"), stored, "event_id", "cents", "latest").select("event_id", "latest")
