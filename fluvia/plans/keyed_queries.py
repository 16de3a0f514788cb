"""Queries of the keyed operators. Amounts are whole cents, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, extract, keyed, route
from .registry import read, registrar

QUERIES: dict = {}
query = registrar(QUERIES)


def _cents():
    return F.round(F.col("value") * 100).cast("long")


def flagship(spark, sf_dir):
    """Envelope, JSON extract with quarantine, accept filter, every tenth row of each user with sums."""
    tagged = enrich.envelope(read(spark, sf_dir, "events"), "events", "table", F.col("user_id"))
    good, _ = extract.quarantine(extract.json_extract(tagged, "props", "k bigint"))
    kept = route.accept(good, "event_type <> 'signup'")
    sums = {"n": F.lit(1), "cents": _cents(), "k": F.col("k")}
    out = keyed.every_n(kept, 10, sums, ["event_id"], ["user_id"])
    return out.select("input", "type", "key", "user_id", "event_id", "aggregate.n", "aggregate.cents", F.col("aggregate.k").alias("k"))


_EVERY = (
    "WITH m AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn "
    "FROM events WHERE event_type <> 'view'), g AS (SELECT *, {grp} AS grp FROM m), "
    "a AS (SELECT user_id, grp, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, max(event_id) AS event_id FROM g GROUP BY user_id, grp) "
    "SELECT user_id, event_id, n, cents FROM a WHERE {keep}"
)


def _every(spark, sf_dir, first):
    sums = {"n": F.lit(1), "cents": _cents()}
    out = keyed.every_n(read(spark, sf_dir, "events"), 10, sums, ["event_id"], ["user_id"], "event_type <> 'view'", first)
    return out.select("user_id", "event_id", "aggregate.n", "aggregate.cents")


@query(_EVERY.format(grp="ceil((rn - 1) / 10)", keep="n = 10 OR grp = 0"))
def every_n_first(spark, sf_dir):
    return _every(spark, sf_dir, True)


@query(_EVERY.format(grp="floor((rn - 1) / 10)", keep="n = 10"))
def every_n_nofirst(spark, sf_dir):
    return _every(spark, sf_dir, False)


@query(_EVERY.format(grp="ceil((rn - 1) / 10)", keep="n = 10 OR grp = 0"))
def every_n_spread(spark, sf_dir):
    sums = {"n": F.lit(1), "cents": _cents()}
    out = keyed.every_n(read(spark, sf_dir, "events"), 10, sums, ["event_id"], ["user_id"], "event_type <> 'view'", spread=True)
    return out.select("user_id", "event_id", "aggregate.n", "aggregate.cents")


@query(
    "WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE event_type <> 'signup'), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e), g AS (SELECT *, ceil((rn - 1) / 10) AS grp FROM m), "
    "a AS (SELECT user_id, grp, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, CAST(sum(k) AS BIGINT) AS k, max(event_id) AS event_id FROM g GROUP BY user_id, grp) "
    "SELECT 'events' AS input, 'table' AS type, 'events:table@' || user_id AS key, user_id, event_id, n, cents, k FROM a WHERE n = 10 OR grp = 0"
)
def every_n_pipeline(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, round(value * 100) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, "
    "count(*) OVER (PARTITION BY user_id) AS total FROM events), "
    "r AS (SELECT user_id, event_id, rn, total, false AS late, CAST(NULL AS BIGINT) AS old_head, CAST(0 AS DOUBLE) AS old_n, CAST(0 AS DOUBLE) AS old_c, true AS done, "
    "CAST(1 AS DOUBLE) AS done_n, CAST(c AS DOUBLE) AS done_c, event_id AS head, CAST(NULL AS BIGINT) AS since, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS cents FROM e WHERE rn = 1 "
    "UNION ALL SELECT user_id, event_id, rn, total, late, old_head, old_n, old_c, late OR old_n + 1 >= 10, CASE WHEN late THEN 1 ELSE old_n + 1 END, CASE WHEN late THEN c ELSE old_c + c END, "
    "CASE WHEN late THEN event_id ELSE old_head END, CASE WHEN late THEN NULL WHEN old_n + 1 >= 10 THEN since ELSE coalesce(since, ms) END, "
    "CASE WHEN late OR old_n + 1 >= 10 THEN 0 ELSE old_n + 1 END, CASE WHEN late OR old_n + 1 >= 10 THEN 0 ELSE old_c + c END "
    "FROM (SELECT e.*, coalesce(e.ms - r.since >= 21600000, false) AS late, r.head AS old_head, r.n AS old_n, r.cents AS old_c, r.since FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)) "
    "SELECT user_id, event_id, done_n AS n, done_c AS cents, false AS flushed FROM r WHERE done UNION ALL SELECT user_id, old_head, old_n, old_c, true FROM r WHERE late "
    "UNION ALL SELECT user_id, head, n, cents, true FROM r WHERE rn = total AND since IS NOT NULL AND n > 0"
)
def every_n_ttl_batch(spark, sf_dir):
    sums = {"n": F.lit(1), "cents": _cents()}
    out = keyed.every_n_ttl(read(spark, sf_dir, "events"), 10, 6 * 3600 * 1000, sums, ["event_id"], ["user_id"], "ts")
    return out.select("user_id", "event_id", "n", "cents", "flushed")


@query(
    "WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem) "
    "SELECT i // 1000 AS batch, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, string_agg(l_orderkey || '.' || l_linenumber, ',' ORDER BY i) AS keys FROM n GROUP BY i // 1000 HAVING count(*) = 1000"
)
def array_batch(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    made = keyed.array_by_size(read(spark, sf_dir, "lineitem").select(*order), 1000, order)
    keys = F.array_join(F.transform("rows", lambda r: F.concat_ws(".", r["l_orderkey"].cast("string"), r["l_linenumber"].cast("string"))), ",")
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["l_partkey"])
    return made.select("batch", F.size("rows").alias("n"), total.alias("parts"), keys.alias("keys"))


@query(
    "WITH w AS (SELECT event_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start FROM events), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY event_id) - 1 AS i FROM w) "
    "SELECT epoch_ms(start) AS start_ms, i // 50 AS batch, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM n GROUP BY start, i // 50"
)
def array_time(spark, sf_dir):
    made = keyed.array_by_time(read(spark, sf_dir, "events").select("event_id", "ts"), "6 hours", 50, "ts", ["event_id"])
    ids = F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",")
    return made.select(F.unix_millis("start").alias("start_ms"), "batch", F.size("rows").alias("n"), ids.alias("ids"))


@query(
    "WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations) "
    "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, string_agg(text, '|' ORDER BY turn) AS out FROM g GROUP BY conv_id, grp"
)
def joiner_turns(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return keyed.join_lines(turns, "text", "role = 'user'", ["turn"], ["conv_id"], "|").select("conv_id", "turn", "role", "out")


@query(
    "WITH l AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), "
    "g AS (SELECT *, sum(CASE WHEN event_type = 'signup' OR coalesce(epoch_us(ts) // 1000 - epoch_us(before) // 1000 > 14400000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM l), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id DESC) AS back FROM g) "
    "SELECT user_id, max(event_id) AS event_id, string_agg(event_type, '+' ORDER BY event_id) AS out FROM r WHERE back <= 3 GROUP BY user_id, grp"
)
def joiner_idle(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    out = keyed.join_lines(events, "event_type", "event_type = 'signup'", ["event_id"], ["user_id"], "+", most=3, wait_ms=4 * 3600 * 1000, ts="ts")
    return out.select("user_id", "event_id", "out")


@query("SELECT user_id, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY user_id")
def xml_assemble(spark, sf_dir):
    """Each event as three rows that together hold one element."""
    pieces = F.array(F.concat(F.lit('<ev id="'), F.col("event_id").cast("string"), F.lit('"')), F.lit("><k>x</k>"), F.lit("</ev>"))
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.posexplode(pieces).alias("part", "text"))
    found = keyed.assemble_xml(rows, "text", "ev", ["event_id", "part"], ["user_id"])
    ids = F.regexp_extract("xml", r'id="(\d+)"', 1).cast("long")
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(ids).alias("ids"))


@query(
    "WITH f AS (SELECT 'errors' AS flow, ts FROM events WHERE event_type = 'error' UNION ALL SELECT 'large', ts FROM events WHERE value >= 100 UNION ALL SELECT 'even', ts FROM events WHERE user_id % 2 = 0) "
    "SELECT flow, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_ms, count(*) AS n FROM f GROUP BY flow, start_ms"
)
def flow_stats(spark, sf_dir):
    flows = {"errors": "event_type = 'error'", "large": "value >= 100", "even": "user_id % 2 = 0"}
    tagged = route.flows_column(read(spark, sf_dir, "events"), flows)
    return keyed.flow_counts(tagged, "flows", "ts", "1 hour").select("flow", F.unix_millis("start").alias("start_ms"), "n")


@query(
    "WITH w AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) "
    "SELECT user_id, event_id, CAST(n AS DOUBLE) AS window_value FROM w WHERE n >= 4"
)
def window_threshold(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return keyed.window_alert(events, 4, ["user_id"], "ts", ["event_id"], time="12 hours").select("user_id", "event_id", "window_value")


@query(
    "WITH w AS (SELECT user_id, event_id, sum(round(value * 100)) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) AS s FROM events) "
    "SELECT user_id, event_id, s AS window_value FROM w WHERE s >= 40000"
)
def window_size_threshold(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return keyed.window_alert(events, 40000, ["user_id"], "ts", ["event_id"], size=5, amount=_cents()).select("user_id", "event_id", "window_value")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), "
    "r AS (SELECT user_id, event_id, rn, [us] AS w FROM e WHERE rn = 1 UNION ALL "
    "SELECT e.user_id, e.event_id, e.rn, list_append(list_filter(CASE WHEN len(r.w) >= 4 THEN [] ELSE r.w END, lambda x: x >= e.us - 43200000000), e.us) "
    "FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) "
    "SELECT user_id, event_id, CAST(len(w) AS DOUBLE) AS window_value FROM r WHERE len(w) >= 4"
)
def window_reset(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return keyed.window_alert(events, 4, ["user_id"], "ts", ["event_id"], time="12 hours", size=100, reset=True).select("user_id", "event_id", "window_value")


@query(
    "WITH w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error'), "
    "v AS (SELECT *, sum(round(value * 100)) OVER (PARTITION BY event_type ORDER BY event_id ROWS 9 PRECEDING) AS s FROM events) "
    "SELECT 'burst' AS rule, CAST(event_id AS BIGINT) AS event_id, CAST(n AS DOUBLE) AS window_value FROM w WHERE n >= 3 UNION ALL SELECT 'spend', event_id, s FROM v WHERE s >= 70000"
)
def rule_alerts(spark, sf_dir):
    specs = {
        "burst": {"when": "event_type = 'error'", "key": ["user_id"], "threshold": 3, "time": "24 hours"},
        "spend": {"key": ["event_type"], "threshold": 70000, "size": 10, "amount": _cents()},
    }
    found = keyed.rules(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value"), specs, "ts", ["event_id"])
    return found.select("rule", F.get_json_object("alert", "$.event_id").cast("long").alias("event_id"), "window_value")


@query(
    "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, CAST(ceil((epoch_us(ts) // 1000) / 300000.0) AS BIGINT) * 300000 AS k FROM events) "
    "SELECT event_id, 300000 * n + max(k - 300000 * n) OVER (ORDER BY n) AS release_ms FROM e"
)
def throttle_release(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "ts")
    return keyed.throttle(events, 300_000, "ts", ["event_id"]).select("event_id", "release_ms")
