"""Queries of the routing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, route
from .registry import read, registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 10")
def filter_accept(spark, sf_dir):
    return route.accept(read(spark, sf_dir, "events"), "event_type = 'error' and value > 10").select("event_id", "user_id", "value")


@query("SELECT event_id, event_type, value FROM events WHERE NOT coalesce(value > 20 OR event_type = 'view', false)")
def filter_reject(spark, sf_dir):
    return route.reject(read(spark, sf_dir, "events"), "value > 20 or event_type = 'view'").select("event_id", "event_type", "value")


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND (value < 5 OR user_id % 7 = 0)")
def flow_enter(spark, sf_dir):
    origin, when = ["event_type = 'click'", "event_type = 'view'"], ["value < 5", "user_id % 7 = 0"]
    return route.enter(read(spark, sf_dir, "events"), origin, when).select("event_id")


FLOWS = {"errors": "event_type = 'error'", "large": "value >= 100", "even": "user_id % 2 = 0"}


@query(
    "SELECT 'errors' AS flow, event_id FROM events WHERE event_type = 'error' "
    "UNION ALL SELECT 'large', event_id FROM events WHERE value >= 100 "
    "UNION ALL SELECT 'even', event_id FROM events WHERE user_id % 2 = 0"
)
def route_fanout(spark, sf_dir):
    return route.fan_out(read(spark, sf_dir, "events"), FLOWS).select("flow", "event_id")


@query(
    "SELECT 'errors' AS flow, event_id FROM events WHERE event_type = 'error' "
    "UNION ALL SELECT 'large', event_id FROM events WHERE value >= 100 "
    "UNION ALL SELECT 'rest', event_id FROM events WHERE NOT (event_type = 'error' OR value >= 100)"
)
def route_default(spark, sf_dir):
    flows = {k: FLOWS[k] for k in ("errors", "large")}
    return route.fan_out(read(spark, sf_dir, "events"), flows, default="rest").select("flow", "event_id")


@query(
    "SELECT 'parent' AS flow, event_id, value * 2 AS doubled FROM events WHERE event_type <> 'view' "
    "UNION ALL SELECT 'big', event_id, value * 2 FROM events WHERE event_type <> 'view' AND value * 2 > 100 "
    "UNION ALL SELECT 'big/user', event_id, value * 2 FROM events WHERE event_type <> 'view' AND value * 2 > 100 AND user_id % 3 = 0"
)
def nested_flow(spark, sf_dir):
    children = {"big": {"when": "doubled > 100", "children": {"user": {"when": "user_id % 3 = 0"}}}}
    step = lambda d: d.withColumn("doubled", F.col("value") * 2)
    found = route.nested(read(spark, sf_dir, "events"), "event_type <> 'view'", [step], children)
    named = [d.select(F.lit(k or "parent").alias("flow"), "event_id", "doubled") for k, d in found.items()]
    return route.union_inputs(*named)


@query(
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN round(value * 1.21, 4) ELSE value END AS amount "
    "FROM events WHERE NOT (event_type = 'purchase' AND value < 1)"
)
def gate_bypass(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("amount"))
    tax = lambda d: d.withColumn("amount", F.round(F.col("amount") * 1.21, 4))
    out = route.gate(events, tax, "event_type = 'purchase'", "process", "bypass", then="amount >= 1.21")
    return out.select("event_id", "amount")


@query("SELECT event_id, value * 10 AS scaled FROM events WHERE event_type = 'signup' AND value * 10 < 500")
def gate_block(spark, sf_dir):
    scale = lambda d: d.withColumn("scaled", F.col("value") * 10)
    return route.gate(read(spark, sf_dir, "events"), scale, "event_type = 'signup'", then="scaled < 500").select("event_id", "scaled")


@query("SELECT event_id, CASE WHEN value > 50 THEN upper(event_type) ELSE event_type END AS event_type, CASE WHEN value > 50 THEN 'high' END AS band FROM events")
def gate_columns(spark, sf_dir):
    columns = {"event_type": F.upper("event_type"), "band": F.lit("high")}
    return route.gate_columns(read(spark, sf_dir, "events"), columns, "value > 50").select("event_id", "event_type", "band")


@query(
    "SELECT event_id, event_type, user_id FROM events WHERE (event_type IN ('click', 'purchase') AND value > 25) "
    "OR starts_with(event_type, 'sig') OR (regexp_matches(event_type, '^err') AND contains(props, '7')) OR (ends_with(event_type, 'w') AND user_id = 3)"
)
def doc_predicate(spark, sf_dir):
    document = {
        "$or": [
            {"$and": [{"event_type": {"$in": ["click", "purchase"]}}, {"value": {"$gt": 25}}]},
            {"event_type": {"$starts": "sig"}},
            {"event_type": {"$regex": "^err"}, "props": {"$contains": "7"}},
            {"event_type": {"$endsWith": "w"}, "$expr": "user_id = 3"},
        ]
    }
    return route.accept(read(spark, sf_dir, "events"), document).select("event_id", "event_type", "user_id")


@query(
    "SELECT 'alarms' AS flow, event_id FROM events WHERE (event_type = 'error' AND value > 30) OR event_type = 'signup' "
    "UNION ALL SELECT 'archive', event_id FROM events WHERE event_type = 'signup'"
)
def forward_flows(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    flows = {
        "signups": lambda d: route.accept(d, "event_type = 'signup'"),
        "errors": lambda d: route.accept(d, "event_type = 'error' and value > 30"),
        "alarms": lambda d: d,
        "archive": lambda d: d,
    }
    done = route.forward(flows, {"signups": ["alarms", "archive"], "errors": ["alarms"]}, {"signups": events, "errors": events})
    return route.union_inputs(*(done[k].select(F.lit(k).alias("flow"), "event_id") for k in ("alarms", "archive")))


@query(
    "SELECT 'event' AS kind, event_id AS id, user_id, NULL AS o_totalprice FROM events "
    "UNION ALL SELECT 'order', o_orderkey, NULL, o_totalprice FROM orders"
)
def union_inputs(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "user_id")
    orders = read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return route.union_inputs(events, orders)


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def placed_by_key(spark, sf_dir):
    placed = route.place(read(spark, sf_dir, "events"), 8, "expression", "user_id")
    return placed.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query(
    "SELECT 'events' AS input, 'table' AS type, 'events:table@' || event_type AS key, event_id FROM events"
)
def envelope_tag(spark, sf_dir):
    return enrich.envelope(read(spark, sf_dir, "events"), "events", "table", F.col("event_type")).select("input", "type", "key", "event_id")
