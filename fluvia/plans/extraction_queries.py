"""Queries of the extractors, on text columns of the tables and on lines rendered from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, ruleset
from ..operators.ranges import row_number_by_key
from .registry import BLOB, read, registrar

QUERIES: dict = {}
query = registrar(QUERIES)


def _text(name: str):
    return F.col(name).cast("string")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return extract.json_extract(read(spark, sf_dir, "events"), "props", "k bigint").select("event_id", "k")


@query(
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, length(props) - 2) ELSE props END AS props FROM events) "
    "SELECT event_id, json_valid(props) AS good, CASE WHEN json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, "
    "CASE WHEN NOT json_valid(props) THEN props END AS _error FROM t"
)
def json_quarantine(spark, sf_dir):
    short = F.when(F.col("event_id") % 10 == 0, F.left(F.col("props"), F.length("props") - 2)).otherwise(F.col("props"))
    events = read(spark, sf_dir, "events").select("event_id", short.alias("props"))
    good, bad = extract.quarantine(extract.json_extract(events, "props", "k bigint"))
    left = good.select("event_id", F.lit(True).alias("good"), "k", F.lit(None).cast("string").alias("_error"))
    return left.unionByName(bad.select("event_id", F.lit(False).alias("good"), "k", "_error"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_variant(spark, sf_dir):
    parsed = extract.json_variant(read(spark, sf_dir, "events"), "props", "v")
    return parsed.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("SELECT event_id, user_id AS usr, event_type AS first, upper(event_type) AS second FROM events")
def json_unpack(spark, sf_dir):
    flat = F.create_map(
        F.lit("user.id"), _text("user_id"), F.lit("tags.0"), F.col("event_type"), F.lit("tags.1"), F.upper("event_type")
    )
    events = read(spark, sf_dir, "events").select("event_id", flat.alias("m"))
    nested = extract.unpack_dotted(events, "m", {"user": {"id": None}, "tags": [None, None]}, "n")
    return nested.select("event_id", F.col("n.user.id").cast("long").alias("usr"), F.col("n.tags")[0].alias("first"), F.col("n.tags")[1].alias("second"))


@query("SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def csv_extract(spark, sf_dir):
    line = F.concat(F.lit('"'), "c_name", F.lit('",'), _text("c_nationkey"), F.lit(", "), "c_mktsegment")
    rows = read(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    options = {"ignoreLeadingWhiteSpace": "true"}
    return extract.csv_extract(rows, "line", "name string, nation int, segment string", options=options).select("c_custkey", "name", "nation", "segment")


@query("SELECT c_custkey, c_name AS name, c_mktsegment || ' x=y' AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def kv_extract(spark, sf_dir):
    line = F.concat(F.lit("name="), "c_name", F.lit(' segment="'), "c_mktsegment", F.lit(' x=y" nation=0 junk nation='), _text("c_nationkey"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    return extract.keyval_extract(rows, "line", fields=["name", "segment", "nation"]).select("c_custkey", "name", "segment", "nation")


@query(
    "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/(\\d+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/(\\d+)', 2) AS host, "
    "regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/(\\d+)', 3) AS lang, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/(\\d+)', 4) AS \"3\" "
    "FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/([a-z]{2})/(\\d+)')"
)
def regex_extract(spark, sf_dir):
    found = extract.regex_extract(read(spark, sf_dir, "pages"), "url", r"^(https?)://([^/]+)/([a-z]{2})/(\d+)", ["scheme", "host", "lang"])
    return found.filter(F.col("scheme").isNotNull()).select("page_id", "scheme", "host", "lang", "3")


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT w) AS distinct_n FROM w GROUP BY doc_id")
def split_item(spark, sf_dir):
    words = extract.split_rows(read(spark, sf_dir, "documents"), "text", " ", "w")
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("w").alias("distinct_n"))


@query("SELECT page_id, string_split(url, '/')[1] AS scheme, string_split(url, '/')[3] AS host, string_split(url, '/')[9] AS deep FROM pages")
def split_map(spark, sf_dir):
    names = ["scheme", "gap", "host", "lang", "x5", "x6", "x7", "x8", "deep"]
    return extract.split_columns(read(spark, sf_dir, "pages"), "url", "/", names).select("page_id", "scheme", "host", "deep")


@query("SELECT p_partkey, string_split(p_name, ' ') AS words FROM part")
def split_array(spark, sf_dir):
    return extract.split_array(read(spark, sf_dir, "part"), "p_name", " ", "words").select("p_partkey", "words")


@query(
    "SELECT event_id, 'RFC5424' AS type, CAST(8 * (16 + user_id % 8) + event_id % 8 AS INTEGER) AS prival, CAST(16 + user_id % 8 AS INTEGER) AS facilityval, "
    "CAST(event_id % 8 AS INTEGER) AS levelval, 'local' || user_id % 8 AS facility, 1 AS version, 'host' || user_id AS host, 'app' AS app_name, "
    "CAST(event_id AS VARCHAR) AS pid, NULL AS messageid, event_type || ' done' AS message, 'k@1' AS sd_id, 'a \"q\" ]' AS sd_value FROM events"
)
def syslog_rfc5424(spark, sf_dir):
    pri = (8 * (16 + F.col("user_id") % 8) + F.col("event_id") % 8).cast("string")
    parts = ["<", pri, ">1 2024-01-01T00:00:00Z host", _text("user_id"), " app ", _text("event_id"), ' - [k@1 v="a \\"q\\" \\]"][z@2] ', F.col("event_type"), " done"]
    line = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rows = extract.syslog_extract(read(spark, sf_dir, "events").select("event_id", line.alias("line")), "line")
    names = ("type", "prival", "facilityval", "levelval", "facility", "version", "host", "app_name", "pid", "messageid", "message")
    sd = F.col("syslog.structured_data")[0]
    return rows.select("event_id", *(F.col(f"syslog.{n}").alias(n) for n in names), sd["$id"].alias("sd_id"), sd["v"].alias("sd_value"))


@query(
    "SELECT event_id, 'BSD' AS type, CAST(8 + event_id % 8 AS INTEGER) AS prival, strftime(ts, '%b %d %H:%M:%S') AS ts, 'h' || user_id AS host, "
    "'sshd' AS app_name, CAST(event_id AS VARCHAR) AS pid, event_type || ': ok' AS message FROM events"
)
def syslog_bsd(spark, sf_dir):
    parts = ["<", (8 + F.col("event_id") % 8).cast("string"), ">", F.date_format("ts", "MMM dd HH:mm:ss"), " h", _text("user_id"), " sshd[", _text("event_id"), "]: ", F.col("event_type"), ": ok"]
    line = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rows = extract.syslog_extract(read(spark, sf_dir, "events").select("event_id", line.alias("line")), "line")
    return rows.select("event_id", *(F.col(f"syslog.{n}").alias(n) for n in ("type", "prival", "ts", "host", "app_name", "pid", "message")))


@query(
    "SELECT event_id, 'CEF' AS type, 'acme' AS vendor, event_type AS name, '5' AS severity, 'u' || user_id || ' x' AS usr, '' AS nothing, 'a=b' AS url FROM events"
)
def syslog_cef(spark, sf_dir):
    parts = ["CEF:0|acme|web|1|7|", F.col("event_type"), "|5|usr=u", _text("user_id"), " x nothing= url=a=b"]
    line = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rows = extract.syslog_extract(read(spark, sf_dir, "events").select("event_id", line.alias("line")), "line")
    fields, cef = F.col("syslog.fields"), F.col("syslog.cef")
    return rows.select("event_id", F.col("syslog.type").alias("type"), cef["device_vendor"].alias("vendor"), cef["name"].alias("name"), cef["severity"].alias("severity"), fields["usr"].alias("usr"), fields["nothing"].alias("nothing"), fields["url"].alias("url"))


def _xml_events(spark, sf_dir, columns: tuple[str, ...]):
    parts = [
        '<Event><System><Provider Name="p"/><EventID Qualifiers="', _text("user_id"), '">', _text("event_id"),
        '</EventID><TimeCreated SystemTime="2024-01-01T00:00:00Z"/><Channel>', F.col("event_type"), "</Channel><Computer>c1</Computer></System>",
        '<EventData><Data Name="kind">', F.col("event_type"), "</Data><Data>extra</Data></EventData></Event>",
    ]
    xml = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return read(spark, sf_dir, "events").select(*columns, xml.alias("xml"))


@query(
    "SELECT event_id, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS qualifiers, '2024-01-01T00:00:00Z' AS time, event_type AS channel, event_type AS kind, 'extra' AS item1 FROM events"
)
def winevt_extract(spark, sf_dir):
    rows = extract.winevt_extract(_xml_events(spark, sf_dir, ("event_id",)), "xml")
    e = F.col("event")
    return rows.select("event_id", e["System"]["EventID"].alias("id"), e["System"]["Qualifiers"].alias("qualifiers"), e["SystemTime"].alias("time"), e["System"]["Channel"].alias("channel"), e["Data"]["kind"].alias("kind"), e["Data"]["1"].alias("item1"))


@query("SELECT user_id, count(*) AS n, sum(event_id) AS ids, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def xml_tags(spark, sf_dir):
    one = F.concat(F.lit('junk <ev id="'), _text("event_id"), F.lit('"><kind>'), "event_type", F.lit("</kind></ev> "))
    events = row_number_by_key(read(spark, sf_dir, "events").select("user_id", "event_id", one.alias("one")), ["user_id"], ["event_id"], "_at")
    part = F.floor((F.col("_at") - 1) / BLOB).alias("_part")
    texts = events.groupBy("user_id", part).agg(F.array_join(F.collect_list("one"), "").alias("text")).drop("_part")
    rows = extract.xml_rows(texts, "text", "id bigint, kind string", "ev")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count_distinct("kind").alias("kinds"))


@query("SELECT event_id, 2 AS n, event_id AS first_id, event_type AS second_kind FROM events")
def xml_array(spark, sf_dir):
    text = F.concat(F.lit('<ev id="'), _text("event_id"), F.lit('"><kind>a</kind></ev>x<ev id="0"><kind>'), "event_type", F.lit("</kind></ev>"))
    rows = extract.xml_extract(read(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", "id bigint, kind string", "evs", tag="ev")
    return rows.select("event_id", F.size("evs").alias("n"), F.col("evs")[0]["id"].alias("first_id"), F.col("evs")[1]["kind"].alias("second_kind"))


def _order_lines(spark, sf_dir):
    parts = ["<13> ", F.date_format("o_orderdate", "yyyy-MM-dd"), " key", _text("o_orderkey"), " - status=", F.col("o_orderstatus"), " prio ", F.col("o_orderpriority")]
    line = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


#: A rule set over lines of orders: the key, then the priority behind whatever comes between; finished orders go.
ORDER_RULES = [
    {"re": r" key(?<order>[0-9]+)", "dst": "state"},
    {"src": "state", "re": r"status=F", "reject": True},
    {"src": "state", "re": r"status=(?<letter>[A-Z])", "dst": "tail"},
    {"src": "tail", "re": r"(?<rank>[1-5])-(?<rest>[A-Z ]+)"},
]


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS \"order\", o_orderstatus AS letter, left(o_orderpriority, 1) AS rank, substr(o_orderpriority, 3) AS rest FROM orders WHERE o_orderstatus <> 'F'")
def ruleset_inline(spark, sf_dir):
    found = ruleset.as_map(ruleset.extract_fold(_order_lines(spark, sf_dir), "line", ruleset.inline(ORDER_RULES)), "parsed")
    return found.select("o_orderkey", *(F.col("parsed")[n].alias(n) for n in ("order", "letter", "rank", "rest")))


RULES = {
    "start": [{"regex": r"(\d{4}-\d{2}-\d{2}) (\S+)", "name": ["day", "res"], "next": "status"}],
    "status": [{"regex": r"status=(\w)", "name": "status", "next": "prio"}],
    "prio": [{"regex": r"prio (\d)-(.*)$", "name": ["level", "label"], "next": "end"}],
}


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'key' || o_orderkey AS res, o_orderstatus AS status, left(o_orderpriority, 1) AS level, substr(o_orderpriority, 3) AS label FROM orders")
def ruleset_native(spark, sf_dir):
    rules = ruleset.from_document(RULES)
    return ruleset.extract_native(_order_lines(spark, sf_dir), "line", rules, "p").select("o_orderkey", "p.*")


@query(
    "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open:' || o_orderstatus END AS state "
    "FROM orders WHERE o_orderpriority NOT LIKE '1-%'"
)
def ruleset_reject(spark, sf_dir):
    rules = ruleset.from_document(
        {
            "start": [{"regex": r"prio 1-", "reject": True}, {"regex": r"status=", "next": "status"}],
            "status": [
                {"regex": r"^(F)", "name": "status", "next": "end", "set": [{"key": "state", "value": "closed"}]},
                {"regex": r"^(\w)", "name": "status", "next": "end", "set": [{"key": "state", "value": "open:${status}"}]},
            ],
            "end": [{"regex": r".*$"}],
        }
    )
    found = ruleset.as_map(ruleset.extract(_order_lines(spark, sf_dir), "line", rules), "parsed")
    return found.select("o_orderkey", F.col("parsed")["status"].alias("status"), F.col("parsed")["state"].alias("state"))


@query(
    "WITH n AS (SELECT count(*) AS n, count(DISTINCT user_id % 250) AS hosts, count(DISTINCT event_id) AS ids, count(DISTINCT event_type) AS types FROM events) "
    "SELECT unnest(['token.timestamp', 'keyword.language', 'keyword.operator', 'constant.comment', 'keyword.comment', 'param.key', 'param.value']) AS name, n, "
    "unnest([1, 1, hosts, 1, ids, 1, types]) AS kinds FROM n"
)
def token_census(spark, sf_dir):
    """Tokens of each kind over log lines, by the general rule set."""
    parts = ["2024-01-12 06:30:00 [web] GET /p/", _text("user_id"), " from 10.0.0.", (F.col("user_id") % 250).cast("string"), ":80 took ", _text("event_id"), "ms ERROR: kind=", F.col("event_type")]
    line = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rows = read(spark, sf_dir, "events").select(line.alias("line"))
    found = ruleset.extract(rows, "line", ruleset.from_document(ruleset.GENERIC))
    return found.select(F.explode("parsed").alias("p")).groupBy(F.col("p.name").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("p.value").alias("kinds"))


@query("WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) SELECT w AS word, count(*) AS n FROM w WHERE w <> '' GROUP BY w")
def bolt_words(spark, sf_dir):
    from ..operators.custom import bolt

    def split(row: dict) -> list[dict]:
        return [{"word": w} for w in (row["text"] or "").lower().split(" ") if w]

    words = bolt(read(spark, sf_dir, "documents").select("text"), split, "word string")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events")
def bolt_grouped(spark, sf_dir):
    from ..operators.custom import bolt

    class Counter:
        def __init__(self) -> None:
            self.seen: dict[int, int] = {}

        def __call__(self, row: dict) -> list[dict]:
            n = self.seen[row["user_id"]] = self.seen.get(row["user_id"], 0) + 1
            return [{"user_id": row["user_id"], "event_id": row["event_id"], "seen": n}]

    events = read(spark, sf_dir, "events").select("user_id", "event_id")
    return bolt(events, Counter, "user_id long, event_id long, seen long", wire="group", key=["user_id"], order_by=["event_id"], fresh=True)
