"""Queries of projections, enrichment, output columns, sources and sinks' columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import enrich
from ..operators.ranges import row_number_by_key
from ..sinks import writers
from ..sources import readers
from .registry import BLOB, read, registrar

QUERIES: dict = {}
query = registrar(QUERIES)


@query(
    "SELECT event_id, upper(event_type) AS event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'log' AS origin FROM events"
)
def set_delete(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"), "value", "user_id")
    fields = {"event_type": F.upper("event_type"), "origin": F.lit("log"), "k": F.col("p.k")}
    return enrich.delete_fields(enrich.set_fields(events, fields), ["value", "user_id", "p"])


@query(
    "SELECT event_id, user_id AS a_user, value AS a_value, event_type AS a_kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS a_k FROM events"
)
def merge_deep(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(
        "event_id",
        F.struct("user_id", F.struct(F.col("value"), F.lit("old").alias("kind")).alias("in")).alias("a"),
        F.struct(F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k bigint")["k"].alias("k")).alias("in")).alias("b"),
    )
    merged = enrich.merge(events, ["a", "b"], "m", deep=True, delete=["a", "b"])
    return merged.select("event_id", F.col("m.user_id").alias("a_user"), F.col("m.in.value").alias("a_value"), F.col("m.in.kind").alias("a_kind"), F.col("m.in.k").alias("a_k"))


@query("SELECT event_id, event_type AS kind, 'b' AS origin, CAST(user_id AS VARCHAR) AS usr, '{}' IS NULL AS never FROM events")
def merge_maps(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    events = read(spark, sf_dir, "events").select(
        "event_id",
        F.create_map(F.lit("kind"), F.lit("none"), F.lit("origin"), F.lit("a"), F.lit("usr"), text("user_id")).alias("x"),
        F.create_map(F.lit("origin"), F.lit("b"), F.lit("kind"), text("event_type")).alias("y"),
    )
    merged = enrich.merge(events, ["x", "y"], "m", delete=["x", "y"])
    return merged.select("event_id", *(F.col("m")[k].alias(k) for k in ("kind", "origin", "usr")), F.lit(False).alias("never"))


@query("SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders")
def sequence(spark, sf_dir):
    return enrich.sequence(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], start=100).select("o_orderkey", "seq")


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_ms(date_trunc('second', ts)) AS parsed_ms FROM events")
def timestamp_unix(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    texts = events.withColumn("t", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    parsed = enrich.timestamp(texts, "parsed_ms", F.col("t"), "YYYY/MM/DD HH:mm:ss", unix=True)
    return parsed.select("event_id", F.unix_millis("ts").alias("ms"), "parsed_ms")


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d/%m/%y') AS short, "
    "strftime(o_orderdate, '%Y.%m') || 'w' AS month FROM orders"
)
def dateformat_multi(spark, sf_dir):
    formats = {"day": "YYYY-MM-DD", "short": "DD/MM/YY", "month": "YYYY.MM[w]"}
    return enrich.date_formats(read(spark, sf_dir, "orders"), F.col("o_orderdate"), formats).select("o_orderkey", *formats)


@query(
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'E' WHEN 'click' THEN 'C' ELSE 'other' END AS code, coalesce(n_name, CAST(user_id AS VARCHAR)) AS label "
    "FROM events LEFT JOIN nation ON n_nationkey = user_id"
)
def translate_star(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    coded = enrich.translate(events, {"event_type": "code"}, {"error": "E", "click": "C", "*": "other"})
    return enrich.translate(coded, {"user_id": "label"}, nations).select("event_id", "code", "label")


@query(
    "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER "
    "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latest FROM events"
)
def global_asof(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    stored = events.filter("event_type = 'signup'").select("user_id", "event_id", "value")
    return enrich.global_value(events.select("user_id", "event_id"), stored, "event_id", "value", "latest", ["user_id"]).select("event_id", "latest")


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS who, {'key': c_custkey, 'segment': lower(c_mktsegment)}.segment AS segment FROM customer")
def template_project(spark, sf_dir):
    fields = {"c_custkey": "c_custkey", "who": F.concat_ws("/", "c_name", "c_mktsegment"), "segment": "lower(c_mktsegment)"}
    return enrich.template(read(spark, sf_dir, "customer"), fields)


@query("SELECT c_custkey, '{\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' AS json FROM customer")
def row_json(spark, sf_dir):
    return enrich.row_json(read(spark, sf_dir, "customer"), fields=["c_name", "c_nationkey"]).select("c_custkey", "json")


@query("SELECT c_custkey, c_name || ';' || c_nationkey || ';' || lower(c_mktsegment) || chr(10) AS line FROM customer")
def csvout(spark, sf_dir):
    fields = [F.col("c_name"), "c_nationkey", "lower(c_mktsegment)"]
    out = enrich.csv_out(read(spark, sf_dir, "customer"), fields, "line", {"sep": ";"}, newline=True)
    return out.select("c_custkey", "line")


@query(
    "SELECT event_id, 'CEF:0|acme|weblog|1.0|' || event_type || '|localdomain|' || (CASE WHEN value > 100 THEN '8' ELSE '3' END) || '|user=' || user_id || "
    "' detail.kind=' || event_type || ' tags.0=' || user_id % 3 || ' tags.1=t' AS cef FROM events"
)
def cefout(spark, sf_dir):
    body = F.struct(
        F.col("user_id").alias("user"),
        F.struct(F.col("event_type").alias("kind"), F.lit(" ").alias("blank")).alias("detail"),
        F.array((F.col("user_id") % 3).cast("string"), F.lit("t")).alias("tags"),
        F.lit("hidden").alias("Name"),
    )
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value", body.alias("body"))
    headers = {"DeviceVendor": "acme", "DeviceProduct": "weblog", "DeviceVersion": "1.0", "SignatureID": F.col("event_type"), "Severity": F.when(F.col("value") > 100, "8").otherwise("3")}
    return enrich.cef_out(events, "body", "cef", headers).select("event_id", "cef")


@query(
    "SELECT event_id, '<' || (16 * 8 + CASE WHEN event_type = 'error' THEN 3 ELSE 6 END) || '>' || strftime(ts, '%b ') || "
    "CAST(day(ts) AS VARCHAR) || strftime(ts, ' %H:%M:%S') || ' host' || user_id % 5 || ' app: ' || event_type AS line FROM events"
)
def syslog_line(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").otherwise("6")
    host = F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string"))
    return enrich.syslog_line(events, F.col("event_type"), F.col("ts"), host, F.lit("app"), "local0", level).select("event_id", "line")


@query("SELECT doc_id, sha256(text) AS hex, md5(text) AS md FROM documents")
def digest_hex(spark, sf_dir):
    hexed = enrich.digest(read(spark, sf_dir, "documents"), F.col("text"), "hex", "sha256", "hex")
    return enrich.digest(hexed, F.col("text"), "md", "md5", "hex").select("doc_id", "hex", "md")


@query("SELECT doc_id, base64(unhex(sha256(text))) AS b64 FROM documents")
def digest_b64(spark, sf_dir):
    return enrich.digest(read(spark, sf_dir, "documents"), F.col("text"), "b64").select("doc_id", "b64")


@query("SELECT c_custkey, c_name AS plain, true AS framed FROM customer")
def aes_roundtrip(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sealed = enrich.encrypt(customers, F.col("c_name"), F.sha2(F.col("c_custkey").cast("string"), 256), "sealed")
    opened = enrich.decrypt(sealed, F.col("sealed"), F.sha2(F.col("c_custkey").cast("string"), 256), "plain")
    return opened.select("c_custkey", "plain", F.rlike("sealed", F.lit("^[0-9a-f]{32}:[0-9a-f]{32,}$")).alias("framed"))


@query(
    "SELECT p_partkey, starts_with(p_name, 'red') AS is_red, p_name LIKE '%bolt' AS is_bolt, contains(p_type, 'ON') AS has_on, "
    "regexp_matches(p_brand, '[0-4]$') AS low, replace(p_name, ' ', '_') AS slug, strpos(p_name, ' ') - 1 AS at, "
    "substr(p_name, 1, strpos(p_name, ' ') - 1) AS head, substr(p_name, strpos(p_name, ' ') + 1) AS rest, trim(p_name, 'rb') AS trimmed, "
    "len(string_split(p_name, ' ')) AS words, upper(string_split(p_name, ' ')[2]) AS second, round(p_retailprice / 1024, 6) AS kilo FROM part"
)
def expressions(spark, sf_dir):
    name, at = F.col("p_name"), fn.index_of(F.col("p_name"), " ")
    pieces = fn.split_literal(name, " ")
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        fn.starts_with(name, "red").alias("is_red"),
        fn.ends_with(name, "bolt").alias("is_bolt"),
        fn.contains(F.col("p_type"), "ON").alias("has_on"),
        fn.test_regex(F.col("p_brand"), "[0-4]$").alias("low"),
        fn.replace_all(name, " ", "_").alias("slug"),
        at.alias("at"),
        fn.substr(name, 0, at).alias("head"),
        fn.substr(name, at + 1, -1).alias("rest"),
        fn.trim_chars(name, "rb").alias("trimmed"),
        F.size(pieces).alias("words"),
        F.upper(fn.path(F.struct(pieces.alias("w")), "w.1")).alias("second"),
        F.round(F.col("p_retailprice") / 1024, 6).alias("kilo"),
    )


@query(
    "WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), "
    "t AS (SELECT p_partkey, upper(w) AS word, length(w) AS size, left(w, 1) AS initial FROM w WHERE length(w) > 4) "
    "SELECT p.p_partkey, word, CAST(size AS BIGINT) AS size, initial FROM part p LEFT JOIN t ON p.p_partkey = t.p_partkey"
)
def transform_pipeline(spark, sf_dir):
    """Long words of part names: stages over an array whose results become rows."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    stages = [
        ("project", {"word": lambda w: w, "size": lambda w: F.length(w).cast("long")}),
        ("match", lambda x: x["size"] > 4),
        ("add", {"initial": lambda x: F.left(x["word"], F.lit(1))}),
        ("add", {"word": lambda x: F.upper(x["word"])}),
    ]
    return enrich.transform(parts, F.col("words"), stages, "found").select("p_partkey", "found.word", "found.size", "found.initial")


@query(
    "WITH RECURSIVE chars AS (SELECT c_custkey, c_mktsegment AS s, 1 AS i, CAST(0 AS BIGINT) AS h FROM customer UNION ALL "
    "SELECT c_custkey, s, i + 1, (h * 31 + unicode(s[i])) % 4294967296 FROM chars WHERE i <= length(s)), "
    "done AS (SELECT c_custkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM chars WHERE i = length(s) + 1) "
    "SELECT c_custkey, CAST(((h % 7) + 7) % 7 AS INTEGER) AS partition FROM done"
)
def kafka_partition_hash(spark, sf_dir):
    return writers.topic_partition(read(spark, sf_dir, "customer"), 7, "hashed", F.col("c_mktsegment")).select("c_custkey", "partition")


@query("SELECT event_id, event_type AS topic, user_id || ':' || event_type AS value, user_id % 4 AS partition FROM events")
def kafka_columns(spark, sf_dir):
    events = writers.topic_partition(read(spark, sf_dir, "events"), 4, "fixed", F.col("user_id") % 4)
    value = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    shaped = writers.topic_columns(events.withColumn("value", value), F.col("event_type"), F.concat_ws("|", F.col("event_id").cast("string"), value))
    parts = F.split("value", r"\|")
    return shaped.select(parts[0].cast("long").alias("event_id"), "topic", parts[1].alias("value"), F.col("partition").cast("long").alias("partition"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders) ORDER BY o_orderkey LIMIT 500")
def incremental_pull(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    middle = orders.agg(F.floor(F.max("o_orderkey") / 2)).first()[0]
    return readers.pull(orders, "o_orderkey", readers.Mark(middle), batch=500)[0].select("o_orderkey", "o_totalprice")


@query(
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS record, '<' || (8 + event_id % 8) || '>' || event_type || "
    "chr(10) || 'n=' || event_id AS original_message FROM events"
)
def frame_priority(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    pri = (8 + F.col("event_id") % 8).cast("string")
    text = F.concat(F.lit("<"), pri, F.lit(">"), "event_type", F.lit("\nn="), F.col("event_id").cast("string"))
    numbered = row_number_by_key(events.select("user_id", "event_id", text.alias("t")), ["user_id"], ["event_id"], "_at")
    item = F.struct("event_id", "t")
    blobs = numbered.groupBy("user_id", F.floor((F.col("_at") - 1) / BLOB).alias("_part")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    blob = blobs.select("user_id", "_part", F.concat(F.lit("junk before"), F.array_join(F.transform("x", lambda e: e["t"]), "")).alias("blob"))
    framed = readers.frame_records(blob, "blob", "priority")
    counts = framed.groupBy("user_id", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("user_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("user_id").alias("_user"), F.col("_part").alias("_own"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = framed.join(before, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_part") == F.col("_own")))
    return placed.withColumn("record", F.col("record") + F.col("_before")).drop("_user", "_own", "_part", "_before")


@query(
    "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS original_message FROM d) "
    "SELECT doc_id, count(*) AS lines, sum(length(original_message)) AS chars FROM e WHERE original_message <> '' GROUP BY doc_id"
)
def frame_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    framed = readers.frame_records(docs, "text", "linebreak")
    return framed.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("original_message")).alias("chars"))


@query(
    "SELECT 'events' AS topic, user_id % 4 AS partition, event_id AS \"offset\", event_type AS key, props AS original_message FROM events"
)
def kafka_rows(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    raw = events.select(
        F.lit("events").alias("topic"),
        (F.col("user_id") % 4).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").cast("binary").alias("key"),
        F.col("props").cast("binary").alias("value"),
    )
    return readers.topic_rows(raw).select("topic", "partition", "offset", "key", "original_message")
