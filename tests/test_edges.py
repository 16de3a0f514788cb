"""Long fields, nulls beside long integers, ties, and columns named like what operators use inside."""

import pytest
from fluvia.operators import custom, enrich, extract, keyed, ruleset
from fluvia.sources import readers
from fluvia.sources import splits as splits_source
from pyspark.sql import functions as F

BIG = 9007199254740993  # 2^53 + 1, which no double holds
LONG = 1_000_000


def test_syslog_long_fields(spark):
    value = "v" * LONG
    lines = [
        f'<13>1 2024-01-01T00:00:00Z host app 1 id [a@1 k="{value}" e="x\\"y"] text',
        f"CEF:0|vendor|{value}|1|2|name|3|k={value} z=1",
        f"<13>Jan  1 00:00:00 host tag[1]: {value}",
        f"<13>1 - - - - - - {value}",
        f'<13>1 - - - - - [a k="{value}',
        "x" * LONG,
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = [r["syslog"] for r in extract.syslog_extract(df, "line").orderBy("i").collect()]
    assert [g and g["type"] for g in got] == ["RFC5424", "CEF", "BSD", "RFC5424", None, None]
    assert got[0]["structured_data"] == [{"$id": "a@1", "k": value, "e": 'x"y'}] and got[0]["message"] == "text"
    assert got[1]["cef"]["device_product"] == value and got[1]["fields"]["k"] == value
    assert got[2]["message"] == value and got[3]["message"] == value


def test_long_values_in_other_extractors(spark):
    value = "v" * LONG
    df = spark.createDataFrame([(f'a=1 b="{value}"', f'<x><ev k="1">{value}</ev><ev k="2"/></x>', f'{{"a": "{value}"}}', f"1,{value}")], "kv string, xml string, js string, csv string")
    assert extract.keyval_extract(df, "kv", "m").first()["m"]["b"] == value
    assert [len(x["_"] or "") for x in extract.xml_extract(df, "xml", "k int, `_` string", "o", tag="ev").first()["o"]] == [LONG, 0]
    assert extract.json_extract(df, "js", "a string").first()["a"] == value
    assert extract.csv_extract(df, "csv", "n int, t string").first()["t"] == value
    assert extract.regex_extract(df, "kv", r'^a=(\d) b="([^"]*)"$', ["n", "t"]).first()["t"] == value


def test_xml_start_tags(spark):
    text = '<ev/><evil id="9"/><ev\n id="1"><k>a</k></ev ><ev id="2" /><ev id="a/b">t</ev>'
    df = spark.createDataFrame([(text,)], "x string").select(extract.xml_elements(F.col("x"), "ev").alias("e"))
    assert df.first()["e"] == ["<ev/>", '<ev\n id="1"><k>a</k></ev >', '<ev id="2" />', '<ev id="a/b">t</ev>']


def test_long_integers_beside_nulls(spark):
    df = spark.createDataFrame([("a", 1, BIG), ("a", 2, None), ("b", 1, BIG)], "k string, n long, v long")
    rows = sorted(r["v"] or 0 for r in custom.bolt(df, lambda r: [{"v": r["v"]}], "v long").collect())
    assert rows == [0, BIG, BIG]
    timed = df.withColumn("ts", F.timestamp_millis(F.col("n") * 1000))
    out = keyed.every_n_ttl(timed, 1, 1000, {"c": F.lit(1)}, ["n"], ["k"], "ts").collect()
    assert sorted(r["v"] or 0 for r in out) == [0, BIG, BIG]
    alerts = keyed.window_alert(timed, 1, ["k"], "ts", ["n"], size=5, reset=True).collect()
    assert sorted(r["v"] or 0 for r in alerts) == [0, BIG, BIG]
    lined = ruleset.extract_lines(df.withColumn("line", F.lit("x")), "line", ruleset.from_document([{"regex": "x", "name": "x"}]), ["k"], ["n"])
    assert sorted(r["v"] or 0 for r in lined.collect()) == [0, BIG, BIG]


def test_pull_leaves_no_tie_behind(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (None, "f")], "v long, name string")
    seen, mark = [], readers.Mark()
    for _ in range(4):
        rows, mark = readers.pull(df, "v", mark, batch=2)
        seen += [r["name"] for r in rows.collect()]
    assert sorted(seen) == ["a", "b", "c", "d", "e"]
    seen, mark = [], readers.Mark()
    for _ in range(6):
        rows, mark = readers.pull(df, "v", mark, batch=2, ties=["name"])
        seen.append("".join(r["name"] for r in rows.collect()))
    assert seen[:3] == ["ab", "cd", "e"] and not any(seen[3:])


NAMES = ["_part", "_n", "_rn", "_b", "_g", "_i", "_x", "_own", "_us", "_value", "_row", "_parsed", "_items", "_event", "_code", "_key", "_before", "_in_part", "_lines", "_last"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, i % 2, f'{{"a": {i}}}', f"<ev><a>{i}</a></ev>") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, k long, js string, xml string").withColumn("ts", F.timestamp_millis(F.col("id") * 1000))
    return df.select("*", *(F.concat(F.lit(f"{n}:"), F.col("id").cast("string")).alias(n) for n in NAMES))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: enrich.sequence(d, ["id"]),
        lambda d: keyed.every_n(d, 2, {"c": F.lit(1)}, ["id"], ["k"]),
        lambda d: keyed.every_n(d, 2, {"c": F.lit(1)}, ["id"], ["k"], spread=True),
        lambda d: keyed.array_by_size(d, 2, ["id"], ["k"]).select(F.explode("rows").alias("r")).select("r.*"),
        lambda d: keyed.array_by_size(d, 3, ["id"]).select(F.explode("rows").alias("r")).select("r.*"),
        lambda d: keyed.array_by_time(d, "4 seconds", 2, "ts", ["id"]).select(F.explode("rows").alias("r")).select("r.*"),
        lambda d: keyed.join_lines(d, "js", "id % 3 = 0", ["id"], ["k"]),
        lambda d: keyed.window_alert(d, 1, ["k"], "ts", ["id"], time="5 seconds"),
        lambda d: keyed.throttle(d, 100, "ts", ["id"]),
        lambda d: extract.json_extract(d, "js", "a int"),
        lambda d: extract.xml_extract(d, "xml", "a int", "o", tag="ev"),
        lambda d: extract.xml_rows(d, "xml", "a int", "ev"),
        lambda d: extract.syslog_extract(d, "js"),
        lambda d: enrich.translate(d, {"k": "label"}, d.sparkSession.createDataFrame([("0", "zero")], "code string, label string")),
        lambda d: enrich.global_value(d, d.select("id", F.col("js").alias("stored")), "id", "stored", "now"),
    ],
)
def test_clashing_names(named, run):
    got = run(named).collect()
    assert got
    for row in got:
        assert all(row[n] == f"{n}:{row['id']}" for n in NAMES)


def test_repeated_codes(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    codes = spark.createDataFrame([("a", "x"), ("a", "y"), ("*", "other")], "code string, label string")
    assert sorted((r["c"] or "", r["l"]) for r in enrich.translate(df, {"c": "l"}, codes).collect()) == [("", "other"), ("a", "y"), ("b", "other")]


def test_global_value_without_keys(spark):
    rows = spark.range(2000).select(F.col("id").alias("t"), F.lit(1).alias("own"))
    stored = spark.range(0, 2000, 37).select((F.col("id") + 5).alias("t"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    got = {r["t"]: r["now"] for r in enrich.global_value(rows, stored, "t", "v", "now").collect()}
    last, want, by = None, {}, {r["t"]: r["v"] for r in stored.collect()}
    for t in range(2000):
        last = by.get(t) if by.get(t) is not None else last
        want[t] = last
    assert got == want


def test_transform(spark):
    df = spark.createDataFrame([(1, [1, 5, 7]), (2, [1]), (3, None)], "id int, xs array<int>")
    stages = [("project", {"n": lambda x: x}), ("match", lambda x: x["n"] > 4), ("add", {"twice": lambda x: x["n"] * 2})]
    got = sorted(((r["id"], r["o"] and tuple(r["o"])) for r in enrich.transform(df, F.col("xs"), stages, "o").collect()), key=repr)
    assert got == [(1, (5, 10)), (1, (7, 14)), (2, None), (3, None)]
    one = enrich.transform(df, F.col("id"), [("project", {"n": lambda x: x})], "o").collect()
    assert [r["o"]["n"] for r in one] == [1, 2, 3]


def test_custom_source(spark):
    def splits(options):
        return [(i, i + 4) for i in range(0, int(options.get("upto", "0")), 4)]

    def rows(part, options):
        return ((i, options["word"] * 2 if i % 2 else None) for i in range(*part))

    splits_source.register(spark, "counted", "n long, word string", splits, rows)
    df = spark.read.format("counted").options(upto="12", word="x").load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r["n"], r["word"]) for r in df.collect()) == [(i, "xx" if i % 2 else None) for i in range(12)]
    assert spark.read.format("counted").options(word="x").load().count() == 0


def test_many_parts_share_tasks(spark):
    """Before, each part was a task of its own."""
    splits_source.register(spark, "many", "n long", lambda options: list(range(1000)), lambda part, options: [(part,)] if part % 2 else [])
    df = spark.read.format("many").load()
    assert df.rdd.getNumPartitions() <= splits_source.TASKS * spark.sparkContext.defaultParallelism
    assert sorted(r["n"] for r in df.collect()) == list(range(1, 1000, 2))
