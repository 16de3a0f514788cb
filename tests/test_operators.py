"""Operators on small rows with known results, edge rows included."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia import functions as fn
from fluvia.operators import custom, enrich, extract, keyed, route, ruleset
from fluvia.sinks import writers
from fluvia.sources import readers


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, f"{i:03d} line", i * 10, None if i == 3 else i % 2 == 0) for i in range(1, 7)]
    return spark.createDataFrame(rows, "n long, original_message string, v long, even boolean")


def test_predicates(lines):
    assert values(route.accept(lines, "even"), "n") == [(2,), (4,), (6,)]
    assert values(route.reject(lines, "even"), "n") == [(1,), (3,), (5,)]  # null counts as false
    assert values(lines.filter(route.any_of(["even", "n = 3"])), "n") == [(2,), (3,), (4,), (6,)]
    assert values(lines.filter(route.any_of([])), "n") == []


def test_gates(lines):
    step = lambda d: d.withColumn("v", F.col("v") + 1)
    gated = route.gate(lines, step, "n <= 3", "process", "bypass", then="v <> 21")
    assert sorted(values(gated, "n", "v")) == [(1, 11), (3, 31), (4, 40), (5, 50), (6, 60)]
    assert sorted(values(route.gate(lines, step, "n <= 2"), "n", "v")) == [(1, 11), (2, 21)]
    assert route.gate(lines, step, "n <= 2", "block", "block").count() == 0
    with pytest.raises(ValueError):
        route.gate(lines, step, "true", "drop")


def test_documents(spark):
    rows = spark.createDataFrame([("a", 1, None), ("ab", 5, "x"), (None, None, "xy")], "s string, n int, t string")
    match = lambda d: [r[0] for r in values(rows.filter(route.match_document(d)).withColumn("k", F.coalesce("s", F.lit("-"))), "k")]
    assert match({"s": "a"}) == ["a"] and match({"s": None}) == ["-"]
    assert match({"n": {"$gt": 0, "$lt": 5}}) == ["a"] and match({"s": {"$starts": ["a"][0]}, "t": {"$exists": True}}) == ["ab"]
    assert match({"$nor": [{"s": "a"}, {"n": 5}]}) == ["-"] and match({"t": {"$contains": "y"}}) == ["-"]
    assert match({"s": {"$not": {"$regex": "^a$"}}}) == ["ab", "-"] and match({"n": {"$in": [1, None]}}) == ["a", "-"]
    with pytest.raises(ValueError):
        route.match_document({"$where": 1})


def test_forward_cycle(lines):
    with pytest.raises(ValueError, match="cycle"):
        route.forward({"a": lambda d: d, "b": lambda d: d}, {"a": ["b"], "b": ["a"]}, {"a": lines})


def test_placement(lines):
    assert route.place(lines, 3, "all").groupBy("worker").count().count() == 3
    assert route.place(lines, 3).rdd.getNumPartitions() == 3
    assert route.place(lines, 3, "expression", "n % 2").count() == 6


def test_expressions(spark):
    df = spark.createDataFrame([("--a-b--", "k: v, x: , y"), ("éab", None)], "s string, p string")
    assert values(df, fn.trim_chars(F.col("s"), "-"), fn.trim_chars(F.col("s")), fn.index_of(F.col("s"), "b"), fn.index_of_bytes(F.col("s"), "b")) == [("a-b", "--a-b--", 4, 4), ("éab", "éab", 2, 3)]
    assert values(df, fn.substr(F.col("s"), 2, -1), fn.substr(F.col("s"), 0, 2)) == [("a-b--", "--"), ("b", "éa")]
    pairs = F.transform(fn.split_literal(F.col("p"), ", "), lambda x: fn.split_literal(x, ": "))
    assert values(df.limit(1), fn.pairs_to_map(pairs)) == [({"k": "v", "x": "_", "y": "_"},)]
    assert fn.java_format("YYYY-MM-DD[T]HH:mm:ss.SSS") == "yyyy-MM-dd'T'HH:mm:ss.SSS"


def test_properties(spark):
    df = spark.createDataFrame([((1, (2, "x")), 5)], "a struct<p:int,q:struct<r:int,s:string>>, b int")
    new = F.struct(F.struct(F.lit(9).alias("r"), F.lit("new").alias("t")).alias("q"))
    deep = enrich.set_fields(df, {"a": new}, deep=True).first()
    assert deep["a"].asDict(True) == {"p": 1, "q": {"r": 9, "s": "x", "t": "new"}}
    assert enrich.set_fields(df, {"a": new}).first()["a"].asDict(True) == {"q": {"r": 9, "t": "new"}}
    assert enrich.set_fields(df, {"z": F.lit(1)}, replace=True).columns == ["z"]
    gone = enrich.delete_fields(df, ["a.q.s", "b", "nope", "a.nope"])
    assert gone.first().asDict(True) == {"a": {"p": 1, "q": {"r": 2}}}


def test_merge_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"}), ({"d": "5"}, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in values(enrich.merge(df, ["x", "y"], "m"), "m")] == [{"a": "1", "b": "3"}, {"c": "4"}, {"d": "5"}]


def test_sequence(spark):
    df = spark.range(1000).repartition(7).withColumn("o", F.col("id") * 3 % 1000)
    assert sorted(values(enrich.sequence(df, ["o"], start=5), "o", "seq")) == [(i, i + 5) for i in range(1000)]
    assert enrich.sequence(df.limit(0), ["o"]).count() == 0
    with pytest.raises(ValueError):
        enrich.sequence(df, [])


def test_translate(spark, lines):
    table = spark.createDataFrame([("10", "ten"), ("20", "twenty")], "code string, label string")
    assert sorted(values(enrich.translate(lines, {"v": "w"}, table), "w"))[:3] == [("30",), ("40",), ("50",)]
    starred = enrich.translate(lines, {"v": "w"}, table.union(spark.createDataFrame([("*", "?")], table.schema)))
    assert sorted(values(starred, "w")) == [("?",)] * 4 + [("ten",), ("twenty",)]
    assert values(enrich.translate(lines.limit(1), {"v": "w"}, {}), "w") == [("10",)]


def test_times(spark):
    df = spark.createDataFrame([("2024-03-05 10:00:00",), ("bad",), (None,)], "t string")
    got = enrich.timestamp(df, "ms", F.col("t"), "YYYY-MM-DD HH:mm:ss", unix=True)
    assert values(got, "ms") == [(1709632800000,), (None,), (None,)]
    assert enrich.timestamp(df, "now").first()["now"] is not None


def test_cef(spark):
    df = spark.createDataFrame([(({"k": "v"}, [1, 2], None, "  "), 1)], "e struct<m:map<string,string>,l:array<int>,n:string,b:string>, x int")
    assert values(enrich.cef_out(df, "e"), "cef") == [("CEF:0|localdomain|localdomain|0|0|localdomain|0|m.k=v l.0=1 l.1=2",)]
    maps = spark.createDataFrame([({"a": "1", "Name": "hide"},), (None,)], "e map<string,string>")
    assert [r[0][-4:] for r in values(enrich.cef_out(maps, "e"), "cef")] == ["|a=1", "n|0|"]


def test_cipher(lines):
    sealed = enrich.encrypt(lines, F.col("original_message"), "secret", "c")
    assert values(enrich.decrypt(sealed, F.col("c"), "secret", "p"), "p") == values(lines, "original_message")
    assert {r[0] for r in values(enrich.decrypt(sealed, F.lit("00:zz"), "secret", "p"), "p")} == {None}
    with pytest.raises(ValueError):
        enrich.encrypt(lines, F.col("original_message"), "", "c")


def test_syslog_line(spark):
    df = spark.createDataFrame([("2024-01-05 07:08:09", "alert", "mail"), ("2024-01-15 07:08:09", "9x", "3")], "t string, l string, f string")
    out = enrich.syslog_line(df, F.lit("m"), F.col("t").cast("timestamp"), F.lit("h"), F.lit("a"), F.col("f"), F.col("l"))
    assert values(out, "line") == [("<17>Jan 5 07:08:09 h a: m",), ("<30>Jan 15 07:08:09 h a: m",)]


def test_json_edges(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no"}',), ("{bad",), ("",), (None,), ('{"a": 2}',)], "j string")
    good, bad = extract.quarantine(extract.json_extract(df, "j", "a int, b string"))
    assert values(good, "a", "b") == [(1, "x"), (None, None), (2, None)]
    assert values(bad, "_error") == [('{"a": "no"}',), ("{bad",), ("",)]
    assert values(extract.json_extract(df.limit(1), "j", "a int, b string", out="o"), "o.a") == [(1,)]


def test_csv_edges(spark):
    df = spark.createDataFrame([('1,"a, b"',), ("x,y",), (None,), ("2",)], "c string")
    good, bad = extract.quarantine(extract.csv_extract(df, "c", "n int, s string"))
    assert values(good, "n", "s")[0] == (1, "a, b") and ("x,y",) in values(bad, "_error")


def test_keyval_edges(spark):
    df = spark.createDataFrame([('a=1 b="x y" c= a=2 junk é="ü" u=p=q',), ("",), (None,)], "k string")
    assert [r[0] for r in values(extract.keyval_extract(df, "k", "m"), "m")] == [{"a": "2", "b": "x y", "c": "", "é": "ü", "u": "p=q"}, {}, None]


def test_regex_edges(spark):
    df = spark.createDataFrame([("GET /x 200", "old"), ("nothing", "old"), (None, "old")], "l string, verb string")
    got = extract.regex_extract(df, "l", r"(\w+) (\S+) (\d+)", ["verb", "path"])
    assert values(got, "verb", "path", "2") == [("GET", "/x", "200"), ("old", None, None), ("old", None, None)]


def test_xml_edges(spark):
    df = spark.createDataFrame([(1, '<n to="a"><b>x</b></n> junk <n to="b"><b t="q">y</b></n>'), (2, "none"), (3, None)], "i int, x string")
    got = {r["i"]: r["o"] for r in extract.xml_extract(df, "x", "to string, b struct<`_`:string,t:string>", "o", tag="n").collect()}
    assert [(e["to"], e["b"]["_"], e["b"]["t"]) for e in got[1]] == [("a", "x", None), ("b", "y", "q")]
    assert got[2] == [] and got[3] is None


def test_winevt_single(spark):
    xml = "<Event><System><EventID>7</EventID><TimeCreated SystemTime='t'/></System><EventData><Data>hello</Data></EventData></Event>"
    df = spark.createDataFrame([(xml,), (None,), ("<broken",)], "x string")
    got = extract.winevt_extract(df, "x").collect()
    assert got[0]["event"]["Data"] == {"Message": "hello"} and got[0]["event"]["System"]["EventID"] == "7"
    assert got[1]["event"] is None and got[2]["_error"] == "<broken"


def test_syslog_edges(spark):
    rows = ["<165>1 2023-03-15T10:00:00Z host1 app 1234 ID47 [ex@1 iut=\"3\" s=\"A\"] ﻿an event", "<34>1 2023-03-15T10:00:00Z host1 app - - - Test message", "<13>Feb  5 17:32:18 h tag: text", "plain", None]
    df = spark.createDataFrame([(r,) for r in rows], "l string")
    got = [r["syslog"] for r in extract.syslog_extract(df, "l").collect()]
    assert (got[0]["facility"], got[0]["level"], got[0]["messageid"], got[0]["message"]) == ("local4", "notice", "ID47", "an event")
    assert got[0]["structured_data"] == [{"$id": "ex@1", "iut": "3", "s": "A"}]
    assert (got[1]["pid"], got[1]["message"], got[1]["structured_data"]) == (None, "Test message", [])
    assert (got[2]["type"], got[2]["host"], got[2]["app_name"], got[2]["message"]) == ("BSD", "h", "tag", "text")
    assert got[3] is None and got[4] is None


def test_cef_is_matched_few_times(spark):
    """Bars and line ends behind a backslash, bars in the extension; and no match for each field of the header."""
    row = "<13>x CEF:0|a\\|b|c\\\\|\\\n||n m|9|k=v | w\n z=p=q  e= f"
    df = spark.createDataFrame([(row,), ("CEF:0|a|b|c|d|e|f",), ("CEF:1|||||||",)], "l string")
    made = extract.syslog_extract(df, "l")
    got = [r["syslog"] for r in made.collect()]
    assert tuple(got[0]["cef"]) == ("CEF:0", "a\\|b", "c\\\\", "\\\n", "", "n m", "9", "k=v | w\n z=p=q  e= f")
    assert got[0]["fields"] == {"k": "v | w", "z": "p=q", "e": "f"} or got[0]["fields"] == {"k": "v | w", "z": "p=q", "e": " f"}
    assert got[1] is None and got[2]["fields"] == {} and got[2]["cef"]["severity"] == ""
    plan = made.select("syslog.cef", "syslog.fields")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(CEF:\d+") <= 2 and "try_cast(regexp_extract" not in plan


def test_rule_sets():
    parse = ruleset.machine(ruleset.from_document([{"regex": "a(b)?(c)?", "name": ["x", "y", "z"]}]))
    assert parse.read("zzab 12") == ([("x", "b"), ("y", "12"), ("z", "12")], "start")
    loop = ruleset.machine(ruleset.from_document({"start": [{"regex": "k", "name": "text", "next": "s"}], "s": [{"regex": "^v", "name": "v"}]}))
    assert loop.read("k v") == ([], "start")  # falls back to start, which drops unnamed values when it ends
    assert loop.read("k") == ([("text", "k")], "s")  # the line was used up
    assert loop.read(None) == ([], "start")
    reject = ruleset.machine(ruleset.from_document([{"regex": "no", "reject": True}]))
    assert reject.read("a no b")[0] is None


def test_rule_set_over_lines(spark):
    rules = ruleset.from_document({"start": [{"regex": "begin", "next": "in"}], "in": [{"regex": r"(\d+)", "name": "n"}, {"regex": "end", "next": "start"}]})
    df = spark.createDataFrame([("f", 1, "5"), ("f", 2, "begin"), ("f", 3, "7"), ("g", 1, "8"), ("f", 4, "9")], "file string, ln int, line string")
    got = ruleset.extract_lines(df, "line", rules, ["file"], ["ln"])
    assert sorted((r["file"], r["ln"], [p["value"] for p in r["parsed"]]) for r in got.collect()) == [("f", 1, []), ("f", 2, []), ("f", 3, ["7"]), ("f", 4, ["9"]), ("g", 1, [])]


def test_native_chain_equals_general(spark):
    rules = ruleset.from_document({"start": [{"regex": r"^(\w+)", "name": "a", "next": "b"}], "b": [{"regex": r"=(\d+)(x)?", "name": "n"}]})
    df = spark.createDataFrame([("k =5x",), ("k none",), ("",), (None,)], "l string")
    native = [(r["p"]["a"], r["p"]["n"]) for r in ruleset.extract_native(df, "l", rules, "p").collect()]
    assert native == [("k", "5"), ("k", None), (None, None), (None, None)]


def test_every_n_edges(spark):
    for n in (1, 2, 3):
        for first in (True, False):
            for size in (n - 1, n, n + 1, 7):
                rows = spark.createDataFrame([(i, None if size == 7 else "k", i * 1.0) for i in range(max(size, 0))], "i int, k string, v double")
                want, data, count, early = [], 0.0, 0, first
                for i in range(max(size, 0)):
                    data, count = data + i, count + 1
                    if early or count >= n:
                        want.append((i, data))
                        data, count, early = 0.0, 0, False
                got = keyed.every_n(rows, n, {"s": F.col("v")}, ["i"], ["k"], first=first)
                assert sorted(values(got, "i", "aggregate.s")) == want


def test_spread_equals_plain(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumns({"k": F.expr("if(user_id < 6, null, if(user_id < 11, 'hot', event_type))"), "c": F.round(F.col("value") * 100)})
    sums = {"n": F.lit(1), "c": F.col("c")}
    for first in (True, False):
        plain, spread = (keyed.every_n(events, 7, sums, ["event_id"], ["k"], first=first, ts="ts", spread=x) for x in (False, True))
        assert sorted(values(spread, "event_id", "aggregate.*")) == sorted(values(plain, "event_id", "aggregate.*"))
    alone = keyed.every_n(events, 7, sums, ["event_id"], first=False, spread=True)
    assert sorted(values(alone, "event_id", "aggregate.c")) == sorted(values(keyed.every_n(events, 7, sums, ["event_id"], first=False), "event_id", "aggregate.c"))
    arrays = [sorted(values(keyed.array_by_size(events, 9, ["event_id"], ["k"], spread=x), F.coalesce("k", F.lit("-")), "batch", F.transform("rows", lambda r: r["event_id"]))) for x in (False, True)]
    assert arrays[0] == arrays[1]


def test_ttl(spark):
    times = [0, 10, 20, 1000, 1010, 5000]
    df = spark.createDataFrame([(i, "k", t / 1000) for i, t in enumerate(times)], "i int, k string, t double").withColumn("ts", F.col("t").cast("timestamp"))
    got = keyed.every_n_ttl(df, 10, 500, {"n": F.lit(1)}, ["i"], ["k"], "ts")
    assert sorted(values(got, "i", "n", "flushed")) == [(0, 1.0, False), (0, 2.0, True), (3, 1.0, False), (3, 1.0, True), (5, 1.0, False)]


def test_arrays(spark):
    df = spark.range(25).withColumn("ts", F.col("id").cast("timestamp"))
    assert sorted(values(keyed.array_by_size(df, 10, ["id"], tail=True), "batch", F.size("rows"))) == [(0, 10), (1, 10), (2, 5)]
    assert keyed.array_by_size(df, 10, ["id"]).count() == 2
    assert sorted(values(keyed.array_by_time(df, "10 seconds", 4, "ts", ["id"]), F.size("rows"))) == [(1,), (2,), (2,), (4,), (4,), (4,), (4,), (4,)]


def test_joiner(spark):
    df = spark.createDataFrame([(1, " tail", 0), (2, "Jan a", 1), (3, None, 2), (4, " c", 3), (5, "Feb d", 10)], "n int, l string, t int").withColumn("ts", F.col("t").cast("timestamp"))
    got = keyed.join_lines(df, "l", F.rlike("l", F.lit("^[A-Z]")), ["n"], most=2)
    assert sorted(values(got, "n", "out")) == [(1, " tail"), (4, "\n c"), (5, "Feb d")]
    gap = keyed.join_lines(df, "l", "false", ["n"], delimiter="|", wait_ms=7000, ts="ts")
    assert values(gap, "n") == [(5,)]  # a gap of exactly the wait does not end the event
    assert keyed.join_lines(df, "l", "false", ["n"], wait_ms=6999, ts="ts").count() == 2


def test_alert_bounds(spark):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 5, 10, 11, 30])], "i int, k string, t int").withColumn("ts", F.col("t").cast("timestamp"))
    alert = lambda **o: sorted(values(keyed.window_alert(df, 3, ["k"], "ts", ["i"], **o), "i", "window_value"))
    assert alert(time="10 seconds") == [(2, 3.0), (3, 3.0)]  # exactly ten seconds old is in
    assert alert(time="10 seconds", reset=True) == [(2, 3.0)]
    assert alert(size=3) == [(2, 3.0), (3, 3.0), (4, 3.0)]
    assert alert(time="10 seconds", size=2) == []
    with pytest.raises(ValueError):
        alert()


def test_throttle(spark):
    df = spark.createDataFrame([(i, t / 1000) for i, t in enumerate([1, 2, 3, 950, 960])], "i int, t double").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(values(keyed.throttle(df, 100, "ts", ["i"]), "i", "release_ms")) == [(0, 100), (1, 200), (2, 300), (3, 1000), (4, 1100)]


def test_throttle_of_many_rows_and_long_intervals(spark):
    """Places within a range times the interval go beyond 32 bits."""
    df = spark.range(64).select(F.col("id").alias("i"), F.timestamp_seconds(F.lit(0)).alias("ts"))
    assert sorted(values(keyed.throttle(df, 10**9, "ts", ["i"]), "i", "release_ms")) == [(i, i * 10**9) for i in range(64)]


def test_bolts(lines):
    def work(row):
        if row["n"] == 2:
            raise ValueError("two")
        return [{"m": row["n"]}] * (row["n"] % 3)

    safe = custom.guarded(work, lambda row, error: [{"m": -row["n"]}])
    assert sorted(values(custom.bolt(lines, safe, "m long"), "m")) == [(-2,), (1,), (4,), (5,), (5,)]


def test_rows_held_at_once(spark, monkeypatch):
    """Neither a batch of long texts is held as rows whole, nor all that a batch makes."""
    long = spark.range(20).select(F.repeat(F.lit("x"), F.lit(custom.SLICE_BYTES)).alias("t")).coalesce(1)
    held = custom.map_rows(long, lambda batches: ([{"n": len(rows)}] for rows in batches), T.StructType([T.StructField("n", T.LongType())]))
    found = [r["n"] for r in held.collect()]
    assert sum(found) == 20 and max(found) <= 2
    monkeypatch.setattr(custom, "map_rows", lambda df, work, schema: work)
    run = custom.bolt(long, lambda row: [{"n": row["v"]}] * 9_000, "n long")
    made = [len(rows) for rows in run(iter([[{"v": 1}] * 10]))]
    assert sum(made) == 90_000 and max(made) <= 2 * custom.MADE_ROWS


def test_excluded_names_are_whole(spark, tmp_path):
    for name in ("b.log", "ab.log"):
        (tmp_path / name).write_text("x\n")
    assert values(readers.lines(spark, f"{tmp_path}/*.log", exclude=["b.log"]), "filename") == [("ab.log",)]


def test_line_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\nthree\n")
    (tmp_path / "b.log").write_bytes(b"x\r\ny")
    (tmp_path / "skip.log").write_text("no\n")
    (tmp_path / "empty.log").write_text("")
    got = readers.line_files(spark, f"{tmp_path}/*.log", exclude=["skip*"])
    assert sorted(values(got, "filename", "ln", "original_message")) == [("a.log", 1, "one"), ("a.log", 2, ""), ("a.log", 3, "three"), ("b.log", 1, "x"), ("b.log", 2, "y")]
    assert readers.lines(spark, f"{tmp_path}/*.log", exclude=["skip*"]).count() == 5


def test_sources(spark):
    assert readers.topic_options("h:1", ["/a.*/", "b"])["subscribePattern"] == "a.*|b"
    assert readers.topic_options("h:1", "t", "earliest", group="g")["kafka.group.id"] == "g"
    df = spark.createDataFrame([("x\r\ny\n\n<1>z",), ("head<12>a\n<3>b",), (None,)], "blob string")
    assert [r[0] for r in values(readers.frame_records(df, "blob"), "original_message")] == ["x", "y", "<1>z", "head<12>a", "<3>b"]
    assert [r[0] for r in values(readers.frame_records(df, "blob", "priority"), "original_message")] == ["<1>z", "<12>a\n", "<3>b"]
    assert values(readers.inline_rows(spark, ["a", "b"]), "ln", "original_message") == [(1, "a"), (2, "b")]


def test_pull(spark, tmp_path):
    df = spark.range(10)
    first, mark = readers.pull(df, "id", readers.Mark(), batch=4)
    second, mark2 = readers.pull(df, "id", mark, batch=4)
    assert (values(first, "id"), values(second, "id")) == ([(i,) for i in range(4)], [(i,) for i in range(4, 8)])
    _, end = readers.pull(df, "id", readers.Mark(9))
    assert mark2.value == 7 and end.value == 9
    both, marks = readers.pull_tables({"log_a": df, "log_b": df, "other": df}, "^log_", "id", {"log_a": readers.Mark(8)})
    assert both.count() == 11 and marks["log_b"].value == 9
    readers.save_marks(spark, f"{tmp_path}/marks", marks)
    assert readers.load_marks(spark, f"{tmp_path}/marks")["log_a"].value == 9 and readers.load_marks(spark, f"{tmp_path}/none") == {}


def test_sinks(spark, lines, tmp_path):
    writers.routed_files(lines, f"{tmp_path}/out", {"kind": F.when(F.col("n") < 3, "low").otherwise("high")}, F.col("original_message"))
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out/kind=low").collect()) == ["001 line", "002 line"]
    writers.collections(lines.withColumn("$tmp", F.lit(1)), f"{tmp_path}/c", F.lit("x"), batch_id=1)
    writers.collections(lines, f"{tmp_path}/c", F.lit("x"), batch_id=1)
    assert spark.read.parquet(f"{tmp_path}/c").count() == 6
    seen = []

    def broken(df):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        writers.all_of([broken, lambda d: seen.append(d.count())])(lines)
    assert seen == [6]
    with pytest.raises(RuntimeError):
        writers.all_of([broken, lambda d: seen.append(0)], serial=True)(lines)
    assert seen == [6]
    counted, found = writers.counted(lines, "stage", even=F.col("even"))
    writers.null(counted)
    assert found.get == {"rows": 6, "even": 3}


def test_string_hash(spark):
    df = spark.createDataFrame([("hello",), ("",), ("Ünï🙂",), (None,)], "s string")

    def plain(s):
        h = 0
        for i in range(0, len(b := s.encode("utf-16-le")), 2):
            h = (h * 31 + int.from_bytes(b[i : i + 2], "little")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    assert [r[0] for r in values(df, writers.string_hash(F.col("s")))] == [plain(x) for x in ("hello", "", "Ünï🙂", "")]
    round_robin = writers.topic_partition(spark.range(7), 3, "roundrobin", order_by=["id"])
    assert [r[0] for r in sorted(values(round_robin, "id", "partition"))] == list(range(7)) and {p for _, p in values(round_robin, "id", "partition")} == {0, 1, 2}
