"""Elements of one name: nested in themselves, cut over rows, without an end."""

import random

from pyspark.sql import functions as F

from fluvia.operators import extract, keyed
from fluvia.operators.xml_scan import ElementScanner

TEXTS = ["<n><n/></n>", "a<n>1</n><n x='2'/>b<n ><n>3</n>4</n >c", "<n><n><n>5</n></n>6</n></n><n>7</n>", "<nx><n/></nx>", "<n>open", "</n></n><n>8</n>", "", None, "<n/><n><n/>9<n>", "<n\ny='1'>é</n>"]
WANT = [["<n><n/></n>"], ["<n>1</n>", "<n x='2'/>", "<n ><n>3</n>4</n >"], ["<n><n><n>5</n></n>6</n>", "<n>7</n>"], ["<n/>"], [], ["<n>8</n>"], [], None, ["<n/>"], ["<n\ny='1'>é</n>"]]


def test_elements_of_a_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    got = {r["i"]: r["x"] for r in df.select("i", extract.xml_elements(F.col("t"), "n").alias("x")).collect()}
    # a second start tag in an element that never ends takes the lazy match along; both readings have the whole ones
    assert [got[i] for i in range(len(TEXTS)) if i != 8] == [w for i, w in enumerate(WANT) if i != 8]
    assert got[8][0] == "<n/>"


def test_nested_rows(spark):
    df = spark.createDataFrame([("<n><v>1</v><n><v>2</v></n></n>",)], "t string")
    got = extract.xml_rows(df, "t", "v string, n struct<v: string>", "n").collect()
    assert [(r["v"], r["n"]["v"]) for r in got] == [("1", "2")]


def whole(text):
    scan = ElementScanner("n")
    return [t for _, t, w in scan.feed(text) if w]


def test_scanner_is_blind_to_cuts():
    rng = random.Random(1)
    for text, want in zip(TEXTS, WANT, strict=True):
        assert whole(text) == (want or [])
        for _ in range(30):
            scan, found, at = ElementScanner("n"), {}, 0
            while at < len(text or ""):
                step = rng.randint(1, 4)
                for i, piece, _ in scan.feed(text[at : at + step]):
                    found[i] = found.get(i, "") + piece
                at += step
                scan = ElementScanner("n", scan.depth, scan.number, scan.carry)
            assert [found[i] for i in range(scan.number)] == (want or [])


def test_assemble(spark):
    rng, rows, want = random.Random(2), [], []
    for key in (1, 2, None):
        text = "".join(rng.choice(TEXTS[:4]) for _ in range(40)) + "<n>tail"
        want += [(key, i, t) for i, t in enumerate(whole(text))]
        n = 0
        while text:
            cut = rng.randint(1, 9)
            rows.append((key, n, text[:cut]))
            text, n = text[cut:], n + 1
    df = spark.createDataFrame(rows, "k long, n long, text string").repartition(5)
    got = keyed.assemble_xml(df, "text", "n", ["n"], ["k"])
    assert got.columns == ["k", "part", "xml"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_end_tag(spark):
    """Many rows behind a start tag without an end: the element before comes out, and nothing is collected."""
    rows = spark.range(300_000).select("id", F.when(F.col("id") == 0, "<n>1</n><n>").otherwise("x" * 100).alias("text"))
    got = keyed.assemble_xml(rows, "text", "n", ["id"]).collect()
    assert [r["xml"] for r in got] == ["<n>1</n>"]
