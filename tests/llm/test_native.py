"""Link trust and Order MinHash against plain versions."""

import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from fluvia.llm import link_trust, order_minhash


def test_urls(spark):
    cases = [
        ("HTTP://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net", "example.net", "", None, "allow"),
        ("https://x.net/", "x.net", "/", "net/", "block"),
        ("http://b.org/fr/x", "b.org", "/fr/x", "org/fr/", "allow"),
        ("http://b.org/de/", "b.org", "/de/", None, "allow"),
        ("x://y://z/q", "y:", "//z/q", None, "allow"),
        ("http://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
        ("http://É.com?x/", "É.com", "", None, "allow"),
        ("nothing", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], None, "z") for i, c in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in link_trust.judge(pages).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert link_trust.judge(pages.limit(0)).count() == 0


def plain_ranks(hosts, edges, seeds, damping=0.85):
    out = {h: [b for a, b in edges if a == h] or [h] for h in hosts}
    rank, whole = dict(seeds), dict.fromkeys(hosts, 1.0)
    for _ in range(300):
        new = {h: (1 - damping) * seeds[h] for h in hosts}
        all_new = dict.fromkeys(hosts, 1 - damping)
        for a in hosts:
            for b in out[a]:
                new[b] += damping * rank[a] / len(out[a])
                all_new[b] += damping * whole[a] / len(out[a])
        rank, whole = new, all_new
    return {h: rank[h] / whole[h] for h in hosts}


def test_propagation(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "bad"), ("e", "bad"), ("e", "d"), ("good", "f"), ("f", "d")]
    trust, distrust = {"good": 1.0, "a": 0.5}, {"bad": 1.0, "c": 0.25}
    hosts = sorted({x for e in links for x in e})
    table = spark.createDataFrame([(h, trust.get(h, 0.0), distrust.get(h, 0.0)) for h in hosts], "host string, trust double, distrust double")
    found = {r["host"]: r for r in link_trust.propagate(table, spark.createDataFrame(links, "src string, dst string"), link_trust.Tables(spark, "t"), tolerance=1e-6, most_steps=90).collect()}
    want_t = plain_ranks(hosts, links, {h: trust.get(h, 0.0) for h in hosts})
    want_d = plain_ranks(hosts, [(b, a) for a, b in links], {h: distrust.get(h, 0.0) for h in hosts})
    for h in hosts:
        assert found[h]["trust"] == pytest.approx(want_t[h], abs=1e-3)
        assert found[h]["distrust"] == pytest.approx(want_d[h], abs=1e-3)


def test_links_spread_verdicts(spark):
    html = '<a HREF="http://evil.net/1">x</a><a href=//evil.net/2>y</a><a href="/own">z</a>'
    pages = spark.createDataFrame([(1, "http://evil.net/", ""), (2, "http://fan.info/", html), (3, "http://other.info/", None)], "page_id long, url string, html string")
    assert {tuple(r) for r in link_trust.host_links(pages).collect()} == {("fan.info", "evil.net")}
    got = {r["page_id"]: r["verdict"] for r in link_trust.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def fold(values, seed=42):
    """Spark's xxhash64 over strings, longs and ints (given as ``(int,)``), unsigned."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def plain_sketch(text, k=3, pick=2):
    words = re.findall(r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]{1,16}", text or "")
    low, signed = (1 << 28) - 1, lambda x: x - (1 << 64) if x >> 63 else x
    seen, elements = Counter(), []
    for i in range(max(len(words) - k + 1, 1) if words else 0):
        kmer = fold(words[i : i + k]) >> 28
        elements.append((fold([kmer, (seen[kmer],)]) & ~low) | i)
        seen[kmer] += 1
    slots = defaultdict(list)
    for e in sorted(elements, key=signed):
        if len(slots[e >> 59]) < pick:
            slots[e >> 59].append(e)
    chosen = {s: [e >> 28 for e in sorted(own, key=lambda e: e & low)] for s, own in slots.items()}
    return sorted(s << 32 | fold(keys) & 0xFFFFFFFF for s, keys in chosen.items())


def test_sketches(spark):
    base = [f"w{i}" for i in range(400)]
    texts = {
        1: " ".join(base), 2: " ".join(base), 3: " ".join(base[:399] + ["new"]), 4: " ".join(f"v{i}" for i in range(300)), 5: None, 6: "", 7: " \n",
        8: "one", 9: "one two", 10: "中文字" * 50, 11: "x" * 5000, 12: " ".join(base[200:] + base[:200]), 13: "a b c " * 300, 14: "a b\na c\tb " * 7,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = order_minhash.sketch(df, "text", "s")
    got = {r["doc_id"]: list(r["s"]) for r in made.collect()}
    assert got == {i: plain_sketch(t) for i, t in texts.items()}
    near = lambda x, y: len(set(got[x]) & set(got[y])) / max(1, len({v >> 32 for v in got[x] + got[y]}))
    one, other = made.filter("doc_id = 1").select(F.col("s").alias("a")), made.select("doc_id", "s")
    rows = other.join(one).select("doc_id", order_minhash.likeness("s", "a").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == pytest.approx({i: near(i, 1) for i in texts})
    assert near(1, 2) == 1 and near(1, 4) == 0 and near(1, 3) > 0.9
    assert near(1, 12) < 0.75  # the same words in another order are further away


def test_edited_copies(spark):
    texts = {3: "abcdefgh", 7: "é🙂xy", 20: None, 21: "", 30: "0123456789" * 30, -4: "zz top of the list", 31: "tie", 40: "q" * 9}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, next_text int")
    got = {r["doc_id"]: r for r in order_minhash.edited_copies(docs).collect()}
    ids = sorted(texts)
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i] or "", texts[following] or ""
        cut = len(t) // 4
        assert got[i]["edited"] == t[: len(t) - cut] + n[:cut] and got[i]["n_chars"] == len(t)
    assert order_minhash.edited_copies(docs.limit(0)).count() == 0
    one = order_minhash.edited_copies(docs.filter("doc_id = 3")).collect()
    assert [r["edited"] for r in one] == ["abcdefab"]


def test_next_over_many_ranges(spark):
    rows = spark.range(0, 5000, 3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(7)
    got = {r["doc_id"]: r["next_text"] for r in order_minhash.with_next(rows, "doc_id", ["text"], parts=50).collect()}
    ids = list(range(0, 5000, 3))
    assert got == {i: str(j) for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}
