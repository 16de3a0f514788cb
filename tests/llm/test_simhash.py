"""Ball hashing against all pairs by brute force."""

import random

import xxhash

from fluvia.llm import components, simhash
from fluvia.llm.common import Tables


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_fingerprint():
    for t in [None, "", "  \n", "One", "one two", "A b C d e f g h", "é ü\xa0x y z " * 3, "x " * 20000]:
        assert simhash.simhash(t) == brute(t)


def test_components_of_fingerprints(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [0, 0, (1 << 64) - 1]
    for b in base:  # chains of small steps, so that components reach further than two bits
        for _ in range(rng.randint(1, 6)):
            fps.append(b)
            b ^= sum(1 << k for k in rng.sample(range(64), rng.randint(1, 2)))
    ids = rng.sample(range(1000), len(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.ball_edges(spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long"))
    links = {r["node"]: r["root"] for r in components.components(edges, Tables(spark, "t")).collect()}
    want = roots(ids, fps)
    groups = {}
    for i, f in zip(ids, signed, strict=True):
        groups.setdefault(links.get(f, f), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in ids if want[i] == m) for m in set(want.values()))


def test_near_duplicates(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900, None, "q"), (901, "", "q"), (902, " ", "q"), (903, "Just two", None), (903, "Just two", None)], "doc_id long, text string, lang string")
    docs = own.select("doc_id", "text", "lang").unionByName(extra)
    docs = docs.withColumns({"fp": docs.doc_id, "component_id": docs.doc_id})  # clashing names
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16().alias("h"), "component_id").collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = roots([i for i, _ in texts], [brute(t) for _, t in texts])
    assert len(got) == len(texts)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())
    assert {r["doc_id"]: r["h"] for r in got} == {i: f"{brute(t):016x}" for i, t in texts}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "only one here")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 5), (5, 5)]
