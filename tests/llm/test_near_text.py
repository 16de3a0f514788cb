"""The pipeline's near-duplicates against all pairs by brute force."""

import random
from pathlib import Path

import corpus_pipeline
import pytest
from fluvia.llm import common, near_text, set_join


def brute(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def groups(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and near(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_stage_keeps_one_of_near_copies(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):  # similarity about 0.85 to the first, and chains of small steps
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(words)
        texts += [edited(rng, words, 3) for _ in range(2)]
        for _ in range(3):
            words = edited(rng, words, rng.choice((2, 3, 5)))
            texts.append(words)
    texts = [" ".join(t) for t in texts] + ["just two", "Just  two", "just three", None, " "]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert got.columns == ["doc_id", "text", "lang"]
    want = groups([brute(t) for t in texts[:-2]])
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({*want, len(texts) - 2})


@pytest.mark.parametrize("block", [set_join.BLOCK, 3000])
def test_near_each_other_but_not_all(spark, monkeypatch, block):
    """Copies of which many are below the limit of each other, in one block and in many."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [edited(rng, words, 4) for _ in range(40)] + [edited(rng, words, 9) for _ in range(20)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(set_join, "BLOCK", block)
    assert sorted(r["doc_id"] for r in near_text.keep_one(docs).collect()) == sorted(set(groups([brute(t) for t in texts])))


def test_repeated_and_null_ids(spark):
    a, b = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, a.replace("7", "x", 1)), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in near_text.keep_one(docs).collect())
    assert got == sorted([(0, a), (1, a), (1, b)])


def test_equal_rows_and_columns_of_any_kind(spark):
    a, b = " ".join(map(str, range(50))), "one two three four five six"
    rows = [(1, a, None, "x", {"p": 1, "q": 2}), (1, a, "x", None, {"p": 1, "q": 2}), (2, b, "x", "x", {"p": 1}), (2, b, "x", "x", {"p": 1}), (3, None, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d1 string, row string, m map<string,int>")
    got = [tuple(r) for r in near_text.keep_one(docs).collect()]
    assert len(got) == 3 and sorted(r[0] for r in got) == [1, 2, 3] and all(r in rows for r in got)
    assert near_text.keep_one(docs.limit(0)).count() == 0
    assert near_text.keep_one(docs).columns == docs.columns


def test_disk_of_the_stage(spark, tmp_path, monkeypatch):
    """What lies on disk after each step, tables and shuffled bytes, stays well below the input's size. It was 1.1 times as
    much, as texts and sets were shuffled and this stayed until the driver's garbage was collected."""
    rng, texts = random.Random(7), []
    for i in range(1200):
        words = [f"{rng.randrange(10**9):x}" for _ in range(200)]
        texts += [words, edited(rng, words, 3)] if i % 6 == 0 else [words]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    shared, local = common.shared_dir(spark).removeprefix("file:"), spark.conf.get("spark.local.dir")
    files = lambda: {p: p.stat().st_size for at, kind in ((shared, "*.parquet"), (local, "shuffle_*.data")) for p in Path(at).rglob(kind)}
    before, seen, write = files(), [], common.Tables.write
    used = lambda: sum(n for p, n in files().items() if p not in before)
    monkeypatch.setattr(common.Tables, "write", lambda self, df: (write(self, df), seen.append(used()))[0])
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert got.count() == 1200
    assert max(seen) < 0.5 * sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))


def test_shared_keys(spark):
    """How many keys of a row others have, over batches and ranges of keys, and whole rows that are found again once."""
    rng = random.Random(2)
    keys = {i * 7 - 300: sorted({rng.randrange(4000) * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for _ in range(rng.randrange(40))}) for i in range(200)}
    rows = spark.createDataFrame(list(keys.items()), "row long, keys array<long>").repartition(5)
    have = [k for own in keys.values() for k in own]
    want = {r: n for r, own in keys.items() if (n := sum(have.count(k) > 1 for k in own))}
    assert {r["row"]: r["shared"] for r in set_join._shared(rows, len(have)).collect()} == want
    texts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (3, 3, "c")], "d1 long, d2 long, text string")
    wanted = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "d1 long, d2 long, times long")
    assert sorted(r["text"] for r in set_join._once(texts, wanted).collect()) == ["a", "b"]
