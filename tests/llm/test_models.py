"""Toxicity, language and outliers: held-out accuracy, exactness and edge rows."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.llm import language_ppm, robust_outliers, toxicity_cnn
from fluvia.llm.common import Tables, crc32_mod


def brute_ppm(samples, order, text, seen):
    """Code length of a text by walking contexts one byte at a time."""
    counts = defaultdict(Counter)
    for t in samples:
        data = b"\0" * order + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    total = 0.0
    data = b"\0" * order + text
    for i in range(order, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            own = counts.get(data[i - k : i])
            if not own or sum(own.values()) < (seen if k else 1):
                continue
            n, d = sum(own.values()), len(own)
            if data[i] in own:
                total -= math.log2(own[data[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
    return total


def test_ppm_is_exact():
    samples = {"a": [b"the cat sat on the mat", b"the dog"], "b": [b"der hund", "die kätze sitzt".encode()], "c": [b"zz"]}
    trees = language_ppm.Trees(samples, order=3, seen=2)
    for text in [b"the hund", b"", b"x", "kätzchen\n\0".encode(), b"the the the der der" * 9]:
        want = [brute_ppm(samples[x], 3, text, 2) for x in "abc"]
        assert np.allclose(trees.code_lengths(text), want, rtol=1e-4, atol=1e-3)


def test_ppm_edges(spark):
    rows = [(1, "the cat sat", "en"), (2, "der hund lief", "de"), (3, None, "en"), (4, "12 34 !", None), (5, "", "de"), (6, "the dog", "en"), (None, "die katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "lang_pred": F.lit("x")})
    trees = language_ppm.fit(docs)
    got = {r["doc_id"]: r for r in language_ppm.predict(docs, trees, lang_out="l", score_out="s").collect()}
    assert [got[i]["l"] for i in (3, 4, 5)] == ["und"] * 3 and got[3]["s"] == 0
    assert got[1]["l"] == "en" and got[2]["l"] == "de" and 0 <= got[1]["s"] <= 1
    assert language_ppm.keep_known(docs, trees, language_ppm.usual_rates(docs, trees)).columns == docs.columns
    empty = language_ppm.fit(docs.limit(0))
    assert empty.predict("anything") == ("und", 0.0)


def test_ppm_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_ppm.predict(docs, language_ppm.fit_on_rest(docs)).filter(crc32_mod("doc_id", 4) == 2)
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.97


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_cnn.fit(docs, labels)
    found = toxicity_cnn.score(docs, model).join(labels, "doc_id").filter(crc32_mod("doc_id", 3) == 1).toPandas()
    toxic, hit = found.toxic == 1, found.score >= toxicity_cnn.CUT
    assert (hit & toxic).sum() >= 0.7 * toxic.sum() and (hit & ~toxic).sum() <= 2
    assert found.score.between(0, 1).all()
    again = toxicity_cnn.fit(docs, labels)
    assert [again.score(t) for t in ("you idiot", "", None)] == [model.score(t) for t in ("you idiot", "", None)]
    long = "word " * 40000 + "x " * 10
    assert 0 <= model.score(long) <= 1


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 0.5), (2, "", "en", 0.5), (3, "a b", "en", 0.5)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity_cnn.fit(docs, none)
    assert toxicity_cnn.score(docs, model, out="s").count() == 3
    odd = spark.createDataFrame([(None, 1), (1, None), (9, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity_cnn.keep_clean(docs, toxicity_cnn.fit(docs, odd)).columns == docs.columns
    assert toxicity_cnn.score(docs.limit(0), model, out="s").count() == 0


def test_toxicity_thresholds_see_all_rows(spark):
    """Beyond the cap of the draw, thresholds come from the real shares of the classes, not from equal ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    own = toxicity_cnn.calibrate
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity_cnn, "calibrate", lambda model, counts, *a: (seen.append(counts), own(model, counts, *a)))
        toxicity_cnn.fit(docs, labels, most_rows=20)
    known = labels.filter("toxic is not null").filter(crc32_mod("doc_id", 3) != 1).join(docs, "doc_id").toPandas()
    counts = seen[0].groupby("y").n.sum()
    for y in (0, 1):
        assert 0 <= (known.toxic == y).sum() - counts[y] <= 20
    assert counts[0] > 3 * counts[1]


def test_toxicity_threshold():
    bins, hits, rows = np.array([-64, 0, 64, 128]), np.array([1, 2, 5, 5]), np.array([900, 60, 6, 5])
    assert toxicity_cnn._threshold(bins, hits, rows) == (64 + 1) / 2 / 64
    assert toxicity_cnn._threshold(bins, hits, np.array([30, 2, 5, 5])) == (0 - 63) / 2 / 64


def slow_repeats(words):
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_statistics():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4, 5, 6, 50, 300):
        words = [b"w%d" % x for x in rng.integers(0, 6, n)]
        assert robust_outliers.repeated_words(words) == slow_repeats(words)
    assert robust_outliers.base_statistics("a #b\n\na #b\n \n\x85 é") == (6, 8, 2, 1, 0)
    assert robust_outliers.base_statistics(None) == (0, 0, 0, 0, 0)


def test_outliers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(5001, None, None, None), (5002, "", "xx", None), (5003, " ".join(f"w{i}" for i in range(40)), None, "s"), (5004, "$%&# " * 30 + " ".join(f"{i}x$$$" for i in range(60)), "en", "s")], "doc_id long, text string, lang string, source string")
    whole = docs.select("doc_id", "text", "lang", "source").unionByName(odd).withColumns({"d2": F.lit("x"), "kept": F.lit(0)})
    got = {r["doc_id"]: r for r in robust_outliers.judge(whole, least_group=20).collect()}
    assert len(got) == whole.count()
    assert got[5001]["base_failed"] and not got[5001]["kept"] and got[5002]["base_failed"]
    assert got[5003]["kept"] and not got[5004]["kept"]
    assert robust_outliers.judge(whole.limit(0)).count() == 0


def test_least_determinant_against_all_subsets():
    """On tiny groups the search finds the subset that going through all of them finds."""
    least = np.full(5, 1e-6)
    for seed in range(6):
        rng = np.random.default_rng(seed)
        rows = rng.normal(0, 1, (13, 5))
        rows[:3] += rng.normal(8, 1, (3, 5))
        size = lambda x: robust_outliers.bounded(np.cov(rows[list(x)].T, bias=True), least)[1]  # noqa: B023, E731
        best = min(itertools.combinations(range(13), 10), key=size)
        found = robust_outliers.least_determinant(rows, 0.75, least, starts=150)
        assert size(found) == pytest.approx(size(best), abs=1e-9)


def test_chi_square():
    assert robust_outliers.chi_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert robust_outliers.chi_square(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-9)
    rows = np.random.default_rng(3).normal(0, 1, (200_000, 3))
    near = rows[np.argsort(np.square(rows).sum(axis=1))[:150_000]]
    assert robust_outliers.consistency(0.75, 3) == pytest.approx(1 / np.diag(np.cov(near.T)).mean(), rel=0.01)


def _rows(spark, values, lang="en", source="s"):
    table = [(lang, source, *map(float, v)) for v in values]
    return spark.createDataFrame(table, "lang string, source string, " + ", ".join(f"{s} double" for s in robust_outliers.STATS))


def test_fit_against_plain_concentration(spark, tmp_path):
    """Estimates on Spark equal those of the same steps in numpy from the same start, and normal rows lie at chi-square
    distances in spite of a fifth of far ones."""
    rng = np.random.default_rng(5)
    mix = rng.normal(0, 1, (5, 5)) * 2
    clean = rng.normal(0, 1, (1600, 5)) @ mix + 20
    rows = np.concatenate((clean, rng.normal(80, 3, (400, 5))))
    found = {r["grp"]: r for r in robust_outliers.fit(_rows(spark, rows), Tables(spark, "t"), sample=5000).collect()}
    least = np.array(robust_outliers.LEAST)

    def near(held, centre, inverse):
        off = rows - centre
        d2 = np.einsum("ij,jk,ik->i", off, inverse, off)
        bins = np.minimum(np.floor(32 * (np.log2(np.maximum(d2, 2.0**-12)) + 12)), 768)
        return bins <= np.sort(bins)[held - 1]

    own = rows[np.lexsort(rows.T)]
    at = own[robust_outliers.least_determinant(own, 0.75, least)]
    size = None
    while True:
        kept = rows[near(1500, at.mean(axis=0), robust_outliers.bounded(np.cov(at.T, bias=True), least)[0])]
        now = robust_outliers.bounded(np.cov(kept.T, bias=True), least)[1]
        if size is not None and now >= size - robust_outliers.FALL:
            break
        at, size = kept, now
    off = rows - at.mean(axis=0)
    d2 = np.einsum("ij,jk,ik->i", off, robust_outliers.bounded(np.cov(at.T, bias=True), least)[0], off)
    final = rows[d2 <= robust_outliers.chi_square(0.975, 5) * robust_outliers.consistency(0.75, 5)]
    inverse = robust_outliers.bounded(np.cov(final.T, bias=True) * robust_outliers.consistency(0.975, 5), least)[0]
    assert len(found) == 3
    for r in found.values():
        assert r["n"] == len(final)
        assert np.allclose([r[f"c{i}"] for i in range(5)], final.mean(axis=0))
        assert np.allclose([r[f"i{i}_{j}"] for i, j in robust_outliers.PAIRS], [inverse[i, j] * (1 if i == j else 2) for i, j in robust_outliers.PAIRS], rtol=1e-6)
    off = clean - final.mean(axis=0)
    assert np.median(np.einsum("ij,jk,ik->i", off, inverse, off)) == pytest.approx(robust_outliers.chi_square(0.5, 5), rel=0.1)


def test_levels(spark):
    texts = [(i, " ".join(f"w{(i * 31 + j * j) % 9973}" for j in range(20 + i % 37)), "en", f"s{i % 3 if i % 10 else 9}") for i in range(200)]
    docs = spark.createDataFrame([*texts, (900, texts[0][1], "xx", None), (901, "short", "en", "s0")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in robust_outliers.judge(docs, least_group=50).collect()}
    assert got[1]["level"] == "source" and got[10]["level"] == "language" and got[900]["level"] == "all" and got[901]["level"] is None
    assert all(got[i]["kept"] for i in range(200)) and not got[901]["kept"]
