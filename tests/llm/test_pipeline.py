"""Each stage of the pipeline against a plain version on the rows that came before it."""

import os

import corpus_pipeline
import pytest
from fluvia.llm import common, language_ppm, toxicity_cnn
from fluvia.llm.common import read


def shingle_set(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "packing"]
    docs = read(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())

    clean = corpus_pipeline.toxicity(spark, docs, sf).cache()
    model = toxicity_cnn.fit(docs, read(spark, sf, "labels"))
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(i for i, t in texts.items() if model.score(t) < toxicity_cnn.CUT)

    known = corpus_pipeline.language(spark, clean, sf).cache()
    trees = language_ppm.fit_on_rest(clean)
    found = {i: trees.measure(texts[i]) for i in ids(clean)}
    usual = {}
    for lang in trees.langs:
        rates = sorted(int(bits / n * 16) for own, bits, n, _ in found.values() if own == lang)
        usual[lang] = (rates[(len(rates) - 1) // 2] + 0.5) / 16
    good = lambda lang, bits, n, share: lang != "und" and share >= 0.5 and bits <= 3 * usual[lang] * (n + 16)
    assert known.columns == docs.columns
    assert ids(known) == [i for i in ids(clean) if good(*found[i])]

    single = corpus_pipeline.near_dedup(spark, known, sf).cache()
    left = ids(known)
    sets = {i: shingle_set(texts[i]) for i in left}
    groups = {i: i for i in left}
    for n, i in enumerate(left):  # ids ascend, so the first of a group is its smallest
        for j in left[:n]:
            if groups[i] != groups[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((groups[i], groups[j]))
                groups = {k: low if g == high else g for k, g in groups.items()}
    seen = sorted(set(groups.values()))
    assert single.columns == docs.columns
    assert ids(single) == seen

    pieces = corpus_pipeline.packing(spark, single, sf)
    assert sorted({r["doc_id"] for r in pieces.collect()}) == seen


def test_run_leaves_only_its_result(spark, sf):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[0] == "doc_id" and rows.count() > 100
    left = set(os.listdir(folder)) - before
    assert [x.rsplit("-", 1)[0] for x in left] == ["pipeline"]
    assert len([x for x in os.listdir(f"{folder}/{left.pop()}") if not x.startswith(".")]) == 1


def test_foreign_and_garbled_texts_go(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    odd = ["Zażółć gęślą jaźń, a potem idziemy wszyscy razem do domu na obiad.", "这是一个中文句子，用于测试语言识别。" * 3, "xqzj kwvv 8s7df6g hjkl " * 20, "12 34", None, ""]
    whole = docs.unionByName(spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(odd)], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, whole, sf).collect()}
    assert not {10_000 + i for i in range(len(odd))} & kept
    assert len(kept) > 0.95 * docs.count()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts and repeated rows, with extra columns named like what the stages use inside."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (3, "", "en", ""), (None, text, "en", "b"), (4, "a", "xx", "c"), (4, "b", None, "c")]
    names = ["_score", "_lang", "_guess", "_node", "_bands", "row", "id", "node", "bands", "guess", "score"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def test_edges_of_filters(spark, sf, odd):
    for stage in (corpus_pipeline.toxicity, corpus_pipeline.language, corpus_pipeline.near_dedup):
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns
        own = {tuple(r) for r in odd.collect()}
        assert all(tuple(r) in own for r in got.collect())
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert corpus_pipeline.toxicity(spark, odd, sf).count() == odd.count()
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_dedup(spark, odd, sf).collect())
    text = odd.filter("doc_id = 1").first()["text"]
    assert kept == sorted([(0, text), (1, text), (2, ""), (4, "a"), (4, "b")])


def test_edges_of_packing(spark, sf, odd):
    got = corpus_pipeline.packing(spark, odd, sf).collect()
    assert sorted((r["doc_id"] or 0) for r in got if r["start"] == 0) == [0, 1, 1, 2, 3, 4, 4]
    assert [r["length"] for r in got if r["doc_id"] in (2, 3)] == [1, 1]
    assert corpus_pipeline.packing(spark, odd.limit(0), sf).count() == 0


def test_predict_keeps_other_columns(spark, odd):
    trees = language_ppm.fit(odd)
    got = language_ppm.predict(odd, trees)
    assert [r["guess"] for r in got.collect()] == ["own guess"] * odd.count()
    assert set(got.columns) == {*odd.columns, "lang_pred"}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_keep_batches_of_texts_small(spark, sf, stage):
    """10,000 rows a batch, as before, are some 40 MB here."""
    docs = spark.range(0, 10_000, 1, 1).selectExpr("id doc_id", "repeat('abcd efgh ', 400) text", "'en' lang", "'a' source")
    with common.kept_setting(spark, common.BATCH_SETTING):
        stage[1](spark, read(spark, sf, "documents").limit(50), sf)
        sizes = docs.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) > 30e6 and max(r["n"] for r in sizes) < 1.5 * common.BATCH_BYTES


def test_same_rows_from_batches_of_any_size(spark, sf):
    docs, got = read(spark, sf, "documents"), []
    for size in ("1k", "1g"):
        with common.kept_setting(spark, common.BATCH_SETTING):
            spark.conf.set(common.BATCH_SETTING, size)
            got.append([])
            for stage in corpus_pipeline.STAGES[:3]:
                got[-1].append(sorted(r["doc_id"] for r in stage[1](spark, docs, sf).collect()))
            assert spark.conf.get(common.BATCH_SETTING) == size  # a session's own setting holds
    assert got[0] == got[1] and all(got[0])


def test_packing_leaves_no_memo_in_its_workers(spark, sf):
    def held(batches):
        from fluvia.llm import packing

        for b in batches:
            yield b.from_pydict({"n": [sum(len(e.segments) for e in packing._LOADED.values())]})

    with common.kept_setting(spark, common.BATCH_SETTING):
        assert corpus_pipeline.packing(spark, read(spark, sf, "documents"), sf).filter("ids_crc32 >= 0").count()
        assert max(r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()) == 0
