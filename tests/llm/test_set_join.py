"""The set join against all pairs by brute force."""

import random

import numpy as np
import pytest

from fluvia.llm import queries, set_join

RULE = set_join.Rule()


def brute_set(text):
    words = (text or "").encode().lower().split()
    n = min(4, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """(id, text) -> [(id, size, component)]."""
    sets = [brute_set(t) for _, t in rows]
    root, having = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for w in s:
            for j in having.setdefault(w, []):
                common[j] = common.get(j, 0) + 1
            having[w].append(i)
        for j, c in common.items():
            if 100 * c >= 85 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [(x, len(s), least.get(find(i)) if s else x) for i, ((x, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), min(changes, len(words))):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def made(rng):
    """Chains of copies about the limit, common passages, short texts."""
    passage, texts = [f"p{i}" for i in range(60)], []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((7, 20, 60, 200, 400)))]
        words = words + passage if rng.random() < 0.5 else words
        texts.append(words)
        for _ in range(rng.randint(0, 8)):
            words = edited(rng, rng.choice((words, texts[-1])), rng.choice((0, 1, 2, 3, 5)))
            words = words[: len(words) - rng.choice((0, 0, 1, 3))] + rng.choice(([], ["tail"] * 3))
            texts.append(words)
    return [" ".join(t) for t in texts]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = [tuple(r) for r in set_join.join(docs).collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_shingles(monkeypatch):
    texts = [None, "", " \n", "One", "a B c d", "a b c d e f a b c d", "é ü x y\x0bz " * 9, "\xa0 a"]
    for t in texts:
        assert len(set_join.shingles(t, 4)) == len(brute_set(t))
    whole = [set_join.shingles(t, 4).tolist() for t in texts]
    monkeypatch.setattr(set_join, "TEXT_BLOCK", 3)
    assert [set_join.shingles(t, 4).tolist() for t in texts] == whole


def test_first_and_needed():
    """Partners at the limit share as many of their first shingles as is asked for, whatever the order."""
    rng = random.Random(1)
    needed = lambda n: ((3 * ((17 * n + 19) // 20)) // 20 + 1) // 4 + 1
    for _ in range(3000):
        n = rng.randint(1, 150)
        a = rng.sample(range(10**6), n)
        b = a[: rng.randint(-(-17 * n // 20), n)]
        b = b + [-i - 1 for i in range(rng.randint(0, n // 5))]
        common = len(set(a) & set(b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        order = {x: rng.random() for x in {*a, *b}}
        heads = [set(sorted(s, key=order.get)[: RULE.first(len(s))]) for s in (a, b)]
        assert len(heads[0] & heads[1]) >= max(needed(len(a)), needed(len(b)))


def test_candidate_keys():
    """Partners at the limit share a key, small sets and crowded hashes included."""
    rng = np.random.default_rng(5)
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        high = 2**64 if rng.random() < 0.7 else int(rng.choice([2**58, 2**61]))  # crowded: most ranges are empty
        a = rng.integers(0, high, n, dtype=np.uint64)
        gone, new = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, high, new, dtype=np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common) and a.tolist() != b.tolist():
            assert len(np.intersect1d(set_join.candidate_keys(a, RULE), set_join.candidate_keys(b, RULE)))


def test_block():
    rng = random.Random(7)
    for _ in range(6):
        texts = made(rng)
        sets = {s.tobytes(): s for s in (set_join.shingles(t, 4) for t in texts) if len(s)}
        sets = [s.view(np.int64) for s in sets.values()]
        block = set_join.Block(sets, RULE)
        got, plain = block.join().tolist(), [set(s.tolist()) for s in sets]
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                c = len(plain[i] & plain[j])
                if 100 * c >= 85 * (len(plain[i]) + len(plain[j]) - c) and want[i] != want[j]:
                    low, high = sorted((want[i], want[j]))
                    want = [low if r == high else r for r in want]
        assert [got.index(r) for r in got] == [want.index(r) for r in want]
        assert block.derived > 10


@pytest.mark.parametrize("block", [set_join.BLOCK, 2000])
def test_components(spark, monkeypatch, block):
    """Also with blocks so small that components are split over many."""
    rng = random.Random(block)
    texts = made(rng) + ["just two", "Just  two", "just three", None, "", " "]
    words = [f"h{i}" for i in range(150)]
    texts += [" ".join(edited(rng, words, rng.choice((1, 2, 4, 6)))) for _ in range(60)]  # many below the limit of each other
    monkeypatch.setattr(set_join, "BLOCK", block)
    check(spark, [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))])


def test_edges(spark):
    a = " ".join(map(str, range(80)))
    check(spark, [(1, a), (1, a), (None, a.upper()), (2, a.replace("7", "x", 1)), (None, "alone here"), (3, None), (3, None), (4, ""), (5, "y " * 300_000), (6, "y " * 9)])
    assert set_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_set_join(spark, sf).collect())) == sorted(brute(rows))
