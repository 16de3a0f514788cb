"""Ranked search against a plain scan."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fluvia.llm import ball_tree, queries


def brute(docs, items, k=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))
    bags = [(i, Counter(find(t))) for i, t in docs]
    n_docs, n_all = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 50 + 50 * b.total() * n_docs // n_all if n_all else 50
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(find(text)) if b[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def key(row):
    return tuple((v is not None, v or 0) for v in row)


def test_terms(monkeypatch):
    for t in [None, "", "A-b_C 1é2 \x00x\x7fY", "Ünï·code 🙂x", "a" * 50 + " b"]:
        want = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
        assert [w for b in ball_tree.term_blocks(t) for w in b] == want
        monkeypatch.setattr(ball_tree, "BLOCK", 4)
        assert [w for b in ball_tree.term_blocks(t) for w in b] == want
        monkeypatch.undo()


def test_bounds_hold():
    """No document has more in common with a query than the bound of any node above it, and most leaves are left out."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 12, 500)
    terms = np.concatenate([rng.choice(30, s, False) + 30 * (i % 2) for i, s in enumerate(sizes)])
    values = rng.random(len(terms)) * 1e6
    tree = ball_tree.Tree(np.cumsum(sizes), terms, values, 60)
    rows = np.zeros((500, 60))
    rows[np.repeat(np.arange(500), sizes), terms] = values
    asked = rng.random((60, 20)) * (rng.random((60, 20)) < 0.2)
    exact, bounds = rows[tree.order] @ asked, tree.bounds(asked, np.linalg.norm(asked, axis=0))
    for (lo, hi), bound in zip(tree.spans, bounds, strict=True):
        assert (exact[lo:hi] <= bound).all()
    assert sorted(tree.order.tolist()) == list(range(500))


@pytest.mark.parametrize(("items_a_block", "k"), [(512, 50), (3, 4)])
def test_rank(spark, monkeypatch, items_a_block, k):
    rng = random.Random(k)
    monkeypatch.setattr(ball_tree, "ITEMS", items_a_block)
    monkeypatch.setattr(ball_tree, "TREE", 64)
    monkeypatch.setattr(ball_tree, "PROBE", 40)
    words = [f"{c}{i}" for c in "abé" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(300)]
    docs += docs[:20] + [(None, docs[3][1]), (None, None), (900, ""), (901, "-- \n"), (902, docs[4][1]), (903, "a1 " * 200_000)]
    items = [(i, text(rng.randint(1, 9))) for i in range(8)] + [(3, "a1 A1-a1"), (3, "a1 A1-a1"), (None, "b2"), (99, None), (98, "nowhere")]
    rng.shuffle(docs)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = ball_tree.rank(d, b, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items, k), key=key)


def test_empty_tables(spark, sf):
    docs, items = (queries.read(spark, sf, t) for t in ("documents", "benchmark"))
    for d, b in ((docs.limit(0), items), (docs, items.limit(0))):
        got = ball_tree.rank(d, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_query(spark, sf):
    docs, items = ([tuple(r) for r in queries.read(spark, sf, t).select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, queries.op11_ball_tree_search(spark, sf).collect())) == sorted(brute(docs, items))
