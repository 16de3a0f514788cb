"""Packing, prefix counts and byte-level BPE against the public libraries."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluvia.llm import byte_bpe, packing, prefix_counts, segments

PIECES = [
    " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "b", "the", "ing", "'s", "'ll", "1", "23", "é", "ß", "中", "文",
    "日本", "🙂", "́", "!", "...", "<|endoftext|>", "​", "А", "б", "ع", "\x00", "ﬁ", "Z", " the", "<s>", "²", "▁",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(3)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 16))) for _ in range(1500)]
    own = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return ["", " ", "a" * 5000, "ab" * 3000, " " * 3000, *made, *own]


def docs(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate([None, *texts])]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column with a clashing name


def test_byte_bpe_equals_library(texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.byte_pairs(path, P.PATTERN)
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    assert own.encode(None) == b""


def test_byte_bpe_on_spark(spark, texts):
    few = texts[:40]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = byte_bpe.decode(byte_bpe.encode(docs(spark, few).drop("ids"), path, P.PATTERN), path, P.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in df.collect()} == {i: (t or "").encode() for i, t in enumerate([None, *few])}
    made = byte_bpe.round_trip(docs(spark, few), path, P.PATTERN).collect()
    assert len(made) == len(few) + 1
    assert byte_bpe.round_trip(docs(spark, few).limit(0), path, P.PATTERN).collect() == []


def test_prefix_counts_equal_library(texts):
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = prefix_counts.counter(path)
    whole = [len(x) for x in library.encode(texts)]
    assert [int(prefix_counts.prefix_counts(own.changes(t))[-1]) for t in texts] == whole
    for t in texts[5:300:7]:
        counts = prefix_counts.prefix_counts(own.changes(t))
        assert counts.tolist() == [len(library.encode(t[:i])) for i in range(len(t) + 1)]


def test_prefix_counts_on_spark(spark, texts):
    path = P.path("piece_bpe_32k.model")
    df = prefix_counts.with_prefix_counts(docs(spark, texts[-20:]), path)
    got = df.select("text", prefix_counts.count_at("prefix_changes", F.lit(7)).alias("seven"), prefix_counts.truncate_to("text", "prefix_changes", 30).alias("cut")).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in got:
        if r["text"] is None:
            assert r["seven"] == 0 and r["cut"] is None
        else:
            assert r["seven"] == len(library.encode(r["text"][:7]))
            assert len(library.encode(r["cut"])) <= 30
    counted = {r["doc_id"]: r for r in prefix_counts.token_counts(docs(spark, texts[-20:]), path, 50).collect()}
    assert counted[0]["n_tokens"] == 0 and counted[0]["n_bytes"] == 0
    for i, t in enumerate(texts[-20:], 1):
        assert counted[i]["n_tokens"] == len(library.encode(t))
        assert len(library.encode(t[: counted[i]["fitting_chars"]])) <= 50


def every_code_point():
    """Code points, each between letters, behind a blank and a digit, and twice before a stop; some at a time. Of the
    planes without a letter, number or blank every 97th, of the others all."""
    spare = lambda c: 0x40000 <= c < 0xE0000 or c >= 0xF0000
    tables = re.compile("[" + segments.covered(r"\p{L}") + segments.covered(r"\p{N}") + segments.covered(r"\s") + "]")
    assert not any(tables.match(chr(c)) for c in range(0x40000, 0x110000))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not (spare(c) and c % 97)]
    for i in range(0, len(points), 40_000):
        yield "\n".join(f"a{c}b 1{c} {c}{c}!" for c in map(chr, points[i : i + 40_000]))


def test_every_code_point():
    """The cuts agree with both libraries on every code point, also those that Python's tables know otherwise."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.byte_pairs(path, P.PATTERN)
    other, packed = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text in every_code_point():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        assert np.frombuffer(packed.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_blocks_are_findall(texts):
    cut = segments.segment_pattern()
    for t in [*texts[:400], "".join(texts[3:300])]:
        for size in (1, 2, 7, 64):
            assert [x for found in segments.blocks(cut, t, size) for x in found] == cut.findall(t)
        assert "".join(cut.findall(t)) == t


def test_very_long_texts():
    """Some ten million characters, with and without blanks."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.byte_pairs(path, P.PATTERN)
    for text in ("The cat sat on the mat, 12 times. " * 300_000, "ab" * 1_000_000):
        count, _, back = own.digests(text)
        assert back == hashlib.sha256(text.encode()).hexdigest() and count < len(text)
    ids = packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN).encode("The cat sat on the mat, 12 times. " * 300_000)
    assert len(ids) // 4 == 300_000 * 10 + 1


@pytest.mark.parametrize("sizes", [[1, 1024, 1025, 5000, 3], [300] * 400, [1] * 3000, [700] * 300, [], [40_000, 2, 600, 600]])
def test_bins(sizes):
    """All tokens lie in exactly one place, a bin holds the documents of one class, and little is cut."""
    bins = packing.Bins(1024, 7)
    for i, n in enumerate(sizes):
        bins.add(i, np.full(n, i, "<u4").tobytes())
        assert bins.held <= 33 * 1024 + max(sizes) and len(bins.gaps) <= 64
    bins.finish()
    seen = sorted((key, start, start + n) for key, start, n, _, _, _, _ in bins.done)
    for i, n in enumerate(sizes):
        own = [(a, b) for k, a, b in seen if k == i]
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in itertools.pairwise(own))
    used, whole = Counter(), 0
    for _, start, n, doc, sequence, offset, ids in sorted(bins.done, key=lambda p: p[4:6]):
        assert used[sequence] == offset and len(ids) == 4 * n
        used[sequence] += n
        whole += n == doc
    assert sum(used.values()) == sum(sizes) and all(v <= 1024 for v in used.values())
    assert sum(v < 1024 for v in used.values()) <= 1


def test_short_documents_stay_whole(spark, sf):
    made = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), P.path("byte_bpe_50k.json"), P.PATTERN).toPandas()
    short = made[made.doc_tokens <= 1024]
    assert (short.length == short.doc_tokens).sum() > 0.85 * short.doc_id.nunique()


def test_packing(spark, texts):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs(spark, texts), path, P.PATTERN).select("*", F.crc32("ids").alias("crc")).toPandas()
    for i, t in enumerate([None, *texts]):
        own = rows[rows.doc_id == i].sort_values("start")
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(own.ids) == ids.tobytes()
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.crc == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    padding = 0
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length == own.offset).all()
        used = int(own.length.sum())
        assert used <= 1024
        padding += 0 if used & (used - 1) == 0 else 1024 - used
    assert padding < 0.03 * rows.length.sum()
    assert packing.pack(docs(spark, texts).limit(0), path, P.PATTERN).count() == 0
