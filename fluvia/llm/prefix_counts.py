"""Exact token counts at every prefix, by dynamic programming.

For BPE, the tokens of a prefix are the tokens of a shorter prefix and one last token: of all pieces that end at a
place, exactly one is compatible with the last token before it. So one pass over a text finds the last token, and with
it the count, of every prefix. The counts are stored as one signed byte a code point, the change from the prefix
before; truncation to a budget, the count of any prefix and checks against limits are sums of those bytes, and the
text is never encoded again.

The vocabulary is a SentencePiece BPE model: blanks become U+2581, one is put before the text, code points that are
in no piece cost a token for each of their bytes. No piece has U+2581 after another character, so a text is cut into
chunks before each run of U+2581 and the counts of a chunk are found once and memoised.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merges import Merges
from .segments import Memo, clean

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

_LOADED: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """The pieces of a model with their automaton; made once per Python worker."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model, plain = self.model, range(self.model.get_piece_size())
        self.rank = {
            model.id_to_piece(i): -model.get_score(i)
            for i in plain
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece crosses words; chunks need U+2581 at the start of pieces only")
        self.merges = Merges(self.rank)
        self.automaton = ahocorasick.Automaton()
        for piece in filter(self.merges.sound, self.rank):
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.chunks = Memo(self._chunk, most=300_000)

    def counts(self, chunk: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... code points of one chunk."""
        last, count, known, merges = [""], [0], self.merges.pairs, self.merges
        done = 0
        for end, piece in self.automaton.iter(chunk):  # by end, longest first
            if end < done:
                continue
            at = end + 1 - len(piece)
            if end > done:
                self._bytes(chunk, done, end, last, count)
                done = end
            if before := last[at]:
                fits = known.get((before, piece))
                if not (merges.compatible(before, piece) if fits is None else fits):
                    continue
            last.append(piece)
            count.append(count[at] + 1)
            done += 1
        self._bytes(chunk, done, len(chunk), last, count)
        return count

    @staticmethod
    def _bytes(chunk: str, start: int, end: int, last: list[str], count: list[int]) -> None:
        """Code points that end no piece: a token a byte, and no neighbour merges with them."""
        for char in chunk[start:end]:
            last.append("")
            count.append(count[-1] + len(char.encode("utf-8", "surrogatepass")))

    def _chunk(self, chunk: str) -> bytes:
        count = self.counts(chunk)
        return array("b", map(sub, count[1:], count)).tobytes()

    def changes(self, text: str | None) -> bytes:
        """One signed byte for each code point of the text: tokens that its prefix has more than the one before."""
        text = clean(text)
        if not text:
            return b""
        normal = self.model.normalize(text)
        if len(normal) != len(text) + 1:
            raise ValueError("the model's normalizer changes more than blanks; prefixes have no place of their own")
        found = b"".join(map(self.chunks.__getitem__, CHUNK.findall(normal)))
        head = np.frombuffer(found[:2], np.int8).sum(dtype=np.int8).tobytes()  # the mark before the text has no code point
        return head + found[2:]


def counter(path: str) -> PrefixCounter:
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def prefix_counts(changes: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... code points."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)))


def fitting_prefix(changes: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(changes) <= budget)[-1])


def with_prefix_counts(docs: DataFrame, path: str, text: str = "text", out: str = "prefix_changes") -> DataFrame:
    """Adds ``out``, a binary column: the change of the token count at each code point of the whole text.

    Null and empty texts give an empty value. Special strings are ordinary text. Rows and other columns stay.
    """

    @F.arrow_udf("binary")
    def changes(texts: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array([own.changes(t.as_py()) for t in texts], pa.binary())

    return docs.withColumn(out, changes(F.col(text)))


def count_at(changes: str, length: Column) -> Column:
    """Tokens of the prefix of ``length`` code points (all if longer), from the stored column, without encoding."""

    @F.arrow_udf("long")
    def count(stored: pa.Array, lengths: pa.Array) -> pa.Array:
        return pa.array(
            int(np.frombuffer((s.as_py() or b"")[: max(0, k.as_py() or 0)], np.int8).sum(dtype=np.int64))
            for s, k in zip(stored, lengths, strict=True)
        )

    return count(F.col(changes), length)


def truncate_to(text: str, changes: str, budget: int) -> Column:
    """The longest prefix of the text with at most ``budget`` tokens, from the stored column, without encoding."""

    @F.arrow_udf("long")
    def fit(stored: pa.Array) -> pa.Array:
        return pa.array([fitting_prefix(s.as_py() or b"", budget) for s in stored], pa.int64())

    return F.left(F.col(text), fit(F.col(changes)).cast("int"))


def _summaries(batches: Iterator[pa.RecordBatch], path: str, budget: int) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        rows = []
        for t in batch.column(1):
            text = clean(t.as_py())
            changes = own.changes(text)
            total = int(np.frombuffer(changes, np.int8).sum(dtype=np.int64))
            fits = len(text) if total <= budget else fitting_prefix(changes, budget)
            rows.append((len(text.encode("utf-8", "surrogatepass")), total, fits))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_bytes", "n_tokens", "fitting_chars"])


def token_counts(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, fitting_chars``: bytes and tokens of the whole text (null: empty), and the code
    points of its longest prefix within ``budget`` tokens, all from the prefix counts of one pass."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    made = own.mapInArrow(lambda b: _summaries(b, path, budget), f"id {kind}, n_bytes long, n_tokens long, fitting_chars long")
    return made.withColumnRenamed("id", id_col)
