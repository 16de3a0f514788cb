"""Byte-level BPE by backtracking from longest matches, with decoding.

A sequence of tokens is the one that merging by rank gives exactly if every token is what its own bytes merge to and
every two neighbours stay apart when merged together. So the encoder takes the longest token that starts at a
place (read off an Aho-Corasick automaton over the bytes, written as Latin-1), keeps it if it is compatible with the
token before, else tries the next shorter one, and steps back when none is left; places that failed are never tried
again, which makes it linear in the bytes. Compatibility of two neighbours is decided once, by merging their few
bytes, and memoised.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import Merges
from .segments import Memo, blocks, clean, segment_pattern, spelled_out

_LOADED: dict[tuple[str, str], "BytePairs"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class BytePairs:
    """A vocabulary with its automaton; made once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.pattern, self.cut = spelled_out(pattern), segment_pattern()
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.widest = max(self.sizes.values())
        self.longest = Memo(self._longest, most=200_000, longest=self.widest)
        self.merges = Merges(ranks)
        self.shorter: dict[int, int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces = Memo(self._piece)
        self.segments = Memo(self._segment)
        self.decoded = Memo(self._bytes, longest=4 * 48)

    def _sound(self, token: int) -> bool:
        return self.merges.sound(self.tokens[token])

    def _shorter(self, token: int) -> int:
        """The next shorter sound token that starts with the same bytes; -1 if none."""
        if (found := self.shorter.get(token)) is None:
            data, found = self.tokens[token], -1
            for n in range(len(data) - 1, 0, -1):
                if (i := self.ranks.get(data[:n])) is not None and self._sound(i):
                    found = i
                    break
            self.shorter[token] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        if (found := self.apart.get((left, right))) is None:
            if len(self.apart) >= 500_000:
                self.apart.clear()
            found = self.apart[left, right] = self.merges.apart(self.tokens[left], self.tokens[right])
        return found

    def _longest(self, path: str) -> int:
        """The longest sound token that starts a path of the automaton."""
        data = path.encode("latin-1")
        for n in range(len(data), 0, -1):
            if (i := self.ranks.get(data[:n])) is not None and self._sound(i):
                return i
        raise ValueError(f"no token for byte {data[:1]!r}")

    def backtrack(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        latin, n, widest, sizes = data.decode("latin-1"), len(data), self.widest, self.sizes
        reach, longest, apart, shorter = self.automaton.longest_prefix, self.longest, self.apart, self._shorter
        pos, failed, out, last = 0, set(), [], -1
        token = longest[latin[: reach(latin[:widest])]]
        while pos < n:
            end = pos + sizes[token]
            fits = end not in failed
            if fits and last >= 0 and (fits := apart.get((last, token))) is None:
                fits = self._compatible(last, token)
            if fits:
                out.append(token)
                last, pos = token, end
                if pos < n:
                    token = longest[latin[pos : pos + reach(latin[pos : pos + widest])]]
                continue
            token = shorter(token)
            while token < 0:
                failed.add(pos)
                token = out.pop()
                pos -= sizes[token]
                token, last = shorter(token), out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> list[int]:
        return self.backtrack(piece.encode("utf-8", "surrogatepass"))

    def _segment(self, segment: str) -> tuple[bytes, str]:
        """Ids of a segment, and in decimal with a comma behind each."""
        ids: list[int] = []
        for piece in self.pattern.findall(segment):
            ids += self.pieces[piece]
        return array("I", ids).tobytes(), "".join(f"{i}," for i in ids)

    def _bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encoded(self, text: str | None) -> Iterator[list[tuple[bytes, str]]]:
        """What ``_segment`` makes of the segments of a text, block by block."""
        for found in blocks(self.cut, clean(text)):
            yield list(map(self.segments.__getitem__, found))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(ids for block in self.encoded(text) for ids, _ in block)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for. Raises ``KeyError`` on unknown ids."""
        return b"".join(self._bytes(ids[i : i + 1_000_000]) for i in range(0, len(ids), 1_000_000))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Tokens of a text, and the SHA-256 of its ids in decimal, joined by commas, and of its decoded ids."""
        count, written, back, rest = 0, hashlib.sha256(), hashlib.sha256(), b""
        for block in self.encoded(text):
            ids = [x[0] for x in block]
            count += sum(map(len, ids)) // 4
            listed = rest + "".join([x[1] for x in block]).encode()
            written.update(listed[:-1])
            rest = listed[-1:]  # the comma, unless nothing follows
            back.update(b"".join(map(self.decoded.__getitem__, ids)))
        return count, written.hexdigest(), back.hexdigest()


def byte_pairs(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of the whole text as little-endian unsigned 32-bit integers in a binary column.

    Null and empty texts give no ids. Special strings are ordinary text. Rows and other columns stay as they are.
    """

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        pairs = byte_pairs(path, pattern)
        return pa.array([pairs.encode(t.as_py()) for t in texts], pa.binary())

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that a binary column of ids stands for; null ids give none. Raises on unknown ids."""

    @F.arrow_udf("binary")
    def data(column: pa.Array) -> pa.Array:
        pairs = byte_pairs(path, pattern)
        return pa.array([pairs.decode(x.as_py() or b"") for x in column], pa.binary())

    return docs.withColumn(out, data(F.col(ids)))


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    pairs = byte_pairs(path, pattern)
    for batch in batches:
        found = list(zip(*(pairs.digests(t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * 3
        columns = [pa.array(x, kind) for x, kind in zip(found, (pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: ``id_col, n_tokens, ids_sha256`` (of the decimal ids joined by
    commas), ``decoded_sha256``.

    The digests are taken beside the encoder, so ids never leave the worker. Null texts are empty; empty texts have no
    ids and the digests of nothing. Repeated rows stay rows, no rows give no rows, and other columns, whatever their
    names, are not read. Texts are encoded in blocks, so one of any length needs little more than itself.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    made = own.mapInArrow(
        lambda batches: _digests(batches, path, pattern),
        f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return made.withColumnRenamed("id", id_col)
