"""Harmonic packing of token sequences.

A document of at most ``capacity`` tokens has the class k = floor(capacity / length), and a bin of class k takes exactly
k whole documents of its class. So each worker fills the bins of each class by counting, without looking at any other
class or worker. What a full bin leaves, less than one document of its class, is filled by pieces of longer documents,
which have to be cut anyway; only where none are at hand is the next document cut for it. What is left of long documents
makes sequences of its own. When a worker's rows end, gaps are filled and open bins emptied into sequences without gaps,
so at most one sequence a worker is padded. Only open bins, a bounded number of gaps and a bounded supply are held.
"""

from __future__ import annotations

import json
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .segments import Memo, blocks, clean, segment_pattern

_LOADED: dict[str, "Encoder"] = {}


def _letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the
    others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of the tokenizer file, with a bounded memo of segments.

    The file's vocabulary also serves as ranks for ``tiktoken``, which gives the same ids for short segments in less
    time; long ones and the file's special strings go through the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str, longest: int = 200) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, self.longest = _letters(), longest
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.segments, self.cut = Memo(self._segment, most=150_000), segment_pattern()

    def _segment(self, segment: str) -> bytes:
        if len(segment) <= self.longest:
            return array("I", self.fast.encode_ordinary(segment)).tobytes()
        return self._whole(segment)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        text = clean(text)
        if any(s in text for s in self.special):
            return self._whole(text)
        return b"".join([x for found in blocks(self.cut, text) for x in map(self.segments.__getitem__, found)])


def encoder(path: str, pattern: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, pattern)
    return _LOADED[path]


class Bins:
    """One worker's open bins. A piece is ``(id, start, ids, doc_tokens)``; ``done`` gets pieces with their sequence and
    offset."""

    def __init__(self, capacity: int, first: int, gaps: int = 64, supply: int = 32) -> None:
        self.capacity, self.next, self.most_gaps = capacity, first, gaps
        self.most_supply = supply * capacity
        self.open: dict[int, list[tuple]] = {}
        self.gaps: deque[tuple[list[tuple], int]] = deque()  # full bins and what they leave
        self.supply: deque[tuple] = deque()  # documents to cut
        self.held = 0  # tokens of the supply
        self.done: list[tuple] = []

    def add(self, key: object, ids: bytes) -> None:
        size = len(ids) // 4
        if size > self.capacity or len(self.gaps) >= self.most_gaps:
            self._supply([(key, 0, ids, size)])
            self._fill()
            while self.held > self.most_supply:
                self._close(self._taken(self.capacity))
            return
        kind = self.capacity // size
        held = self.open.setdefault(kind, [])
        held.append((key, 0, ids, size))
        if len(held) == kind:
            self._full(self.open.pop(kind))

    def _supply(self, pieces: list[tuple]) -> None:
        self.supply += pieces
        self.held += sum(p[3] for p in pieces)

    def _full(self, pieces: list[tuple]) -> None:
        left = self.capacity - sum(len(p[2]) for p in pieces) // 4
        self.gaps.append((pieces, left))
        self._fill()

    def _fill(self) -> None:
        """Closes the bins whose gaps the supply fills."""
        while self.gaps and self.gaps[0][1] <= self.held:
            pieces, left = self.gaps.popleft()
            self._close(pieces + self._taken(left))

    def _taken(self, size: int) -> list[tuple]:
        """Pieces of the supply with ``size`` tokens in all, or what there is."""
        out: list[tuple] = []
        while size and self.supply:
            key, at, ids, whole = self.supply.popleft()
            n = min(size, whole - at)
            out.append((key, at, ids[4 * at : 4 * (at + n)], whole))
            if at + n < whole:
                self.supply.appendleft((key, at + n, ids, whole))
            size -= n
            self.held -= n
        return out

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, whole in pieces:
            n = len(ids) // 4
            self.done.append((key, start, n, whole, self.next, offset, ids))
            offset += n
        self.next += 1

    def finish(self) -> None:
        """Closes all bins: what is open is the supply of the gaps, shortest classes first, then of whole sequences.
        Where that is not enough, full bins are emptied for the gaps of others."""
        for kind in sorted(self.open, reverse=True):
            self._supply(self.open[kind])
        self.open = {}
        while self.gaps:
            pieces, left = self.gaps.popleft()
            while self.held < left and self.gaps:
                self._supply(self.gaps.pop()[0])
            self._close(pieces + self._taken(left))
        while self.supply:
            self._close(self._taken(self.capacity))


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of all documents, each in a sequence of at most ``capacity`` tokens.

    Returns ``id_col, start, length, doc_tokens, sequence_id, offset, ids``: where the piece starts in its document,
    its tokens, the document's tokens (with ``end_id``), its sequence, its place there, and its ids as little-endian
    unsigned 32-bit integers. Null and empty texts are ``end_id`` alone. Repeated rows and ids are packed once each;
    a null id stays null. No rows give no rows. Other columns, whatever their names, are not read. A text of any length
    is encoded in blocks; its ids are held whole. ``sequence_id`` is unique over all workers, not dense.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    end = array("I", [end_id]).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        shape = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*bins.done, strict=True)) or [[]] * len(shape)
            bins.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        for batch in batches:
            if shape is None:
                numbers = ("start", "length", "doc_tokens", "sequence_id", "offset")
                shape = pa.schema([("id", batch.schema.field(0).type), *((n, pa.int64()) for n in numbers), ("ids", pa.binary())])
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bins.add(key, coder.encode(t.as_py()) + end)
                if len(bins.done) >= 4096:
                    yield flush()
        coder.segments.clear()  # the worker goes on to other tasks, also of other stages
        if shape is not None:
            bins.finish()
            yield flush()

    kind = own.schema["id"].dataType.simpleString()
    columns = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return own.mapInArrow(work, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
