"""User code on rows: functions from one row to none, one or many, over shuffled or grouped rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes of values of a batch that are held as rows at once, and rows that are made before they are handed on.
SLICE_BYTES = 1 << 20
MADE_ROWS = 10_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``SLICE_BYTES``, whole rows each."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        piece = batch.slice(at, rows)
        if piece.num_rows > 1 and piece.nbytes > 2 * SLICE_BYTES:  # rows of very different lengths
            half = piece.num_rows // 2
            yield from slices(piece.slice(0, half))
            yield from slices(piece.slice(half))
        else:
            yield piece


def map_rows(df: DataFrame, work: Callable[[Iterator[list[dict]]], Iterator[list[dict]]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` on rows as dicts: values keep their types, so long integers beside nulls stay exact. Missing
    fields are null. A task holds a slice of a batch as rows, and what ``work`` yields at once; the lists that it yields
    may have any lengths."""
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in work(piece.to_pylist() for batch in batches for piece in slices(batch)):
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in kind]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return df.mapInArrow(run, schema)


def bolt(
    df: DataFrame,
    work: Callable,
    schema: str,
    wire: str = "shuffle",
    key: Sequence[str] = (),
    order_by: Sequence[str] = (),
    fresh: bool = False,
) -> DataFrame:
    """Rows through ``work``, which takes a row as a dict and gives a list of dicts in ``schema``.

    ``wire`` is ``shuffle`` (rows stay where they are) or ``group`` (rows of equal ``key`` go to one task, sorted by
    ``order_by``). With ``fresh``, ``work`` is a class or factory of which each task makes its own, so it may hold
    state. A row that fails stops the job; use ``guarded`` to divert it.
    """
    if wire == "group":
        df = df.repartition(*key).sortWithinPartitions(*key, *order_by)
    elif wire != "shuffle":
        raise ValueError(f"unknown wire {wire}")
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[list[dict]]) -> Iterator[list[dict]]:
        own = work() if fresh else work
        made: list[dict] = []
        for rows in batches:
            for row in rows:
                made += own(row) or ()
                if len(made) >= MADE_ROWS:
                    yield made
                    made = []
        yield made

    return map_rows(df, run, kind)


def guarded(work: Callable, on_error: Callable[[dict, Exception], list[dict]]) -> Callable:
    """``work`` whose failures become rows of their own."""

    def run(row: dict) -> list[dict]:
        try:
            return work(row)
        except Exception as error:
            return on_error(row, error)

    return run
