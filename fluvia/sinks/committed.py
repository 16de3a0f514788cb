"""Custom sinks in two steps: tasks stage what they write, and the driver makes all of it count at once, or none."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


@dataclass
class _Staged(WriterCommitMessage):
    value: object


def register(
    spark: SparkSession,
    name: str,
    stage: Callable[[Iterator[Row], Mapping[str, str]], object],
    commit: Callable[[Sequence[object], Mapping[str, str], int | None], None],
    abort: Callable[[Sequence[object], Mapping[str, str]], None] = lambda staged, options: None,
) -> None:
    """Makes ``df.write.format(name).options(...).mode("append").save()`` and ``writeStream.format(name)`` write to a sink
    of one's own.

    ``stage(rows, options)`` runs in each task, puts its rows where nobody reads them yet and returns a small value that
    names them. When all tasks are done, ``commit(staged, options, batch)`` runs once on the driver and makes them count;
    if any task failed for good, ``abort(staged, options)`` gets what the others had staged. ``batch`` is the number of a
    stream's micro-batch, None in a batch job; a stream that starts again may commit its last micro-batch a second
    time, so ``commit`` should then find that it has been there. A task that ran twice may leave something staged that no
    value names.
    """

    def values(messages: Sequence[WriterCommitMessage | None]) -> list[object]:
        return [m.value for m in messages if m is not None]

    class Writer(DataSourceWriter):
        def __init__(self, options: Mapping[str, str]) -> None:
            self.options = dict(options)

        def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
            return _Staged(stage(iterator, self.options))

        def commit(self, messages: list[WriterCommitMessage | None]) -> None:
            commit(values(messages), self.options, None)

        def abort(self, messages: list[WriterCommitMessage | None]) -> None:
            abort(values(messages), self.options)

    class StreamWriter(DataSourceStreamWriter):
        def __init__(self, options: Mapping[str, str]) -> None:
            self.options = dict(options)

        def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
            return _Staged(stage(iterator, self.options))

        def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
            commit(values(messages), self.options, batchId)

        def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
            abort(values(messages), self.options)

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: object, overwrite: bool) -> Writer:
            return Writer(self.options)

        def streamWriter(self, schema: object, overwrite: bool) -> StreamWriter:
            return StreamWriter(self.options)

    spark.dataSource.register(Sink)
