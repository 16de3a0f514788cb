"""Custom inputs: user code that names the parts of a source and reads one part, as a Spark data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


#: Tasks a core that the parts of a source are dealt to at most.
TASKS = 4


class _Split(InputPartition):
    def __init__(self, value: object) -> None:
        self.value = value


def _dealt(parts: Sequence[object], tasks: int) -> list[_Split]:
    """Neighbouring parts together, in at most ``tasks`` splits of about equal numbers."""
    parts = list(parts)
    tasks = min(tasks, len(parts))
    return [_Split(parts[len(parts) * i // tasks : len(parts) * (i + 1) // tasks]) for i in range(tasks)]


def register(
    spark: SparkSession,
    name: str,
    schema: str,
    splits: Callable[[Mapping[str, str]], Sequence[object]],
    rows: Callable[[object, Mapping[str, str]], Iterator[tuple]],
) -> None:
    """Makes ``spark.read.format(name).options(...).load()`` read a source of one's own.

    ``splits(options)`` runs on the driver and lists the parts, which are small and can be pickled; ``rows(part, options)``
    runs in a task and yields a part's tuples in the order of ``schema``; many small parts share a task, one after the other, so
    that there are at most ``TASKS`` tasks a core. A task that is lost reads its parts again, so ``rows`` should give the
    same rows for the same part. No parts give no rows.
    """
    tasks = TASKS * spark.sparkContext.defaultParallelism

    class Reader(DataSourceReader):
        def __init__(self, options: Mapping[str, str]) -> None:
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            return _dealt(splits(self.options), tasks) or [_Split([])]

        def read(self, partition: _Split) -> Iterator[tuple]:
            return (row for part in partition.value for row in rows(part, self.options))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> Reader:
            return Reader(self.options)

    spark.dataSource.register(Source)


def register_stream(
    spark: SparkSession,
    name: str,
    schema: str,
    latest: Callable[[Mapping[str, str]], dict],
    splits: Callable[[dict, dict, Mapping[str, str]], Sequence[object]],
    rows: Callable[[object, Mapping[str, str]], Iterator[tuple]],
    start: Callable[[Mapping[str, str]], dict] = lambda options: {},
    done: Callable[[dict, Mapping[str, str]], None] | None = None,
) -> None:
    """Makes ``spark.readStream.format(name).options(...).load()`` read a growing source of one's own.

    Offsets are small dicts that can be JSON: ``start(options)`` is that of a new query, ``latest(options)`` how far the
    source reaches now. ``splits(from, to, options)`` lists the parts between two offsets and ``rows`` reads one in a task,
    as in ``register``. Spark writes the offsets of a micro-batch to the query's checkpoint before it reads them, so a
    query that starts again reads the same parts again or goes on behind them: the source must give the same rows for
    the same offsets until ``done(to, options)`` says that all before ``to`` are no longer needed.
    """
    tasks = TASKS * spark.sparkContext.defaultParallelism

    class Reader(DataSourceStreamReader):
        def __init__(self, options: Mapping[str, str]) -> None:
            self.options = dict(options)

        def initialOffset(self) -> dict:
            return start(self.options)

        def latestOffset(self) -> dict:
            return latest(self.options)

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return _dealt(splits(start, end, self.options), tasks) or [_Split([])]

        def read(self, partition: _Split) -> Iterator[tuple]:
            return (row for part in partition.value for row in rows(part, self.options))

        def commit(self, end: dict) -> None:
            if done is not None:
                done(end, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: object) -> Reader:
            return Reader(self.options)

    spark.dataSource.register(Source)
