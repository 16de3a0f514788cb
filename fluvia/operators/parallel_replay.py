"""Replay of keys with very many rows by ranges that run side by side.

What a machine does at a row may depend on all rows before, so a range of a key cannot start without the state that the
range before leaves. Each range first runs from an empty start, which gives it an end state by assumption. Then every
range runs again from the end state of the range before, next to its assumed run, and only as far as the two states
differ: once they agree, so does all that follows, and the range's end state stands. Machines whose windows run dry or
reset agree soon. This goes on while end states change, for some rounds; then one pass over all ranges gives the rows.
Keys that have not come to rest by then are replayed row by row in one task, which is exact as well.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .custom import map_rows
from .ranges import range_bucket

ROUNDS = 4
_PART, _ROWS = "__fluvia_part", "__fluvia_is_row"
_ENDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType()), T.StructField("state", T.BinaryType())])
_FIXED = T.StructType([_ENDS["part"], T.StructField("fixed", T.BinaryType())])


def _same(a: object, b: object) -> bool:
    return vars(a) == vars(b)


def _load(state: bytes | None, start: Callable[[], object]) -> object:
    return start() if state is None else pickle.loads(bytes(state))


class _Ranges:
    """Feeds sorted rows to one visitor for each range; what a range is given comes first, as a row without data."""

    def __init__(self, visit: Callable[[int, dict], object], keys: Sequence[str]) -> None:
        self.visit, self.keys = visit, list(keys)

    def __call__(self, batches: Iterator[list[dict]]) -> Iterator[list[dict]]:
        part, visitor = None, None
        for rows in batches:
            made: list[dict] = []
            for row in rows:
                own, is_row = row.pop(_PART), row.pop(_ROWS)
                given = {c: row.pop(f"__fluvia_given_{c}") for c in ("old", "new", "ends", "skip")}
                if own != part:
                    made += visitor.done() if visitor else []
                    part, visitor = own, self.visit(own, {} if is_row else given)
                if is_row:
                    made += visitor.row(tuple(row[k] for k in self.keys), row)
            yield made
        if visitor:
            yield visitor.done()


class _Assume:
    """Runs a range from an empty start and tells how it ends."""

    def __init__(self, part: int, start: Callable[[], object]) -> None:
        self.part, self.start, self.first, self.last, self.machine = part, start, None, None, None

    def row(self, key: tuple, row: dict) -> list[dict]:
        if self.machine is None or key != self.last:
            self.machine, self.last = self.start(), key
            self.first = key if self.first is None else self.first
        self.machine.row(row)
        return []

    def done(self) -> list[dict]:
        if self.machine is None:
            return []
        return [{"part": self.part, "first": pickle.dumps(self.first), "last": pickle.dumps(self.last), "state": cloudpickle.dumps(self.machine)}]


class _Compare:
    """Runs the first key of a range from an assumed and from a corrected start until they agree."""

    def __init__(self, part: int, start: Callable[[], object], old: bytes | None, new: bytes | None) -> None:
        self.part, self.key, self.over = part, None, False
        self.old, self.new = _load(old, start), _load(new, start)

    def row(self, key: tuple, row: dict) -> list[dict]:
        self.key = key if self.key is None else self.key
        if self.over or key != self.key:
            self.over = True
            return []
        self.old.row(dict(row))
        self.new.row(row)
        self.over = _same(self.old, self.new)
        return []

    def done(self) -> list[dict]:
        return [] if self.over or self.key is None else [{"part": self.part, "fixed": cloudpickle.dumps(self.new)}]


class _Give:
    """Runs a range from its true start and lets its rows out; ``skip`` are keys that are replayed otherwise."""

    def __init__(self, start: Callable[[], object], given: dict, skip: frozenset[bytes]) -> None:
        self.start, self.new, self.ends, self.skip = start, given.get("new"), given.get("ends"), skip
        self.key, self.machine, self.left = None, None, False

    def row(self, key: tuple, row: dict) -> list[dict]:
        out: list[dict] = []
        if self.machine is None or key != self.key:
            out = self.machine.end() if self.machine and not self.left else []
            self.machine = _load(self.new if self.machine is None else None, self.start)
            self.key, self.left = key, pickle.dumps(key) in self.skip
        return out if self.left else out + self.machine.row(row)

    def done(self) -> list[dict]:
        return self.machine.end() if self.machine and self.ends and not self.left else []


def replay_by_ranges(df: DataFrame, key: Sequence[str], order_by: Sequence[str], schema: T.StructType, start: Callable[[], object], rounds: int = ROUNDS) -> tuple[DataFrame, list[tuple]]:
    """As ``keyed.replay`` for keys that are not at rest after ``rounds``; those are the second result, at most one for
    each two ranges. Machines must be pickled and compared by their fields."""
    keys = list(key)
    rows = df.withColumn(_PART, range_bucket(df, [*keys, *order_by])).withColumn(_ROWS, F.lit(True))

    def fed(given: DataFrame | None, visit: Callable, out: T.StructType) -> DataFrame:
        kinds = {"old": "binary", "new": "binary", "ends": "boolean", "skip": "boolean"}
        both = rows.withColumns({f"__fluvia_given_{c}": F.lit(None).cast(k) for c, k in kinds.items()})
        if given is not None:
            lead = given.select(F.col("part").alias(_PART), F.lit(False).alias(_ROWS), *(F.col(c).alias(f"__fluvia_given_{c}") for c in kinds if c in given.columns))
            both = both.join(F.broadcast(given.select(F.col("part").alias(_PART))), _PART, "left_semi").unionByName(lead, allowMissingColumns=True)
        dealt = both.repartition(_PART).sortWithinPartitions(_PART, _ROWS, *keys, *order_by)
        return map_rows(dealt, _Ranges(visit, keys), out)

    by_part = Window.orderBy("part")  # a row for each range

    def hold(found: DataFrame) -> DataFrame:
        """The table with its past cut off: as rows from the driver if they are few bytes, else persisted."""
        held = found.persist()
        if not _small(held):
            return held
        rows = held.collect()
        held.unpersist()
        return df.sparkSession.createDataFrame(rows, found.schema)

    def starts(ends: DataFrame) -> DataFrame:
        own = F.lag("last").over(by_part) == F.col("first")
        over = F.coalesce(F.lead("first").over(by_part) != F.col("last"), F.lit(True))
        return ends.select("*", F.when(own, F.lag("state").over(by_part)).alias("new"), over.alias("ends"))

    ends = hold(fed(None, lambda part, given: _Assume(part, start), _ENDS).withColumn("old", F.lit(None).cast("binary")))
    for _ in range(rounds):
        now = hold(starts(ends))
        changed = now.filter(~F.col("new").eqNullSafe(F.col("old"))).select("part", "old", "new")
        if changed.isEmpty():
            break
        fixed = fed(changed, lambda part, given: _Compare(part, start, given.get("old"), given.get("new")), _FIXED)
        ends = hold(now.join(fixed, "part", "left").select("part", "first", "last", F.coalesce("fixed", "state").alias("state"), F.col("new").alias("old")))
    now = hold(starts(ends))
    open_keys = now.filter(~F.col("new").eqNullSafe(F.col("old"))).select("first").distinct().collect()
    skip = frozenset(bytes(r["first"]) for r in open_keys)
    given = now.select("part", F.col("old").alias("new"), "ends")
    found = fed(given, lambda part, g: _Give(start, g, skip), schema)
    return found, [pickle.loads(k) for k in skip]


def _small(ends: DataFrame, most: int = 64 << 20) -> bool:
    """Whether the states of all ranges together are few bytes."""
    each = F.lit(200) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ends.columns if c in ("first", "last", "state", "old", "new"))
    return ends.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0] <= most
