"""Streaming forms of the keyed operators with ``transformWithState``.

State is kept in pieces: counters in a value, held rows and lines in lists and maps, each row on its own. A micro-batch
reads and writes what it adds, what it lets go and a few counters, however much a key holds. Within a micro-batch rows
are sorted by ``order_by``. Rows of a later micro-batch come later, unless ``late`` is given: then rows wait in state,
by the time in ``ts``, until the watermark passes them, so rows of any micro-batch fall in their place, and the result
is that of a batch ordered by ``ts`` and then ``order_by``; rows later than the watermark are dropped by Spark.

The session needs the RocksDB state store (``use_state_store``). Held rows are stored as pickled tuples in the order
of the stream's columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.route import Predicate, accept, holds
from ..operators.xml_scan import ElementScanner


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Work:
    """What an operator does with the rows of one key. ``begin`` reads its counters, ``save`` writes them and what it
    holds; in between ``row`` takes one row and ``end`` lets out what is held."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def begin(self) -> None:
        raise NotImplementedError

    def row(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def end(self) -> list[dict]:
        return []

    def save(self) -> None:
        raise NotImplementedError


class _Keyed(StatefulProcessor):
    def __init__(self, work: Work, names: Sequence[str], order_by: Sequence[str], idle_ms: int | None, ordered: bool) -> None:
        self.work, self.names, self.order_by, self.idle_ms, self.ordered = work, list(names), list(order_by), idle_ms, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work.open(handle)
        if self.ordered:
            self.waiting = handle.getMapState("waiting", "ms long", "rows array<binary>")
        elif self.idle_ms is not None:
            self.timer = handle.getValueState("timer", "ms long")

    def _work(self, rows: list[dict]) -> Iterator[Row]:
        self.work.begin()
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order_by]):  # nulls first
            yield from self._out(self.work.row(row))
        self.work.save()

    def _out(self, made: list[dict]) -> Iterator[Row]:
        for row in made:
            yield Row(**{n: row.get(n) for n in self.names})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if not self.ordered:
            yield from self._work([r.asDict() for r in rows])
            if self.idle_ms is not None:
                if self.timer.exists():
                    self.handle.deleteTimer(self.timer.get()[0])
                at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(at)
                self.timer.update((at,))
            return
        timeless, by_time = [], {}
        for r in rows:
            row = r.asDict()
            ms = row["__fluvia_at"]
            if ms is None:
                timeless.append(row)
            else:
                by_time.setdefault(ms, []).append(pickle.dumps(row))
        if timeless:
            yield from self._work(timeless)
        for ms, new in by_time.items():
            held = self.waiting.getValue((ms,)) if self.waiting.containsKey((ms,)) else None
            if held is None:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), ([*(held[0] if held else ()), *new],))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.ordered:
            ms = expiredTimerInfo.getExpiryTimeInMs()
            if self.waiting.containsKey((ms,)):
                rows = [pickle.loads(bytes(r)) for r in self.waiting.getValue((ms,))[0]]
                self.waiting.removeKey((ms,))
                yield from self._work(rows)
            return
        self.timer.clear()
        self.work.begin()
        yield from self._out(self.work.end())
        self.work.save()

    def close(self) -> None:
        pass


def keyed_stream(
    df: DataFrame,
    key: Sequence[str],
    order_by: Sequence[str],
    schema: T.StructType,
    work: Work,
    idle_ms: int | None = None,
    late: str | None = None,
    ts: str | None = None,
) -> DataFrame:
    """Rows of a stream through ``work`` by key. After ``idle_ms`` of the clock without rows a key's ``end`` comes; a query
    with such timers runs a batch at every trigger, with or without rows, so it never counts as having processed all that
    is available. ``late`` (like ``10 minutes``) puts rows in the order of ``ts`` across micro-batches; rows without a
    time come as they are."""
    if late is not None and (idle_ms is not None or ts is None):
        raise ValueError("an order by event time needs ts, and no idle_ms")
    if late is not None:
        at = F.col(ts).cast("timestamp")
        df = df.withColumns({"__fluvia_event": at, "__fluvia_at": F.unix_millis(at)}).withWatermark("__fluvia_event", late)
    mode = "EventTime" if late is not None else "None" if idle_ms is None else "ProcessingTime"
    run = _Keyed(work, schema.names, order_by, idle_ms, late is not None)
    return df.groupBy(*key).transformWithState(statefulProcessor=run, outputStructType=schema, outputMode="Append", timeMode=mode)


def _held(names: Sequence[str], row: Mapping[str, object]) -> bytes:
    return pickle.dumps(tuple(row[n] for n in names))


def _row(names: Sequence[str], held: bytes) -> dict:
    return dict(zip(names, pickle.loads(bytes(held)), strict=True))


class _Every(Work):
    """As ``keyed._EveryTtl``; only a key with a time limit stores a row, its first."""

    def __init__(self, n: int, sums: Sequence[str], names: Sequence[str], first: bool, ttl_ms: int | None, ends: bool) -> None:
        self.n, self.sums, self.names, self.first, self.ttl, self.heads = n, list(sums), list(names), first, ttl_ms, ends

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "size long, early boolean, since long, totals array<double>")
        self.head = handle.getValueState("head", "row binary")

    def begin(self) -> None:
        known = self.counts.get() if self.counts.exists() else None
        self.size, self.early, self.since, totals = known if known else (0, self.first, None, [0.0] * len(self.sums))
        self.totals, self.fresh, self.kept = list(totals), None, known is not None and self.heads and self.head.exists()

    def _flush(self) -> list[dict]:
        head = self.fresh or _row(self.names, self.head.get()[0])
        out = [head | dict(zip(self.sums, self.totals, strict=True)) | {"flushed": True}]
        self.size, self.early, self.since, self.totals = 0, self.first, None, [0.0] * len(self.sums)
        self.fresh, self.kept = None, False
        return out

    def row(self, row: dict) -> list[dict]:
        now = row["__fluvia_ms"]
        due = self.ttl is not None and self.since is not None and now is not None and now - self.since >= self.ttl
        out = self._flush() if due else []
        if self.heads and not self.kept and self.fresh is None:
            self.fresh = {n: row[n] for n in self.names}
        for i, k in enumerate(self.sums):
            v = row[f"__fluvia_{k}"]
            self.totals[i] += 0 if v is None else v
        self.size += 1
        if self.early or self.size >= self.n:
            out.append(row | dict(zip(self.sums, self.totals, strict=True)) | {"flushed": False})
            self.early, self.size, self.totals = False, 0, [0.0] * len(self.sums)
        elif self.since is None:
            self.since = now
        return out

    def end(self) -> list[dict]:
        return self._flush() if self.since is not None and self.size else []

    def save(self) -> None:
        self.counts.update((self.size, self.early, self.since, self.totals))
        if self.fresh is not None:
            self.head.update((_held(self.names, self.fresh),))
        elif not self.kept:
            self.head.clear()


def every_n(
    df: DataFrame,
    n: int,
    aggregates: Mapping[str, Column],
    order_by: Sequence[str],
    key: Sequence[str],
    when: Predicate = "true",
    first: bool = True,
    ttl_ms: int | None = None,
    ts: str | None = None,
    idle_ms: int | None = None,
    late: str | None = None,
) -> DataFrame:
    """Every ``n``-th matching row of each key with sums, as ``keyed.every_n``; sums are double columns.

    ``ttl_ms`` flushes unfinished groups by the time in ``ts`` of later rows, as ``keyed.every_n_ttl``; ``idle_ms`` by
    the clock, when no row comes.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")
    added = {f"__fluvia_{k}": c.cast("double") for k, c in aggregates.items()}
    rows = accept(df, when).withColumns(added | {"__fluvia_ms": ms})
    fields = [*df.schema.fields, *(T.StructField(k, T.DoubleType()) for k in aggregates), T.StructField("flushed", T.BooleanType())]
    work = _Every(n, list(aggregates), df.columns, first, ttl_ms, ttl_ms is not None or idle_ms is not None)
    return keyed_stream(rows, key, order_by, T.StructType(fields), work, idle_ms, late, ts)


class _Alert(Work):
    """As ``keyed._Alert``; the rows of a window are entries of a map by a running number, so those that leave are
    read and removed one by one."""

    def __init__(self, time_us: int | None, size: int | None, threshold: float, reset: bool) -> None:
        self.time, self.most, self.threshold, self.reset = time_us, size, threshold, reset

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "n long", "us long, amount double")
        self.ends = handle.getValueState("ends", "first long, next long, total double")

    def begin(self) -> None:
        self.first, self.next, self.total = self.ends.get() if self.ends.exists() else (0, 0, 0.0)
        self.stored, self.new, self.oldest = self.next, {}, None

    def _oldest(self) -> tuple[int, float]:
        if self.first >= self.stored:
            return self.new[self.first]
        if self.oldest is None:
            self.oldest = self.rows.getValue((self.first,))
        return self.oldest

    def _drop(self) -> None:
        self.total -= self._oldest()[1]
        if self.first < self.stored:
            self.rows.removeKey((self.first,))
        self.new.pop(self.first, None)
        self.first, self.oldest = self.first + 1, None

    def row(self, row: dict) -> list[dict]:
        now, amount = row["__fluvia_us"], row["__fluvia_amount"]
        amount = 0.0 if amount is None else amount
        while self.time is not None and self.first < self.next and self._oldest()[0] < now - self.time:
            self._drop()
        self.new[self.next] = (now, amount)
        self.next += 1
        self.total += amount
        while self.most is not None and self.next - self.first > self.most:
            self._drop()
        if self.total < self.threshold:
            return []
        out = [row | {"window_value": float(self.total)}]
        if self.reset:
            if self.first < self.stored:
                self.rows.clear()
            self.new, self.first, self.stored, self.total, self.oldest = {}, self.next, self.next, 0.0, None
        return out

    def save(self) -> None:
        for n, entry in self.new.items():
            self.rows.updateValue((n,), entry)
        self.ends.update((self.first, self.next, self.total))


def window_alert(
    df: DataFrame,
    threshold: float,
    key: Sequence[str],
    ts: str,
    order_by: Sequence[str],
    time: str | None = None,
    size: int | None = None,
    amount: Column | None = None,
    reset: bool = True,
    late: str | None = None,
) -> DataFrame:
    """Alerts of sliding windows, as ``keyed.window_alert``; rows without a time are not seen."""
    length = None if time is None else int(pd.Timedelta(time) / pd.Timedelta(microseconds=1))
    rows = df.withColumns({"__fluvia_us": F.unix_micros(F.col(ts).cast("timestamp")), "__fluvia_amount": F.lit(1.0) if amount is None else amount.cast("double")})
    schema = T.StructType([*df.schema.fields, T.StructField("window_value", T.DoubleType())])
    return keyed_stream(rows.filter("__fluvia_us is not null"), key, order_by, schema, _Alert(length, size, threshold, reset), None, late, ts)


class _Join(Work):
    """The newest lines of the open event are a ring of map entries; its last row is stored once a micro-batch."""

    def __init__(self, line: str, names: Sequence[str], delimiter: str, most: int, wait: int | None, out: str) -> None:
        self.line, self.names, self.delimiter, self.most, self.wait, self.out = line, list(names), delimiter, most, wait, out

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("lines", "place long", "line string")
        self.event = handle.getValueState("event", "lines long, at long, last binary")

    def begin(self) -> None:
        self.n, self.at, last = self.event.get() if self.event.exists() else (0, None, None)
        self.last = None if last is None else _row(self.names, last)
        self.stored, self.new = self.n, []

    def row(self, row: dict) -> list[dict]:
        now = row["__fluvia_ms"]
        over = self.wait is not None and None not in (now, self.at) and now - self.at > self.wait
        out = self.end() if self.n and (row["__fluvia_begins"] or over) else []
        self.new = [*self.new, row[self.line] or ""][-self.most :]
        self.n += 1
        self.last, self.at = {n: row[n] for n in self.names}, now
        return out

    def end(self) -> list[dict]:
        if not self.n:
            return []
        old = range(max(0, self.n - self.most), self.n - len(self.new))  # those that are still among the newest
        lines = [self.ring.getValue((i % self.most,))[0] for i in old] + self.new
        out = [self.last | {self.out: self.delimiter.join(lines)}]
        if self.stored:
            self.ring.clear()
        self.n, self.stored, self.new, self.last, self.at = 0, 0, [], None, None
        return out

    def save(self) -> None:
        for i, line in enumerate(self.new, self.n - len(self.new)):
            self.ring.updateValue((i % self.most,), (line,))
        self.event.update((self.n, self.at, None if self.last is None else _held(self.names, self.last)))


def join_lines(
    df: DataFrame,
    line: str,
    boundary: Predicate,
    order_by: Sequence[str],
    key: Sequence[str],
    delimiter: str = "\n",
    most: int = 1000,
    wait_ms: int | None = None,
    ts: str | None = None,
    idle_ms: int | None = 2000,
    out: str = "out",
    late: str | None = None,
) -> DataFrame:
    """Multi-line events, as ``keyed.join_lines``. The last event of a key comes out once no row has come for
    ``idle_ms`` of the clock; with None it waits for the next boundary."""
    ms = F.unix_millis(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")
    rows = df.withColumns({"__fluvia_begins": holds(boundary), "__fluvia_ms": ms})
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return keyed_stream(rows, key, order_by, schema, _Join(line, df.columns, delimiter, most, wait_ms, out), idle_ms, late, ts)


class _Batch(Work):
    """Held rows are a list that micro-batches append to."""

    def __init__(self, size: int, key: Sequence[str], names: Sequence[str], out: str) -> None:
        self.size, self.key, self.names, self.out = size, list(key), list(names), out

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("rows", "row binary")
        self.count = handle.getValueState("count", "n long")

    def begin(self) -> None:
        self.stored, self.new = self.count.get()[0] if self.count.exists() else 0, []

    def row(self, row: dict) -> list[dict]:
        self.new.append({n: row[n] for n in self.names})
        return self.end() if self.stored + len(self.new) >= self.size else []

    def end(self) -> list[dict]:
        rows = ([_row(self.names, r[0]) for r in self.held.get()] if self.stored else []) + self.new
        if self.stored:
            self.held.clear()
        self.stored, self.new = 0, []
        return [{k: rows[0][k] for k in self.key} | {self.out: rows}] if rows else []

    def save(self) -> None:
        if self.new:
            self.held.appendList([(_held(self.names, r),) for r in self.new])
        self.count.update((self.stored + len(self.new),))


def array_by_size(
    df: DataFrame, size: int, order_by: Sequence[str], key: Sequence[str], out: str = "rows", idle_ms: int | None = None, late: str | None = None, ts: str | None = None
) -> DataFrame:
    """Every ``size`` rows of a key as one row with their array; with ``idle_ms`` a rest comes out, too."""
    fields = [df.schema[k] for k in key] + [T.StructField(out, T.ArrayType(df.schema))]
    return keyed_stream(df, key, order_by, T.StructType(fields), _Batch(size, key, df.columns, out), idle_ms, late, ts)


class _Latest(Work):
    def __init__(self, out: str) -> None:
        self.out = out

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "value binary")

    def begin(self) -> None:
        self.value, self.changed = pickle.loads(bytes(self.latest.get()[0])) if self.latest.exists() else None, False

    def row(self, row: dict) -> list[dict]:
        if not row["__fluvia_stored"]:
            return [row | {self.out: self.value}]
        if row["__fluvia_value"] is not None:
            self.value, self.changed = row["__fluvia_value"], True
        return []

    def save(self) -> None:
        if self.changed:
            self.latest.update((pickle.dumps(self.value),))


def global_value(
    df: DataFrame, stores: Predicate, value: Column, key: Sequence[str], order_by: Sequence[str], out: str, late: str | None = None, ts: str | None = None
) -> DataFrame:
    """One stream of rows that store a value (where ``stores`` holds; they do not come out) and rows that read the
    latest one of their key. Nulls are not stored."""
    rows = df.withColumns({"__fluvia_value": value, "__fluvia_stored": holds(stores)})
    schema = T.StructType([*df.schema.fields, T.StructField(out, rows.schema["__fluvia_value"].dataType)])
    return keyed_stream(rows, key, order_by, schema, _Latest(out), None, late, ts)


class _Throttle(Work):
    def __init__(self, interval_ms: int, out: str) -> None:
        self.interval, self.out = interval_ms, out

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.release = handle.getValueState("release", "ms long")

    def begin(self) -> None:
        self.last = self.release.get()[0] if self.release.exists() else None

    def row(self, row: dict) -> list[dict]:
        tick = -(-row["__fluvia_ms"] // self.interval) * self.interval
        self.last = tick if self.last is None else max(tick, self.last + self.interval)
        return [row | {self.out: self.last}]

    def save(self) -> None:
        if self.last is not None:
            self.release.update((self.last,))


def throttle(df: DataFrame, interval_ms: int, ts: str, order_by: Sequence[str], key: Sequence[str], out: str = "release_ms", late: str | None = None) -> DataFrame:
    """When each row leaves its key's queue, as ``keyed.throttle``; rows without a time do not come out."""
    rows = df.withColumn("__fluvia_ms", F.unix_millis(F.col(ts).cast("timestamp"))).filter("__fluvia_ms is not null")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    return keyed_stream(rows, key, order_by, schema, _Throttle(interval_ms, out), None, late, ts)


class _Xml(Work):
    """The pieces of the open element are a list; the scanner's state is a value."""

    def __init__(self, text: str, tag: str, key: Sequence[str], out: str) -> None:
        self.text, self.tag, self.key, self.out = text, tag, list(key), out

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "text string")
        self.scan = handle.getValueState("scan", "depth long, number long, carry string, held boolean")

    def begin(self) -> None:
        depth, number, carry, self.held = self.scan.get() if self.scan.exists() else (0, 0, "", False)
        self.scanner, self.new = ElementScanner(self.tag, depth, number, carry), []

    def row(self, row: dict) -> list[dict]:
        out = []
        for number, text, whole in self.scanner.feed(row[self.text]):
            self.new.append(text)
            if whole:
                before = [p[0] for p in self.pieces.get()] if self.held else []
                out.append({k: row[k] for k in self.key} | {"part": number, self.out: "".join(before + self.new)})
                if self.held:
                    self.pieces.clear()
                self.new, self.held = [], False
        return out

    def save(self) -> None:
        if self.new:
            self.pieces.appendList([(t,) for t in self.new])
        self.scan.update((self.scanner.depth, self.scanner.number, self.scanner.carry, self.held or bool(self.new)))


def assemble_xml(df: DataFrame, text: str, tag: str, order_by: Sequence[str], key: Sequence[str], out: str = "xml", late: str | None = None, ts: str | None = None) -> DataFrame:
    """Elements whose text is spread over rows, as ``keyed.assemble_xml``."""
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("part", T.LongType()), T.StructField(out, T.StringType())])
    return keyed_stream(df, key, order_by, schema, _Xml(text, tag, key, out), None, late, ts)


def flow_counts(df: DataFrame, flows: str, ts: str, interval: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Counts of flows by interval as windows close; rows later than ``late`` behind the newest are dropped."""
    timed = df.withColumn("__fluvia_ts", F.col(ts).cast("timestamp")).withWatermark("__fluvia_ts", late)
    each = timed.select("__fluvia_ts", F.explode(flows).alias("flow"))
    return each.groupBy("flow", F.window("__fluvia_ts", interval)).agg(F.count("*").alias("n")).select("flow", F.col("window.start").alias("start"), "n")


def idle_sessions(df: DataFrame, line: str, ts: str, order_by: str, key: Sequence[str], wait: str, delimiter: str = "\n", out: str = "out", late: str = "10 seconds") -> DataFrame:
    """Events that gaps alone delimit: lines of a key joined until none comes for ``wait`` in event time."""
    timed = df.withColumn("__fluvia_ts", F.col(ts).cast("timestamp")).withWatermark("__fluvia_ts", late)
    item = F.struct(F.col(order_by).alias("o"), F.coalesce(F.col(line), F.lit("")).alias("t"))
    made = timed.groupBy(*key, F.session_window("__fluvia_ts", wait)).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return made.select(*key, F.col("session_window.start").alias("start"), F.array_join(F.transform("items", lambda x: x["t"]), delimiter).alias(out))
