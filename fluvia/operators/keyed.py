"""Keyed results over ordered rows: every-N aggregates, batches, joined lines, counts, alerts, paced replay.

Arrival order is an argument: ``order_by`` should be total. Without a key, operators that only count or accumulate
work by ranges of the order (see ``ranges``); those that depend on earlier decisions replay each key's rows as a
stream of batches in one task, with memory for one key's state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .custom import map_rows
from .enrich import sequence
from .parallel_replay import replay_by_ranges
from .ranges import range_bucket, row_number_by_key, running, split_hot, with_part
from .route import Predicate, accept, holds
from .xml_scan import ElementScanner


def _ordered(order_by: Sequence[str]) -> None:
    if not order_by:
        raise ValueError("the operator needs an order")


def every_n(
    df: DataFrame,
    n: int,
    aggregates: Mapping[str, Column],
    order_by: Sequence[str],
    key: Sequence[str] = (),
    when: Predicate = "true",
    first: bool = True,
    ts: str | None = None,
    out: str = "aggregate",
    spread: bool | None = None,
) -> DataFrame:
    """Of the rows where ``when`` holds, each key's every ``n``-th one with sums over the ``n`` rows up to it.

    With ``first`` a key's first row comes out at once, alone, and counting starts behind it. ``aggregates`` are
    numbers that are added up; with ``ts`` the struct also has ``dts``, the milliseconds from the first of those rows.
    Rows of an unfinished group do not come out.

    A key's rows pass through one task. With ``spread`` they are numbered by ranges and each group of ``n`` is added up
    on its own: two balanced shuffles instead of one. By default only keys with very many rows are (``split_hot``).
    """
    _ordered(order_by)
    if spread is None and key:
        few, many = split_hot(accept(df, when), key)
        made = every_n(few, n, aggregates, order_by, key, "true", first, ts, out, False)
        return made if many is None else made.unionByName(every_n(many, n, aggregates, order_by, key, "true", first, ts, out, True))
    if spread:
        return _every_n_spread(accept(df, when), n, aggregates, order_by, list(key), first, ts, out)
    ordered = Window.partitionBy(*key).orderBy(*order_by)
    last_n = ordered.rowsBetween(1 - n, 0)
    fields = [F.sum(c).over(last_n).alias(k) for k, c in aggregates.items()]
    if ts:
        since = F.first(F.col(ts)).over(last_n)
        fields.append((F.unix_millis(F.col(ts).cast("timestamp")) - F.unix_millis(since.cast("timestamp"))).alias("dts"))
    numbered = accept(df, when).select("*", F.row_number().over(ordered).alias("__fluvia_rn"), F.struct(*fields).alias(out))
    done = (F.col("__fluvia_rn") == 1) | ((F.col("__fluvia_rn") - 1) % n == 0) if first else F.col("__fluvia_rn") % n == 0
    return numbered.filter(done).drop("__fluvia_rn")


def _every_n_spread(rows: DataFrame, n: int, aggregates: Mapping[str, Column], order_by: Sequence[str], key: list[str], first: bool, ts: str | None, out: str) -> DataFrame:
    numbered = row_number_by_key(rows, key, order_by, "__fluvia_rn") if key else sequence(rows, order_by, 1, "__fluvia_rn")
    group = F.ceil((F.col("__fluvia_rn") - 1) / n) if first else F.floor((F.col("__fluvia_rn") - 1) / n)
    sums = [F.sum(c).alias(f"__fluvia_sum_{k}") for k, c in aggregates.items()]
    whole = F.struct(*rows.columns)
    grouped = numbered.withColumn("__fluvia_group", group).groupBy(*([F.struct(*key).alias("__fluvia_key")] if key else []), "__fluvia_group")
    made = grouped.agg(F.count("*").alias("__fluvia_size"), F.max_by(whole, "__fluvia_rn").alias("__fluvia_last"), F.min_by(whole, "__fluvia_rn").alias("__fluvia_first"), *sums)
    fields = [F.col(f"__fluvia_sum_{k}").alias(k) for k in aggregates]
    if ts:
        ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
        fields.append((ms(f"__fluvia_last.{ts}") - ms(f"__fluvia_first.{ts}")).alias("dts"))
    done = (F.col("__fluvia_size") == n) | (F.col("__fluvia_group") == 0) if first else F.col("__fluvia_size") == n
    return made.filter(done).select("__fluvia_last.*", F.struct(*fields).alias(out))


def replay(df: DataFrame, key: Sequence[str], order_by: Sequence[str], schema: T.StructType, start: Callable[[], object]) -> DataFrame:
    """Feeds each key's rows in order to a fresh ``start()``, which has ``row(dict) -> list of dicts`` and
    ``end() -> list of dicts``. Batches stream through, so a key of any size needs memory for its state alone."""
    keys = list(key)

    def work(batches: Iterator[list[dict]]) -> Iterator[list[dict]]:
        state, last = None, None
        for rows in batches:
            made: list[dict] = []
            for row in rows:
                own = tuple(row[k] for k in keys)
                if state is None or own != last:
                    made += state.end() if state else []
                    state, last = start(), own
                made += state.row(row)
            yield made
        if state:
            yield state.end()

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return map_rows(dealt.sortWithinPartitions(*keys, *order_by), work, schema)


def replay_spread(df: DataFrame, key: Sequence[str], order_by: Sequence[str], schema: T.StructType, start: Callable[[], object]) -> DataFrame:
    """``replay``, where keys with very many rows are replayed by ranges side by side (``parallel_replay``)."""
    few, many = split_hot(df, key)
    out = replay(few, key, order_by, schema, start)
    if many is None:
        return out
    made, rest = replay_by_ranges(many, key, order_by, schema, start)
    out = out.unionByName(made)
    if rest:
        same = lambda row: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType)) for k, v in zip(key, row, strict=True)))
        out = out.unionByName(replay(many.filter(reduce(lambda a, b: a | b, map(same, rest))), key, order_by, schema, start))
    return out


class _EveryTtl:
    def __init__(self, n: int, names: Sequence[str], first: bool, ttl: int, tail: bool) -> None:
        self.n, self.names, self.first, self.ttl, self.tail = n, names, first, ttl, tail
        self._forget()

    def _forget(self) -> None:
        self.head, self.early, self.since = None, self.first, None
        self.data, self.size = dict.fromkeys(self.names, 0.0), 0

    def _flush(self) -> list[dict]:
        out = [self.head | self.data | {"flushed": True}]
        self._forget()
        return out

    def row(self, row: dict) -> list[dict]:
        now = row.pop("__fluvia_ms")
        out = self._flush() if self.since is not None and now - self.since >= self.ttl else []
        added = {k: row.pop(f"__fluvia_{k}") for k in self.names}
        self.head = self.head or row
        for k, v in added.items():
            self.data[k] += 0 if v is None else v
        self.size += 1
        if self.early or self.size >= self.n:
            out.append(row | self.data | {"flushed": False})
            self.early, self.size, self.data = False, 0, dict.fromkeys(self.names, 0.0)
        elif self.since is None:
            self.since = now
        return out

    def end(self) -> list[dict]:
        return self._flush() if self.tail and self.since is not None and self.size else []


def every_n_ttl(
    df: DataFrame,
    n: int,
    ttl_ms: int,
    aggregates: Mapping[str, Column],
    order_by: Sequence[str],
    key: Sequence[str],
    ts: str,
    when: Predicate = "true",
    first: bool = True,
    tail: bool = True,
) -> DataFrame:
    """``every_n`` whose unfinished groups come out, too: once a row comes ``ttl_ms`` or more after the first row that
    was held back, what is held comes out with the fields of the key's first row (``flushed``), and the key starts
    anew. ``tail`` does so at the end of the rows. Sums are doubles in columns of their own."""
    added = {f"__fluvia_{k}": c.cast("double") for k, c in aggregates.items()}
    rows = accept(df, when).withColumns(added | {"__fluvia_ms": F.unix_millis(F.col(ts).cast("timestamp"))})
    fields = [*df.schema.fields, *(T.StructField(k, T.DoubleType()) for k in aggregates), T.StructField("flushed", T.BooleanType())]
    names = list(aggregates)
    return replay_spread(rows, key, order_by, T.StructType(fields), lambda: _EveryTtl(n, names, first, ttl_ms, tail))


def array_by_size(
    df: DataFrame, size: int, order_by: Sequence[str], key: Sequence[str] = (), out: str = "rows", tail: bool = False, spread: bool = False
) -> DataFrame:
    """Every ``size`` rows as one row with the array of them, in order, by key if given; with its number in ``batch``.
    An unfinished last array comes out only with ``tail``. Without a key, or with ``spread``, rows are numbered by
    ranges, so no task holds all rows of a key."""
    _ordered(order_by)
    if key and spread:
        numbered = row_number_by_key(df, key, order_by, "__fluvia_n").withColumn("__fluvia_n", F.col("__fluvia_n") - 1)
    elif key:
        numbered = df.withColumn("__fluvia_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order_by)) - 1)
    else:
        numbered = sequence(df, order_by, out="__fluvia_n")
    chunked = numbered.withColumn("batch", F.floor(F.col("__fluvia_n") / size))
    items = F.struct(F.col("__fluvia_n"), F.struct(*df.columns).alias("row"))
    made = chunked.groupBy(*key, "batch").agg(F.array_sort(F.collect_list(items)).alias("__fluvia_items"))
    whole = made if tail else made.filter(F.size("__fluvia_items") == size)
    return whole.select(*key, "batch", F.transform("__fluvia_items", lambda x: x["row"]).alias(out))


def array_by_time(df: DataFrame, interval: str, size: int, ts: str, order_by: Sequence[str], out: str = "rows") -> DataFrame:
    """The rows of each interval of time as arrays of at most ``size``; what is over goes to further arrays of the
    same interval. Returns ``start, batch`` and the array. Intervals with very many rows are numbered by ranges."""
    _ordered(order_by)
    windowed = df.withColumn("start", F.window(F.col(ts).cast("timestamp"), interval)["start"])
    few, many = split_hot(windowed, ["start"])
    numbered = few.withColumn("__fluvia_n", F.row_number().over(Window.partitionBy("start").orderBy(*order_by)).cast("long") - 1)
    if many is not None:
        numbered = numbered.unionByName(row_number_by_key(many, ["start"], order_by, "__fluvia_n").withColumn("__fluvia_n", F.col("__fluvia_n") - 1))
    items = F.struct(F.col("__fluvia_n"), F.struct(*df.columns).alias("row"))
    made = numbered.groupBy("start", F.floor(F.col("__fluvia_n") / size).alias("batch")).agg(F.array_sort(F.collect_list(items)).alias("__fluvia_items"))
    return made.select("start", "batch", F.transform("__fluvia_items", lambda x: x["row"]).alias(out))


def join_lines(
    df: DataFrame,
    line: str,
    boundary: Predicate,
    order_by: Sequence[str],
    key: Sequence[str] = (),
    delimiter: str = "\n",
    most: int = 1000,
    wait_ms: int | None = None,
    ts: str | None = None,
    out: str = "out",
) -> DataFrame:
    """Multi-line events: a row where ``boundary`` holds begins one, the rows up to the next belong to it, and so does
    a gap of more than ``wait_ms`` in ``ts`` end it. The last row comes out with the newest ``most`` lines joined.
    Rows before the first boundary are an event, too; null lines count as empty. Keys with very many rows are cut into
    events by ranges of their rows."""
    _ordered(order_by)
    if key:
        df, many = split_hot(df, key)
        if many is not None:
            made = join_lines_spread(many, line, boundary, order_by, key, delimiter, most, wait_ms, ts, out)
            return _join_lines(df, line, boundary, order_by, key, delimiter, most, wait_ms, ts, out).unionByName(made)
        return _join_lines(df, line, boundary, order_by, key, delimiter, most, wait_ms, ts, out)
    return join_lines_spread(df, line, boundary, order_by, key, delimiter, most, wait_ms, ts, out)


def join_lines_spread(
    df: DataFrame, line: str, boundary: Predicate, order_by: Sequence[str], key: Sequence[str], delimiter: str, most: int, wait_ms: int | None, ts: str | None, out: str
) -> DataFrame:
    """``join_lines`` whose events are numbered by running sums over ranges; only an event's newest lines meet."""
    own = list(key) or ["__fluvia_all"]
    rows = df if key else df.withColumn("__fluvia_all", F.lit(0))
    starts = holds(boundary).cast("long")
    if wait_ms is not None:
        ms = F.unix_millis(F.col(ts).cast("timestamp"))
        rows = running(rows.withColumn("__fluvia_ms", ms), own, order_by, {}, {"__fluvia_prev": F.col("__fluvia_ms")})
        starts = (holds(boundary) | F.coalesce(F.col("__fluvia_ms") - F.col("__fluvia_prev") > wait_ms, F.lit(False))).cast("long")
    numbered = running(rows, own, order_by, {"__fluvia_g": starts, "__fluvia_n": F.lit(1).cast("long")})
    last = numbered.groupBy(F.struct(*own, "__fluvia_g").alias("__fluvia_event")).agg(F.max("__fluvia_n").alias("__fluvia_end"))
    ended = numbered.withColumn("__fluvia_event", F.struct(*own, "__fluvia_g")).join(last, "__fluvia_event").drop("__fluvia_event")
    newest = ended.filter(F.col("__fluvia_n") > F.col("__fluvia_end") - most)
    item = F.struct("__fluvia_n", F.coalesce(F.col(line), F.lit("")).alias("t"))
    made = newest.groupBy(*own, "__fluvia_g").agg(F.array_sort(F.collect_list(item)).alias("__fluvia_lines"), F.max_by(F.struct(*df.columns), "__fluvia_n").alias("__fluvia_last"))
    return made.select("__fluvia_last.*", F.array_join(F.transform("__fluvia_lines", lambda x: x["t"]), delimiter).alias(out))


def _join_lines(
    df: DataFrame, line: str, boundary: Predicate, order_by: Sequence[str], key: Sequence[str], delimiter: str, most: int, wait_ms: int | None, ts: str | None, out: str
) -> DataFrame:
    ordered = Window.partitionBy(*key).orderBy(*order_by)
    begins = holds(boundary)
    if wait_ms is not None:
        ms = F.unix_millis(F.col(ts).cast("timestamp"))
        begins = begins | F.coalesce(ms - F.lag(ms).over(ordered) > wait_ms, F.lit(False))
    marked = df.withColumns({"__fluvia_b": begins.cast("int"), "__fluvia_n": F.row_number().over(ordered)})
    grouped = marked.withColumn("__fluvia_g", F.sum("__fluvia_b").over(ordered))
    back = F.row_number().over(Window.partitionBy(*key, "__fluvia_g").orderBy(F.desc("__fluvia_n")))
    newest = grouped.withColumn("__fluvia_back", back).filter(F.col("__fluvia_back") <= most)  # before lines are collected
    row = F.struct(*(c for c in df.columns))
    item = F.struct("__fluvia_n", F.coalesce(F.col(line), F.lit("")).alias("t"))
    made = newest.groupBy(*key, "__fluvia_g").agg(F.array_sort(F.collect_list(item)).alias("__fluvia_lines"), F.max_by(row, "__fluvia_n").alias("__fluvia_last"))
    joined = F.array_join(F.transform("__fluvia_lines", lambda x: x["t"]), delimiter)
    return made.select("__fluvia_last.*", joined.alias(out))


class _Pieces:
    def __init__(self, text: str, tag: str, keep: Sequence[str]) -> None:
        self.text, self.keep, self.scan, self.n = text, list(keep), ElementScanner(tag), 0

    def row(self, row: dict) -> list[dict]:
        own = {k: row[k] for k in self.keep}
        made = [own | {"part": i, "__fluvia_n": self.n, "__fluvia_text": t, "__fluvia_whole": w} for i, t, w in self.scan.feed(row[self.text])]
        self.n += 1
        return made

    def end(self) -> list[dict]:
        return []


def assemble_xml(df: DataFrame, text: str, tag: str, order_by: Sequence[str], key: Sequence[str] = (), out: str = "xml") -> DataFrame:
    """Elements ``<tag ...>...</tag>`` and ``<tag .../>`` whose text is spread over rows, one row each, with their number
    from 0 in ``part``; they may nest in themselves. What belongs to no whole element does not come out.

    Rows of a key stream past a scanner that knows the depth of open tags and cuts them by element. Only pieces of
    whole elements are collected, so rows without an end tag, however many, are never held together.
    """
    _ordered(order_by)
    fields = [*(df.schema[k] for k in key), T.StructField("part", T.LongType()), T.StructField("__fluvia_n", T.LongType())]
    schema = T.StructType([*fields, T.StructField("__fluvia_text", T.StringType()), T.StructField("__fluvia_whole", T.BooleanType())])
    pieces = replay(df.select(*dict.fromkeys([*key, *order_by, text])), key, order_by, schema, lambda: _Pieces(text, tag, key))
    whole = F.max("__fluvia_whole").over(Window.partitionBy(*key, "part"))
    kept = pieces.withColumn("__fluvia_whole", whole).filter("__fluvia_whole")
    item = F.struct(F.col("__fluvia_n").alias("n"), F.col("__fluvia_text").alias("t"))
    made = kept.groupBy(*key, "part").agg(F.array_sort(F.collect_list(item)).alias("__fluvia_items"))
    return made.select(*key, "part", F.array_join(F.transform("__fluvia_items", lambda x: x["t"]), "").alias(out))


def flow_counts(df: DataFrame, flows: str, ts: str, interval: str = "10 seconds") -> DataFrame:
    """Rows of each flow in each interval, from an array column of flows: ``flow, start, n``."""
    each = df.select(F.explode(flows).alias("flow"), F.window(F.col(ts).cast("timestamp"), interval)["start"].alias("start"))
    return each.groupBy("flow", "start").agg(F.count("*").alias("n"))


class _Alert:
    def __init__(self, time_us: int | None, size: int | None, threshold: float, reset: bool) -> None:
        self.time, self.most, self.threshold, self.reset = time_us, size, threshold, reset
        self.rows: deque[tuple[int, float]] = deque()
        self.total = 0.0

    def row(self, row: dict) -> list[dict]:
        now, amount = row.pop("__fluvia_us"), row.pop("__fluvia_amount")
        amount = 0.0 if amount is None else amount
        while self.time is not None and self.rows and self.rows[0][0] < now - self.time:
            self.total -= self.rows.popleft()[1]
        self.rows.append((now, amount))
        self.total += amount
        while self.most is not None and len(self.rows) > self.most:
            self.total -= self.rows.popleft()[1]
        if self.total < self.threshold:
            return []
        out = [row | {"window_value": float(self.total)}]
        if self.reset:
            self.rows.clear()
            self.total = 0.0
        return out

    def end(self) -> list[dict]:
        return []


def _window_values(df: DataFrame, value: Column, key: Sequence[str], order_by: Sequence[str], length: int | None, size: int | None) -> DataFrame:
    by = Window.partitionBy(*key)
    frame = by.orderBy(*order_by).rowsBetween(1 - size, 0) if length is None else by.orderBy("__fluvia_us").rangeBetween(-length, 0)
    return df.withColumn("window_value", F.sum(value).over(frame)).drop("__fluvia_us")


def _with_row_halo(df: DataFrame, key: Sequence[str], order_by: Sequence[str], size: int, rows: int = 100_000) -> DataFrame:
    """Rows by ``__fluvia_part``, each of some ``rows`` of a key, with copies of the last rows of the part before."""
    width = max(rows, 4 * size)
    numbered = row_number_by_key(df, key, order_by, "__fluvia_rn").withColumn("__fluvia_rn", F.col("__fluvia_rn") - 1)
    part, late = F.floor(F.col("__fluvia_rn") / width), F.col("__fluvia_rn") % width > width - size
    places = F.when(late, F.array(part, part + 1)).otherwise(F.array(part))
    each = numbered.withColumn("__fluvia_own", part).withColumn("__fluvia_part", F.explode(places))
    return each.withColumn("__fluvia_halo", F.col("__fluvia_own") != F.col("__fluvia_part")).drop("__fluvia_own", "__fluvia_rn")


def _with_time_halo(df: DataFrame, key: Sequence[str], length: int) -> DataFrame:
    """Rows by ``__fluvia_part``, ranges of key and time, with copies of the rows that a part's windows reach back to.
    There are as many parts as ranges and keys, so what is known of them is sent to all tasks."""
    parted = df.withColumn("__fluvia_own", range_bucket(df, [*key, "__fluvia_us"]))
    begins = parted.groupBy(*key, "__fluvia_own").agg(F.min("__fluvia_us").alias("begin"))
    listed = begins.groupBy(*(F.col(k).alias(f"__fluvia_k{i}") for i, k in enumerate(key))).agg(F.collect_list(F.struct("begin", F.col("__fluvia_own").alias("part"))).alias("__fluvia_parts"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__fluvia_k{i}")) for i, k in enumerate(key)))
    joined = parted.join(F.broadcast(listed), same)
    us, own = F.col("__fluvia_us"), F.col("__fluvia_own")
    reached = F.filter("__fluvia_parts", lambda p: (p["part"] > own) & (p["begin"] - length <= us))
    each = joined.withColumn("__fluvia_part", F.explode(F.concat(F.array(own), F.coalesce(F.transform(reached, lambda p: p["part"]), F.array().cast("array<int>")))))
    return each.withColumn("__fluvia_halo", F.col("__fluvia_part") != own).select(*df.columns, "__fluvia_part", "__fluvia_halo")


def window_alert(
    df: DataFrame,
    threshold: float,
    key: Sequence[str],
    ts: str,
    order_by: Sequence[str],
    time: str | None = None,
    size: int | None = None,
    amount: Column | None = None,
    reset: bool = False,
) -> DataFrame:
    """Rows at which the sum of ``amount`` (default: the count) over the key's last rows reaches ``threshold``, with it
    in ``window_value``. The rows are those of the last ``time`` (an interval like ``1 hour``; a row exactly that old
    is in) and at most the newest ``size``. With ``reset`` an alert empties the window.

    Without reset, and with one bound only, this is a window aggregation; keys with very many rows are cut into parts
    that overlap by what a window reaches back. Else rows are replayed by key.
    """
    if time is None and size is None:
        raise ValueError("a window needs a time or a size")
    value = F.lit(1.0) if amount is None else amount.cast("double")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    length = None if time is None else int(pd.Timedelta(time) / pd.Timedelta(microseconds=1))
    if not reset and (time is None or size is None):
        few, many = split_hot(df, key)
        valued = _window_values(few.withColumn("__fluvia_us", us), value, key, order_by, length, size)
        if many is not None:
            timed = many.withColumn("__fluvia_us", us)
            halo = _with_time_halo(timed, key, length) if length is not None else _with_row_halo(timed, key, order_by, size)
            wide = _window_values(halo, value, [*key, "__fluvia_part"], order_by, length, size)
            valued = valued.unionByName(wide.filter("not __fluvia_halo").drop("__fluvia_part", "__fluvia_halo"))
        return valued.filter(F.col("window_value") >= threshold)
    rows = df.withColumns({"__fluvia_us": us, "__fluvia_amount": value})
    schema = T.StructType([*df.schema.fields, T.StructField("window_value", T.DoubleType())])
    return replay_spread(rows, key, order_by, schema, lambda: _Alert(length, size, threshold, reset))


def rules(df: DataFrame, specs: Mapping[str, Mapping], ts: str, order_by: Sequence[str]) -> DataFrame:
    """Declarative rules: ``specs`` maps a name to ``{"when": predicate, "key": [...], "threshold": x, "time" or
    "size": ..., "amount": Column}``. Alerts of all rules as ``rule`` and ``alert`` (the row as JSON) and their value."""
    parts = []
    for name, spec in specs.items():
        hits = accept(df, spec.get("when", "true"))
        found = window_alert(hits, spec["threshold"], spec["key"], ts, order_by, spec.get("time"), spec.get("size"), spec.get("amount"), spec.get("reset", False))
        parts.append(found.select(F.lit(name).alias("rule"), F.to_json(F.struct(*df.columns)).alias("alert"), "window_value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def throttle(df: DataFrame, interval_ms: int, ts: str, order_by: Sequence[str], out: str = "release_ms") -> DataFrame:
    """When each row leaves a queue that lets one row go at each multiple of ``interval_ms``: epoch milliseconds.

    With k the first tick at or after a row's time and n its number, the release is ``T n`` plus the largest
    ``k - T i`` of the rows so far. Rows are numbered and accumulated by ranges of the order; only one row of each
    range meets the others.
    """
    _ordered(order_by)
    t = interval_ms
    tick = F.ceil(F.unix_millis(F.col(ts).cast("timestamp")) / t) * t
    ordered = Window.partitionBy("__fluvia_part").orderBy(*order_by)
    numbered = df.withColumn("__fluvia_part", range_bucket(df, order_by)).withColumn("__fluvia_i", F.row_number().over(ordered).cast("long") - 1)
    lead = numbered.withColumn("__fluvia_x", tick - t * F.col("__fluvia_i"))
    running = lead.withColumn("__fluvia_own", F.max("__fluvia_x").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    totals = lead.groupBy("__fluvia_part").agg(F.count("*").alias("__fluvia_rows"), F.max("__fluvia_x").alias("__fluvia_top"))
    earlier = Window.orderBy("__fluvia_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.withColumn("__fluvia_offset", F.coalesce(F.sum("__fluvia_rows").over(earlier), F.lit(0)))
    reach = F.max(F.col("__fluvia_top") - t * F.col("__fluvia_offset"))
    before = offsets.select("__fluvia_part", "__fluvia_offset", reach.over(earlier).alias("__fluvia_carry"))
    own = F.col("__fluvia_own") - t * F.col("__fluvia_offset")
    release = F.greatest(own, F.coalesce("__fluvia_carry", own)) + t * (F.col("__fluvia_offset") + F.col("__fluvia_i"))
    joined = with_part(running, before).withColumn(out, release.cast("long"))
    return joined.drop("__fluvia_part", "__fluvia_i", "__fluvia_x", "__fluvia_own", "__fluvia_offset", "__fluvia_carry")
