"""Routing: predicates, gates, fan-out to flows, nested flows, placement and union.

A predicate that is null counts as false everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains, ends_with, starts_with

Predicate = Column | str | Mapping
Transform = Callable[[DataFrame], DataFrame]


def holds(predicate: Predicate) -> Column:
    """A predicate as a boolean column that is never null."""
    if isinstance(predicate, Mapping):
        return match_document(predicate)
    column = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(column.cast("boolean"), F.lit(False))


def any_of(predicates: Sequence[Predicate]) -> Column:
    """Whether any predicate of a group holds; an empty group holds for no row."""
    return reduce(lambda a, b: a | b, map(holds, predicates), F.lit(False))


def accept(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.filter(holds(predicate))


def reject(df: DataFrame, predicate: Predicate) -> DataFrame:
    return df.filter(~holds(predicate))


def enter(df: DataFrame, origin: Sequence[Predicate] | Predicate, when: Sequence[Predicate] | Predicate = "true") -> DataFrame:
    """Rows that enter a flow: where any of ``origin`` and any of ``when`` hold."""
    group = lambda p: any_of(p) if isinstance(p, (list, tuple)) else holds(p)
    return df.filter(group(origin) & group(when))


_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)) | (c.isNull() if None in v else F.lit(False)),
    "$nin": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
    "$regex": lambda c, v: F.rlike(c, F.lit(v)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$starts": starts_with,
    "$startsWith": starts_with,
    "$startsWidth": starts_with,
    "$ends": ends_with,
    "$endsWith": ends_with,
    "$contains": contains,
}


def match_document(document: Mapping) -> Column:
    """A predicate written as a document: ``{"type": "a", "n": {"$gt": 3}, "$or": [...]}``.

    Fields are combined by AND; ``$and``, ``$or`` and ``$nor`` take lists, ``$not`` a document; ``$expr`` and
    ``$eval`` take a SQL string. A field may be a dotted path. A plain value is equality, null matches null.
    """
    parts = []
    for key, value in document.items():
        if key == "$and":
            parts.append(reduce(lambda a, b: a & b, map(match_document, value), F.lit(True)))
        elif key in ("$or", "$nor"):
            found = any_of([match_document(d) for d in value])
            parts.append(~found if key == "$nor" else found)
        elif key in ("$expr", "$eval"):
            parts.append(holds(value))
        elif key == "$not":
            parts.append(~match_document(value))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            parts.append(_field(F.col(key), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _field(c: Column, value: object) -> Column:
    if not isinstance(value, Mapping):
        return F.coalesce(_COMPARE["$eq"](c, value), F.lit(False))
    parts = []
    for key, operand in value.items():
        if key == "$not":
            parts.append(~_field(c, operand))
        elif key in _COMPARE:
            parts.append(F.coalesce(_COMPARE[key](c, operand), F.lit(False)))
        else:
            raise ValueError(f"unknown operator {key}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def fan_out(df: DataFrame, flows: Mapping[str, Predicate], default: str | None = None, out: str = "flow") -> DataFrame:
    """One row for each flow whose predicate holds, named in ``out``; rows of no flow go to ``default`` or are dropped.

    All predicates are evaluated in one pass over one scan.
    """
    named = F.array(*(F.when(holds(p), F.lit(name)) for name, p in flows.items()))
    matched = F.filter(named, lambda x: x.isNotNull())
    if default is not None:
        matched = F.when(F.size(matched) == 0, F.array(F.lit(default))).otherwise(matched)
    return df.withColumn(out, F.explode(matched))


def flows_column(df: DataFrame, flows: Mapping[str, Predicate], out: str = "flows") -> DataFrame:
    """Each row once, with the array of the flows that it belongs to."""
    named = F.array(*(F.when(holds(p), F.lit(name)) for name, p in flows.items()))
    return df.withColumn(out, F.filter(named, lambda x: x.isNotNull()))


def nested(df: DataFrame, when: Predicate, steps: Sequence[Transform], children: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """A flow with children: a child sees what the parent lets out, then applies its own ``when``, steps and children.

    ``children`` maps names to ``{"when": ..., "steps": [...], "children": {...}}``. Returns the parent's result under
    the empty name and each child's under its path, like ``a/b``.
    """
    out = reduce(lambda d, step: step(d), steps, accept(df, when))
    found = {"": out}
    for name, child in children.items():
        below = nested(out, child.get("when", "true"), child.get("steps", ()), child.get("children", {}))
        found |= {f"{name}/{k}".rstrip("/"): v for k, v in below.items()}
    return found


def gate(
    df: DataFrame,
    step: Transform,
    predicate: Predicate,
    match: str = "process",
    nomatch: str = "block",
    then: Predicate | None = None,
) -> DataFrame:
    """Puts a stage behind a gate. ``match`` and ``nomatch`` are ``process`` (through the stage), ``bypass`` (around
    it, unchanged) or ``block`` (dropped); ``then`` filters what the stage lets out."""
    for way in (match, nomatch):
        if way not in ("process", "bypass", "block"):
            raise ValueError(f"unknown way {way}")
    after = lambda d: d if then is None else accept(d, then)
    ways = {True: match, False: nomatch}
    side = {True: holds(predicate), False: ~holds(predicate)}
    if match == nomatch:
        return {"process": lambda: after(step(df)), "bypass": lambda: df, "block": lambda: df.limit(0)}[match]()
    parts = []
    for hit, way in ways.items():
        if way == "process":
            parts.append(after(step(df.filter(side[hit]))))
        elif way == "bypass":
            parts.append(df.filter(side[hit]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gate_columns(df: DataFrame, columns: Mapping[str, Column], predicate: Predicate) -> DataFrame:
    """A gate with bypass for a stage that only sets columns: one projection, no split of the rows."""
    hit = holds(predicate)
    there = set(df.columns)
    return df.withColumns({k: F.when(hit, c).otherwise(F.col(k) if k in there else F.lit(None)) for k, c in columns.items()})


def forward(flows: Mapping[str, Transform], edges: Mapping[str, Sequence[str]], sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Runs flows that forward their rows to other flows by name. ``sources`` feed flows from outside, ``edges`` names
    the flows that each one forwards to. Cycles raise an error. Returns each flow's result."""
    into: dict[str, list[str]] = {name: [] for name in flows}
    for name, to in edges.items():
        for target in to:
            into[target].append(name)
    done: dict[str, DataFrame] = {}
    waiting: list[str] = []

    def run(name: str) -> DataFrame | None:
        if name in waiting:
            raise ValueError(f"flows forward in a cycle: {' -> '.join([*waiting, name])}")
        if name not in done:
            waiting.append(name)
            parts = [d for d in ([sources[name]] if name in sources else []) + [run(x) for x in into[name]] if d is not None]
            waiting.pop()
            if not parts:
                return None
            done[name] = flows[name](union_inputs(*parts))
        return done[name]

    for name in flows:
        run(name)
    return done


def place(df: DataFrame, workers: int, mode: str = "balanced", key: Column | str | None = None) -> DataFrame:
    """Deals rows to tasks: ``roundrobin`` and ``balanced`` evenly, ``expression`` by the hash of ``key``, ``all`` to
    every worker (one copy each, named in ``worker``)."""
    if mode in ("roundrobin", "balanced"):
        return df.repartition(workers)
    if mode == "expression":
        return df.repartition(workers, F.expr(key) if isinstance(key, str) else key)
    if mode == "all":
        return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))
    raise ValueError(f"unknown mode {mode}")


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """Rows of all inputs; columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
