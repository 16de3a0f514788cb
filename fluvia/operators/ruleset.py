"""Extraction by a rule set: a state machine of regular expressions that consumes a line from left to right.

In each state the first rule that matches anywhere in the rest of the line gives its values, the line is consumed up
to the end of the match, and the state becomes the rule's next. Without a match a state other than ``start`` falls
back to ``start``, and ``start`` ends the line. A rule set whose states have one rule each and form a chain compiles
to one SQL expression; the others run in Python over Arrow batches, with the expressions compiled once per worker.
"""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .custom import map_rows, slices

START = "start"
#: Names of values that an ended line does not keep.
UNNAMED = ("", "text", "void")
PARSED = "array<struct<name:string,value:string>>"


@dataclass(frozen=True)
class Rule:
    """``names``: the first one takes group 1 (the whole match if there are no groups), each later one the next group.
    ``set`` adds pairs after the match; its values may refer to values found so far as ``${name}``. ``named`` takes the
    pattern's named groups instead."""

    pattern: str
    names: tuple[str, ...] = ()
    next: str | None = None
    reject: bool = False
    set: tuple[tuple[str, str], ...] = ()
    named: bool = False


@dataclass(frozen=True)
class RuleSet:
    """``empty`` stands in for a later group that is empty; ``None`` is the rest of the line."""

    states: Mapping[str, Sequence[Rule]]
    empty: str | None = None
    trim: bool = True
    single: bool = field(default=False)


def from_document(document: Mapping | Sequence, empty: str | None = None, trim: bool = True) -> RuleSet:
    """A rule set from its JSON form: states with lists of ``{regex, name, next, reject, set}``, or one list."""
    states = {START: document} if isinstance(document, Sequence) else {START: [], **document}

    def rule(r: Mapping) -> Rule:
        names = r.get("name") or ()
        pairs = tuple((s["key"], str(s["value"])) for s in r.get("set") or ())
        return Rule(r["regex"], (names,) if isinstance(names, str) else tuple(names), r.get("next"), bool(r.get("reject")), pairs)

    return RuleSet({s: [rule(r) for r in rules] for s, rules in states.items()}, empty, trim)


def inline(rules: Sequence[Mapping], trim: bool = True) -> RuleSet:
    """A rule set from rules ``{src, dst, re, reject}`` with named groups."""
    states: dict[str, list[Rule]] = {START: []}
    for r in rules:
        states.setdefault(r.get("src") or START, []).append(Rule(r["re"], next=r.get("dst"), reject=bool(r.get("reject")), named=True))
    return RuleSet(states, None, trim, single=True)


def _python(pattern: str) -> re.Pattern[str]:
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))


#: What templates call the whole line, and what was left of it behind the match.
WHOLE, REST = "_", "__"


class Step(NamedTuple):
    """A rule that matched, where, and the line behind the match."""

    rule: Rule
    match: re.Match[str]
    rest: str


class Ending(NamedTuple):
    """How a walk over a line ended: ``spent`` (nothing left, or nothing consumed), ``lost`` (no rule matches) or
    ``rejected``; and the state for the next line."""

    how: str
    state: str


class Machine:
    """A rule set with its expressions compiled."""

    def __init__(self, rules: RuleSet) -> None:
        self.rules = rules
        compiled = {s: [(_python(r.pattern), r, s) for r in own] for s, own in rules.states.items()}
        self.start = compiled.get(START, [])
        # where a state's own rules find nothing those of the start go on, so both are tried in turn
        self.tried = {s: own if s == START else own + self.start for s, own in compiled.items()}

    def steps(self, line: str, state: str) -> Generator[Step, None, Ending]:
        """The steps over one line; the ending is the generator's value."""
        while line:
            found = ((p.search(line), rule, home) for p, rule, home in self.tried.get(state, self.start))
            match, rule, home = next((x for x in found if x[0]), (None, None, START))
            if match is None:
                return Ending("lost", START)
            if rule.reject:
                return Ending("rejected", home)
            left = line[match.end() :]
            yield Step(rule, match, left)
            state = rule.next or (home if state in self.tried else state)
            if left == line:
                break
            line = left
        return Ending("spent", state)

    def values(self, step: Step, known: Mapping[str, str | None]) -> Iterator[tuple[str, str | None]]:
        """The pairs that a step gives; ``known`` holds those before it, for templates."""
        rule, match, rest = step
        if rule.named:
            yield from match.groupdict().items()
        groups = match.groups()
        instead = rest if self.rules.empty is None else self.rules.empty
        own: dict[str, str | None] = {}
        for i, name in enumerate(rule.names):
            value = (groups[i] if i < len(groups) else None) or instead if i else groups[0] if groups else match.group()
            own[name] = value if value is None else value.strip()
            yield name, own[name]
        if rule.set:
            seen = ChainMap({REST: rest}, own, known)
            for templates in rule.set:
                key, value = (re.sub(r"\$\{([^}]*)\}", lambda m: seen.get(m.group(1)) or "", t) for t in templates)
                seen[key] = value
                yield key, value

    def read(self, line: str | None, state: str = START) -> tuple[list[tuple[str, str | None]] | None, str]:
        """The pairs of a line (None: rejected) and the state after it."""
        text = line or ""
        text = text.strip() if self.rules.trim else text
        known: dict[str, str | None] = {WHOLE: text}
        pairs: list[tuple[str, str | None]] = []
        walk = self.steps(text, state)
        while True:
            try:
                step = next(walk)
            except StopIteration as end:
                how, state = end.value
                break
            made = list(self.values(step, known))
            pairs += made
            known |= dict(made)
        if how == "rejected":
            return None, state
        return [x for x in pairs if how != "lost" or x[0] not in UNNAMED], state


_MACHINES: dict[str, Machine] = {}


def machine(rules: RuleSet) -> Machine:
    """The machine of a rule set, made once per worker."""
    name = repr(rules)
    if name not in _MACHINES:
        _MACHINES[name] = Machine(rules)
    return _MACHINES[name]


def _as_items(pairs: list[tuple[str, str | None]] | None) -> list[dict] | None:
    return None if pairs is None else [{"name": k, "value": v} for k, v in pairs]


def _as_lists(lines: list[list[tuple[str, str | None]] | None]) -> pa.Array:
    """The pairs of lines in Arrow's form of ``PARSED``, without an object for each pair."""
    ends = [0]
    for pairs in lines:
        ends.append(ends[-1] + len(pairs or ()))
    flat = [x for pairs in lines for x in pairs or ()]
    items = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.string()) for i in (0, 1)], ["name", "value"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([x is None for x in lines], pa.bool_()))


def extract(df: DataFrame, source: str, rules: RuleSet, out: str = "parsed") -> DataFrame:
    """Adds ``out``, the pairs found in order; rejected lines are dropped, null and empty ones find nothing. A task
    holds the pairs of a slice of a batch at once (see ``custom.slices``)."""

    @F.arrow_udf(PARSED)
    def parsed(lines: pa.Array) -> pa.Array:
        own, batch = machine(rules), pa.RecordBatch.from_arrays([lines], ["line"])
        made = [_as_lists([own.read(x)[0] for x in piece.column(0).to_pylist()]) for piece in slices(batch)]
        return pa.concat_arrays(made) if made else _as_lists([])

    return df.withColumn(out, parsed(F.col(source))).filter(F.col(out).isNotNull())


def extract_lines(df: DataFrame, source: str, rules: RuleSet, key: Sequence[str], order_by: Sequence[str], out: str = "parsed") -> DataFrame:
    """Like ``extract``, with the state kept from line to line of each ``key`` (a file) in the order of ``order_by``.
    A key's lines pass through one task, in batches."""
    schema = df.withColumn(out, F.lit(None).cast(PARSED)).schema
    keys = list(key)

    def walk(batches: Iterator[list[dict]]) -> Iterator[list[dict]]:
        own, state, last = machine(rules), START, None
        for rows in batches:
            kept = []
            for row in rows:
                at = [row[k] for k in keys]
                if at != last:
                    state, last = START, at
                pairs, state = own.read(row[source], state)
                if pairs is not None:
                    kept.append(row | {out: _as_items(pairs)})
            yield kept

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order_by)
    return map_rows(dealt, walk, schema)


def as_map(df: DataFrame, parsed: str, single: bool = True) -> DataFrame:
    """The pairs as a map of each name's first value, or of all its values in order."""
    pairs = F.col(parsed)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    values = lambda k: F.transform(F.filter(pairs, lambda p: p["name"] == k), lambda p: p["value"])
    return df.withColumn(parsed, F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(values(k), F.lit(0)) if single else values(k))))


def chain(rules: RuleSet) -> list[Rule] | None:
    """The rules in order if every state has one rule and each leads to the next; else None."""
    order, state = [], START
    while state in rules.states and len(rules.states[state]) == 1:
        rule = rules.states[state][0]
        if rule.reject or rule.set or rule.named or rule in order:
            return None
        order.append(rule)
        if rule.next is None or rule.next not in rules.states:
            return order if len(order) == len(rules.states) else None
        state = rule.next
    return None


def extract_native(df: DataFrame, source: str, rules: RuleSet, out: str) -> DataFrame:
    """A chain of rules as SQL expressions: a struct of the names, null from the first rule on that does not match."""
    order = chain(rules)
    if order is None:
        raise ValueError("only a chain of single rules has a native form")
    # what each rule leaves is a column of its own, so that the next rule does not work it out again for every name
    df = df.withColumn("__fluvia_rest0", F.trim(source) if rules.trim else F.col(source))
    fields = []
    for at, rule in enumerate(order):
        rest, groups = F.col(f"__fluvia_rest{at}"), _python(rule.pattern).groups
        hit = F.rlike(rest, F.lit(rule.pattern))
        for i, name in enumerate(rule.names):
            value = F.regexp_extract(rest, rule.pattern, i + 1 if groups else 0)
            fields.append(F.when(hit, F.trim(value)).alias(name))
        after = F.regexp_extract(rest, rf"(?s)^.*?(?:{rule.pattern})(.*)$", groups + 1)
        df = df.withColumn(f"__fluvia_rest{at + 1}", F.when(hit, after))
    return df.withColumn(out, F.struct(*fields)).drop(*(f"__fluvia_rest{i}" for i in range(len(order) + 1)))


def folds(rules: RuleSet) -> bool:
    """Whether ``extract_fold`` takes a rule set: one without templates."""
    return not any(r.set for own in rules.states.values() for r in own)


def extract_fold(df: DataFrame, source: str, rules: RuleSet, out: str = "parsed") -> DataFrame:
    """``extract`` as one SQL expression, for rule sets without templates: a fold whose state is what is left of the line,
    the state's number and the pairs so far. Each step finds the first rule that matches, once, and takes its values and
    its rest; the expression grows in proportion to the rules of all states. Patterns are Java's, whose classes like ``\\w`` are ASCII; a group that took no
    part gives empty text, and white space around values is that of ASCII."""
    if not folds(rules):
        raise ValueError("templates need the rule machine")
    states = [START, *(s for s in rules.states if s != START)]
    start = list(rules.states.get(START, ()))
    every = [(r, states.index(s)) for s in states for r in rules.states.get(s, ())]
    place = {(id(r), home): i for i, (r, home) in enumerate(every)}
    number = lambda s: states.index(s) if s in states else len(states)
    blank = F.lit(" \t\n\r\x0b\x0c")

    def tried(home: int) -> list[int]:
        own = [place[id(r), home] for r in rules.states.get(states[home], ())] if home < len(states) else []
        return own + ([place[id(r), 0] for r in start] if home else [])

    def chosen(state: Column, branches: Mapping[int, Column], other: Column) -> Column:
        found = F
        for i, value in branches.items():
            found = found.when(state == i, value)
        return found.otherwise(other) if branches else other

    def first(rest: Column, of: Sequence[int]) -> Column:
        found = F
        for i in of:
            found = found.when(F.rlike(rest, F.lit(every[i][0].pattern)), i)
        return found.otherwise(-1) if of else F.lit(-1)

    def pairs(rest: Column, left: Column, rule: Rule) -> Column:
        compiled = _python(rule.pattern)
        group = lambda i: F.trim(F.regexp_extract(rest, rule.pattern, i), blank)
        made = [(n, F.regexp_extract(rest, rule.pattern, i)) for n, i in compiled.groupindex.items()] if rule.named else []
        instead = left if rules.empty is None else F.lit(rules.empty)
        for i, name in enumerate(rule.names):
            value = group(1 if compiled.groups else 0) if not i else F.regexp_extract(rest, rule.pattern, i + 1) if i < compiled.groups else F.lit("")
            made.append((name, value if not i else F.trim(F.when(value != "", value).otherwise(instead), blank)))
        items = [F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in made]
        return F.array(*items).cast(PARSED) if items else F.array().cast(PARSED)

    def step(at: Column, _: Column) -> Column:
        rest, state = at["rest"], at["state"]
        hit = chosen(state, {h: first(rest, tried(h)) for h in range(len(states))}, first(rest, tried(len(states))))

        def left_of(r: Column) -> Column:
            return chosen(r, {i: F.regexp_extract(rest, rf"^[\s\S]*?(?:{x.pattern})([\s\S]*)\z", _python(x.pattern).groups + 1) for i, (x, _) in enumerate(every)}, rest)

        def moved(r: Column, left: Column) -> Column:
            def after(rule: Rule, home: int) -> Column:
                return F.lit(number(rule.next)) if rule.next else F.when(state < len(states), home).otherwise(state)

            rejects = [i for i, (x, _) in enumerate(every) if x.reject]
            how = F.when(r < 0, "lost").when(r.isin(rejects) if rejects else F.lit(False), "rejected").when((left == rest) | (left == ""), "spent")
            found = F.when(how.isin("lost", "rejected"), at["pairs"]).otherwise(F.concat(at["pairs"], chosen(r, {i: pairs(rest, left, x) for i, (x, _) in enumerate(every)}, F.array().cast(PARSED))))
            onward = chosen(r, {i: after(x, h) for i, (x, h) in enumerate(every)}, F.lit(0))
            return F.struct(left.alias("rest"), onward.cast("int").alias("state"), found.alias("pairs"), how.alias("how"))

        once = F.transform(F.array(hit), lambda r: F.struct(r.alias("r"), left_of(r).alias("left")))
        taken = F.transform(once, lambda x: moved(x["r"], x["left"]))[0]
        return F.when(at["how"].isNotNull(), at).otherwise(taken)

    text = F.coalesce(F.col(source), F.lit(""))
    text = F.trim(text, blank) if rules.trim else text
    begin = F.struct(text.alias("rest"), F.lit(0).alias("state"), F.array().cast(PARSED).alias("pairs"), F.when(text == "", "spent").alias("how"))
    end = F.aggregate(F.sequence(F.lit(0), F.length(text)), begin, step)
    kept = F.filter(F.array(end), lambda e: F.coalesce(e["how"] != "rejected", F.lit(True)))  # exploded, so worked out once
    df = df.select("*", F.explode(kept).alias("__fluvia_end"))
    named = F.filter(F.col("__fluvia_end.pairs"), lambda p: ~p["name"].isin(*UNNAMED))
    return df.withColumn(out, F.when(F.col("__fluvia_end.how") == "lost", named).otherwise(F.col("__fluvia_end.pairs"))).drop("__fluvia_end")


#: The general tokenizer for unknown log lines, as a rule set in JSON form.
GENERIC = {
    "start": [
        {"name": "token.timestamp", "regex": r"^(\d+\-\d+\-\d+ \d+:\d+:\d+(\.\d+)?(Z)?)"},
        {"name": "token.timestamp", "regex": r"^(\d+\-\d+\-\d+T\d+:\d+:\d+\.\d+(\+\d+)?(Z)?)"},
        {"name": "token.timestamp", "regex": r"^((Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2} \d{2}\:\d{2}\:\d{2})", "next": "tags"},
        {"name": "keyword.language", "regex": r"\[[^\]]+\]"},
        {"name": "keyword.operator", "regex": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"},
        {"name": "constant.comment", "regex": r"\:(\d+)"},
        {"name": "keyword.comment", "regex": r"\d+ms"},
        {"name": "constant.numeric", "regex": r"(0x)[0-9a-fA-F]+"},
        {"name": "constant.numeric", "regex": r"(0x)?\d+"},
        {"name": "keyword.language", "regex": r"GET |POST |PUT |DELETE "},
        {"name": "param.key", "regex": r"([^= ]+)=", "next": "value"},
        {"name": "token.path", "regex": r"(/[^ /,:>=\}\"]+)+"},
        {"name": "level.error", "regex": r" (ERROR|error|FATAL|fatal|CRIT|crit)[ :]"},
        {"name": "level.warn", "regex": r" (WARNING|WARN|warning|warn)[ :]"},
        {"name": "level.debug", "regex": r" (DEBUG|debug|TRACE|trace)[ :]"},
        {"name": "level.info", "regex": r" (INFO|info)[ :]"},
    ],
    "value": [{"name": "param.value", "regex": r"[^ ,]+", "next": "start"}],
    "tags": [
        {"name": "app.module", "regex": r"[^ :]+", "next": "tags"},
        {"name": "keyword.operator", "regex": ":", "next": "start"},
    ],
}
