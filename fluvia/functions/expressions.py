"""Text, array and map expressions. Null text counts as empty where a predicate is asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def starts_with(c: Column, prefix: str) -> Column:
    return F.startswith(_text(c), F.lit(prefix))


def ends_with(c: Column, suffix: str) -> Column:
    return F.endswith(_text(c), F.lit(suffix))


def contains(c: Column, part: str) -> Column:
    return F.contains(_text(c), F.lit(part))


def test_regex(c: Column, pattern: str) -> Column:
    """Whether the pattern matches anywhere; false for null."""
    return F.coalesce(F.rlike(c, F.lit(pattern)), F.lit(False))


def replace_all(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def split_literal(c: Column, separator: str) -> Column:
    """Pieces between the separator, taken as text and not as a pattern; trailing empty pieces stay."""
    return F.split(c, re.escape(separator) if separator else "", -1)


def trim_chars(c: Column, chars: str | None = None) -> Column:
    """Takes the given characters off both ends; without any the text stays as it is."""
    return F.btrim(c, F.lit(chars)) if chars else c


def substr(c: Column, start: int | Column, length: int | Column) -> Column:
    """From a zero-based start; a length of -1 is the rest."""
    begin = F.lit(start) if isinstance(start, int) else start
    size = F.lit(length) if isinstance(length, int) else length
    return F.when(size < 0, F.substr(c, begin + 1, F.greatest(F.length(c), F.lit(1)))).otherwise(F.substr(c, begin + 1, size))


def index_of(c: Column, part: str) -> Column:
    """Zero-based place in characters; -1 if absent."""
    return F.instr(c, part) - 1


def index_of_bytes(c: Column, part: str) -> Column:
    """Zero-based place in UTF-8 bytes; -1 if absent."""
    at = F.instr(c, part)
    return F.when(at > 0, F.octet_length(F.substr(c, F.lit(1), at - 1))).otherwise(F.when(at == 0, F.lit(-1)))


def array_to_map(entries: Column) -> Column:
    """Map of an array of structs ``(k, v)``; of equal keys the last one counts."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def pairs_to_map(pairs: Column, missing: str = "_") -> Column:
    """Map of an array of ``[key, value]`` arrays; a missing or empty value is ``missing``, the last key wins."""

    def entry(p: Column) -> Column:
        value = F.get(p, F.lit(1))
        return F.struct(F.get(p, F.lit(0)).alias("k"), F.when(F.coalesce(value, F.lit("")) == "", missing).otherwise(value).alias("v"))

    named = F.filter(F.transform(pairs, entry), lambda e: e["k"].isNotNull())
    return array_to_map(named)


def path(c: Column, dotted: str) -> Column:
    """A nested field or array item by a dotted path with whole numbers as indexes."""
    for part in dotted.split("."):
        c = F.get(c, F.lit(int(part))) if part.isdigit() else c.getField(part)
    return c
