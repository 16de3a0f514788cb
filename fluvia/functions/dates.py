"""Date patterns as log tools write them (``YYYY-MM-DD``), in the letters that Spark reads."""

from __future__ import annotations

import re

#: Tokens of the common date-library notation and Java's letters for them.
TOKENS = {
    "YYYY": "yyyy",
    "YY": "yy",
    "MMMM": "MMMM",
    "MMM": "MMM",
    "MM": "MM",
    "M": "M",
    "DD": "dd",
    "D": "d",
    "dddd": "EEEE",
    "ddd": "EEE",
    "HH": "HH",
    "H": "H",
    "hh": "hh",
    "h": "h",
    "mm": "mm",
    "m": "m",
    "ss": "ss",
    "s": "s",
    "SSS": "SSS",
    "A": "a",
    "ZZ": "xx",
    "Z": "xxx",
}
_PART = re.compile(r"\[([^\]]*)\]|(" + "|".join(sorted(TOKENS, key=len, reverse=True)) + r")|([A-Za-z]+)|([^A-Za-z\[]+)")


def java_format(pattern: str) -> str:
    """Translates a pattern; text in square brackets and letters that are no token become quoted literals."""

    def part(m: re.Match[str]) -> str:
        literal, token, letters, rest = m.groups()
        if token:
            return TOKENS[token]
        if rest is not None:
            return rest.replace("'", "''")
        return "'" + (literal if literal is not None else letters).replace("'", "''") + "'"

    return _PART.sub(part, pattern)
