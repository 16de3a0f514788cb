"""Texts cut where no token of a byte-level vocabulary can cross, and bounded memos of what such cuts encode to.

Splitting patterns of byte-level vocabularies keep a run of letters together with one blank before it, give a blank
to whatever else follows it, and leave other white space alone. So a text may be cut after a run of letters, before
each blank that something follows and around runs of white space; what is found for one cut holds wherever it recurs.
Letters, numbers and white space are those of the library's own Unicode tables, which differ from Python's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import tiktoken

#: Code points of a block of a text, whose cuts are held at once.
BLOCK = 1 << 18


@cache
def covered(name: str, last: int = 0x10FFFF) -> str:
    r"""The code points up to ``last`` that the library's expressions take for a class like ``\p{L}``, as ranges for a
    character class. The library itself tells: it drops what its pattern does not match."""
    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, last + 1))))
    found = sorted(map(ord, probe.decode_bytes(probe.encode_ordinary(every)).decode()))
    starts = [c for i, c in enumerate(found) if i == 0 or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def spelled_out(pattern: str) -> re.Pattern[str]:
    r"""A pattern of the library, with its classes ``\p{..}``, ``\s`` and ``\S`` written as ranges."""
    known = re.compile(r"\\p\{\w+\}|\\s|\\S")
    inside = lambda m: known.sub(lambda c: covered(c.group()), m.group())
    alone = lambda c: f"[^{covered(c.group().lower())}]" if c.group() == r"\S" else f"[{covered(c.group())}]"
    parts = re.split(r"(\[(?:\\.|[^\]\\])*\])", pattern)
    return re.compile("".join(re.sub(r".+", inside, p, flags=re.S) if p.startswith("[") else known.sub(alone, p) for p in parts))


@cache
def segment_pattern() -> re.Pattern[str]:
    """Cuts of a text. A run of letters is cut off only if no code point beyond U+FFFF follows, which may be a letter."""
    space, letters = covered(r"\s"), covered(r"\p{L}", 0xFFFF)
    return re.compile(rf" ?[{letters}]++(?![\U00010000-\U0010ffff])| ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+")


def blocks(pattern: re.Pattern[str], text: str, size: int = BLOCK) -> Iterator[list[str]]:
    """All matches of a pattern that matches everywhere, some at a time: as ``findall``, but only the cuts of a block are
    held. A block's last match may go on behind it, so the next block starts with it."""
    at, whole = 0, len(text)
    while at < whole:
        end = min(whole, at + size)
        found = pattern.findall(text, at, end)
        while end < whole:
            if len(found) > 1:
                end -= len(found.pop())
                break
            end = min(whole, at + 2 * (end - at))
            found = pattern.findall(text, at, end)
        yield found
        at = end


class Memo(dict):
    """A dict that makes missing values of keys; emptied when full, and long keys are not held, so memory is bounded."""

    def __init__(self, make: Callable[[Any], Any], most: int = 300_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def clean(text: str | None) -> str:
    """Null as empty."""
    return text or ""
