"""Column expressions that log pipelines write: text, arrays, maps, dates."""

from .dates import java_format
from .expressions import (
    array_to_map,
    contains,
    ends_with,
    index_of,
    index_of_bytes,
    pairs_to_map,
    path,
    replace_all,
    split_literal,
    starts_with,
    substr,
    test_regex,
    trim_chars,
)

__all__ = [
    "array_to_map",
    "contains",
    "ends_with",
    "index_of",
    "index_of_bytes",
    "java_format",
    "pairs_to_map",
    "path",
    "replace_all",
    "split_literal",
    "starts_with",
    "substr",
    "test_regex",
    "trim_chars",
]
