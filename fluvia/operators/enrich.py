"""Projections, enrichment and output columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import java_format
from .ranges import before_each, numbered, range_bucket, with_part


def envelope(df: DataFrame, input_name: str, kind: str, key: Column | None = None) -> DataFrame:
    """Tags rows with ``input``, ``type`` and ``key`` (``input:type`` or ``input:type@`` and the source's own key)."""
    head = F.lit(f"{input_name}:{kind}")
    full = head if key is None else F.concat_ws("@", head, key.cast("string"))
    return df.withColumns({"input": F.lit(input_name), "type": F.lit(kind), "key": full})


def set_fields(df: DataFrame, fields: Mapping[str, Column], deep: bool = False, replace: bool = False) -> DataFrame:
    """Sets columns: overwriting, merging structs field by field (``deep``), or as the whole row (``replace``)."""
    if replace:
        return df.select(*(c.alias(k) for k, c in fields.items()))
    if not deep:
        return df.withColumns(dict(fields))
    new = df.select(*(c.alias(k) for k, c in fields.items())).schema
    old = {f.name: f.dataType for f in df.schema}
    merged = {k: merge_structs(F.col(k), old[k], c, new[k].dataType) if k in old else c for k, c in fields.items()}
    return df.withColumns(merged)


def merge_structs(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """Fields of both structs; where both have one, nested structs are merged and other values of ``b`` win unless
    null."""
    if not (isinstance(a_type, T.StructType) and isinstance(b_type, T.StructType)):
        return F.coalesce(b, a) if a_type == b_type else b
    theirs = {f.name: f.dataType for f in b_type}
    own = {f.name: f.dataType for f in a_type}
    fields = [
        (merge_structs(a.getField(n), t, b.getField(n), theirs[n]) if n in theirs else a.getField(n)).alias(n) for n, t in own.items()
    ]
    return F.struct(*fields, *(b.getField(n).alias(n) for n in theirs if n not in own))


def delete_fields(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Drops columns and, by dotted paths, fields of structs; unknown ones are ignored."""
    for p in paths:
        top, _, rest = p.partition(".")
        if not rest:
            df = df.drop(top)
        elif top in df.columns and _has(df.schema[top].dataType, rest):
            df = df.withColumn(top, F.col(top).dropFields(rest))
    return df


def _has(kind: T.DataType, dotted: str) -> bool:
    top, _, rest = dotted.partition(".")
    return isinstance(kind, T.StructType) and top in kind.names and (not rest or _has(kind[top].dataType, rest))


def merge_maps(*maps: Column) -> Column:
    """Entries of all maps; of equal keys the last map's counts. Null maps are empty."""

    def two(a: Column, b: Column) -> Column:
        kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(kept, b))

    return reduce(two, maps)


def merge(df: DataFrame, fields: Sequence[str], out: str, deep: bool = False, delete: Sequence[str] = ()) -> DataFrame:
    """Merges struct or map columns from left to right into ``out`` and drops ``delete``."""
    kinds = [df.schema[f].dataType for f in fields]
    if isinstance(kinds[0], T.MapType):
        merged = merge_maps(*map(F.col, fields))
    else:
        merged, kind = F.col(fields[0]), kinds[0]
        for name, other in zip(fields[1:], kinds[1:], strict=True):
            if deep:
                merged = merge_structs(merged, kind, F.col(name), other)
            else:
                later = {f.name for f in other}
                merged = F.struct(*(merged.getField(f.name).alias(f.name) for f in kind if f.name not in later), *(F.col(name).getField(x).alias(x) for x in (g.name for g in other)))
            kind = df.select(merged.alias("x")).schema["x"].dataType
    return delete_fields(df.withColumn(out, merged), delete)


def sequence(df: DataFrame, order_by: Sequence[str], start: int = 0, out: str = "seq") -> DataFrame:
    """A counter without gaps in the order of ``order_by``, which should be total.

    Rows are shuffled once, by ranges of the order, and counted as they lie (``ranges.numbered``); only the counts of the
    ranges, one row each, are added up in one place. So no task holds all rows.
    """
    if not order_by:
        raise ValueError("a sequence needs an order")
    return numbered(df, order_by, start, out)


def timestamp(df: DataFrame, out: str, source: Column | None = None, pattern: str | None = None, unix: bool = False) -> DataFrame:
    """The time that ``source`` tells (null where it cannot be read), or now; as a timestamp or epoch milliseconds."""
    if source is None:
        when = F.current_timestamp()
    else:
        when = F.try_to_timestamp(source, F.lit(java_format(pattern))) if pattern else F.try_to_timestamp(source)
    return df.withColumn(out, F.unix_millis(when) if unix else when)


def date_formats(df: DataFrame, source: Column, formats: Mapping[str, str]) -> DataFrame:
    """Sets for each name the time in its pattern, like ``YYYY-MM-DD``."""
    return df.withColumns({k: F.date_format(source, java_format(p)) for k, p in formats.items()})


def translate(df: DataFrame, fields: Mapping[str, str], dictionary: Mapping[str, str] | DataFrame, literal_limit: int = 1000) -> DataFrame:
    """Looks columns up in a dictionary: ``fields`` maps input to output columns. A miss takes the entry ``*``, else
    the value itself.

    Up to ``literal_limit`` inline entries become a map literal. More entries, and a DataFrame ``(code, label)``, are
    joined; Spark broadcasts the dictionary only below its size threshold. Of a code's several labels the last in order counts.
    """
    if isinstance(dictionary, Mapping) and len(dictionary) <= literal_limit:
        entries = [F.lit(x) for kv in dictionary.items() for x in kv]
        table = F.create_map(*entries) if entries else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        star = F.lit(dictionary.get("*"))
        hit = lambda c: F.try_element_at(table, c.cast("string"))
        return df.withColumns({o: F.coalesce(hit(F.col(i)), star, F.col(i).cast("string")) for i, o in fields.items()})
    if isinstance(dictionary, Mapping):
        dictionary = df.sparkSession.createDataFrame(list(dictionary.items()), "code string, label string")
    star = F.lit(dictionary.filter(F.col("code") == "*").agg(F.max("label")).first()[0]).cast("string")
    dictionary = dictionary.groupBy("code").agg(F.max("label").alias("label"))  # a code looked up gives one row
    for source, out in fields.items():
        found = dictionary.select(F.col("code").alias("__fluvia_code"), F.col("label").alias("__fluvia_label"))
        joined = df.join(found, F.col(source).cast("string") == F.col("__fluvia_code"), "left")
        df = joined.withColumn(out, F.coalesce(F.col("__fluvia_label"), star, F.col(source).cast("string"))).drop("__fluvia_code", "__fluvia_label")
    return df


def global_value(df: DataFrame, values: DataFrame, order_by: str, value: str, out: str, partition: Sequence[str] = ()) -> DataFrame:
    """The latest value that ``values`` had stored when each row came, in the order of ``order_by`` (a value stored at
    the same place counts). ``partition`` names the keys of the store. Without keys rows are dealt by ranges of the order,
    and the last value of each range, one row, is handed on to the ranges behind it; no task sees all rows.
    """
    keys = list(partition)
    left = df.withColumns({"__fluvia_value": F.lit(None).cast(values.schema[value].dataType), "__fluvia_row": F.lit(1)})
    right = values.select(*keys, order_by, F.col(value).alias("__fluvia_value"), F.lit(0).alias("__fluvia_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    latest = lambda window: F.last("__fluvia_value", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    if keys:
        found = both.withColumn(out, latest(Window.partitionBy(*keys).orderBy(order_by, "__fluvia_row")))
        return found.filter(F.col("__fluvia_row") == 1).drop("__fluvia_value", "__fluvia_row")
    parted = both.withColumn("__fluvia_part", range_bucket(both, [order_by]))
    stored = parted.filter("__fluvia_row = 0 and __fluvia_value is not null")
    ends = stored.groupBy("__fluvia_part").agg(F.max_by("__fluvia_value", order_by).alias("__fluvia_top"))
    whole = parted.select("__fluvia_part").distinct().join(ends, "__fluvia_part", "left")
    before = before_each(whole, "__fluvia_part", F.last("__fluvia_top", ignorenulls=True), "__fluvia_carry")
    own = parted.withColumn("__fluvia_own", latest(Window.partitionBy("__fluvia_part").orderBy(order_by, "__fluvia_row")))
    found = with_part(own, before).withColumn(out, F.coalesce("__fluvia_own", "__fluvia_carry"))
    hidden = [f"__fluvia_{x}" for x in ("value", "row", "part", "own", "carry")]
    return found.filter(F.col("__fluvia_row") == 1).drop(*(x for x in hidden if x != out))


def transform(df: DataFrame, source: Column, stages: Sequence[tuple[str, object]], out: str) -> DataFrame:
    """Stages over the items of an array; a value that is none is the only item of one.

    A stage is ``("add", fields)``, ``("project", fields)`` or ``("match", condition)``; fields map names to functions of
    the item as the stages before left it. Each item that is left gives a row with it in ``out``; a row without one stays,
    with null there, and so does a row whose source is null. Expressions that may fail should be ``try_`` ones, so that a
    bad row passes instead of ending the job.
    """
    array = isinstance(df.select(source.alias("x")).schema["x"].dataType, T.ArrayType)
    items = source if array else F.array(source)

    def one(kind: str, work: object) -> Callable[[Column], Column]:
        if kind == "project":
            return lambda x: F.struct(*(f(x).alias(n) for n, f in work.items()))
        if kind == "add":
            return lambda x: reduce(lambda made, field: made.withField(field[0], field[1](x)), work.items(), x)
        raise ValueError(f"unknown stage {kind}")

    for kind, work in stages:
        items = F.filter(items, work) if kind == "match" else F.transform(items, one(kind, work))
    return df.select(*(c for c in df.columns if c != out), F.explode_outer(items).alias(out))


def template(df: DataFrame, fields: Mapping[str, Column | str]) -> DataFrame:
    """A projection whose leaves are Columns or SQL strings."""
    return df.select(*((F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items()))


def row_json(df: DataFrame, out: str = "json", fields: Sequence[str] | None = None) -> DataFrame:
    """The row, or some of its columns, as JSON."""
    return df.withColumn(out, F.to_json(F.struct(*(fields or df.columns))))


def csv_out(df: DataFrame, fields: Sequence[Column | str], out: str = "csv", options: Mapping[str, str] | None = None, newline: bool = False) -> DataFrame:
    """A list of expressions as one CSV line."""
    columns = [(F.expr(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(fields)]
    line = F.to_csv(F.struct(*columns), dict(options or {}))
    return df.withColumn(out, F.concat(line, F.lit("\n")) if newline else line)


#: The header fields of a CEF line, in order, and what they are without one.
CEF_HEADER = {
    "CEFVersion": "0",
    "DeviceVendor": "localdomain",
    "DeviceProduct": "localdomain",
    "DeviceVersion": "0",
    "SignatureID": "0",
    "Name": "localdomain",
    "Severity": "0",
}


def cef_out(df: DataFrame, source: str, out: str = "cef", headers: Mapping[str, Column | str] | None = None) -> DataFrame:
    """A struct or map column as a CEF line: header, then ``key=value`` for each leaf that is not blank.

    Nested fields have dotted keys and array items their index in the key; fields named like header fields are left
    out; nothing is escaped.
    """
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (headers or {}).items()}
    head = [F.coalesce(given[k].cast("string"), F.lit(v)) if k in given else F.lit(v) for k, v in CEF_HEADER.items()]
    pairs = F.flatten(F.array(*_leaves(F.col(source), df.schema[source].dataType, "")))
    hidden = [k for k in CEF_HEADER if k != "CEFVersion"]
    shown = F.filter(pairs, lambda p: ~p["k"].isin(hidden) & (F.trim(F.coalesce(p["v"], F.lit(""))) != ""))
    extension = F.array_join(F.transform(shown, lambda p: F.concat(p["k"], F.lit("="), F.trim(p["v"]))), " ")
    return df.withColumn(out, F.concat(F.lit("CEF:"), *(x for c in head for x in (c, F.lit("|"))), F.coalesce(extension, F.lit(""))))


def _leaves(c: Column, kind: T.DataType, key: str) -> list[Column]:
    """Arrays of (k, v) for every leaf below a value of a known type."""
    dot = f"{key}." if key else ""
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in _leaves(c.getField(f.name), f.dataType, f"{dot}{f.name}")]
    pair = lambda k, v: F.struct(k.cast("string").alias("k"), v.cast("string").alias("v"))
    if isinstance(kind, T.MapType):
        entries = F.coalesce(F.map_entries(c), F.array().cast(T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))))
        return [F.transform(entries, lambda e: pair(F.concat(F.lit(dot), e["key"].cast("string")), e["value"]))]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        if not isinstance(kind.elementType, T.StructType):
            return [F.transform(F.coalesce(c, F.array().cast(kind)), lambda x, i: pair(F.concat(F.lit(dot), i.cast("string")), F.to_json(x)))]

        def item(x: Column, i: Column) -> Column:
            return F.array(*(pair(F.concat(F.lit(dot), i.cast("string"), F.lit(f".{f.name}")), x.getField(f.name)) for f in kind.elementType))

        return [F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), item))]
    if isinstance(kind, T.ArrayType):
        return [F.transform(F.coalesce(c, F.array().cast(kind)), lambda x, i: pair(F.concat(F.lit(dot), i.cast("string")), x))]
    return [F.array(pair(F.lit(key), c))]


#: Syslog facilities and levels, by number from 0.
FACILITIES = (
    "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron "
    "local0 local1 local2 local3 local4 local5 local6 local7"
).split()
LEVELS = "emerg alert crit error warn notice info debug".split()


def _number(c: Column | str | int, names: Sequence[str], otherwise: str) -> Column:
    """The number that a name or a number in text stands for."""
    text = F.lower((c if isinstance(c, Column) else F.lit(c)).cast("string"))
    table = F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (name, i)))
    return F.coalesce(F.try_element_at(table, text), text.try_cast("int"), F.lit(names.index(otherwise)))


def syslog_line(
    df: DataFrame,
    message: Column,
    ts: Column,
    host: Column,
    application: Column,
    facility: Column | str | int = "local0",
    level: Column | str | int = "info",
    out: str = "line",
) -> DataFrame:
    """A BSD syslog line ``<pri>MMM D HH:mm:ss host app: msg``; facility and level by name or number (unknown names
    are local0 and info)."""
    pri = _number(facility, FACILITIES, "local0") * 8 + _number(level, LEVELS, "info")
    when = F.date_format(ts, "MMM d HH:mm:ss")
    return df.withColumn(out, F.concat(F.lit("<"), pri.cast("string"), F.lit(">"), when, F.lit(" "), host, F.lit(" "), application, F.lit(": "), message))


def digest(df: DataFrame, source: Column, out: str, algorithm: str = "sha256", encoding: str = "base64") -> DataFrame:
    """A hash of a text in hex or base64. Algorithms: md5, sha1, sha224, sha256, sha384, sha512."""
    if algorithm == "md5":
        digits = F.md5(source)
    elif algorithm == "sha1":
        digits = F.sha1(source)
    elif algorithm in ("sha224", "sha256", "sha384", "sha512"):
        digits = F.sha2(source, int(algorithm[3:]))
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    if encoding not in ("hex", "base64"):
        raise ValueError(f"unknown encoding {encoding}")
    return df.withColumn(out, digits if encoding == "hex" else F.base64(F.unhex(digits)))


def _key(password: Column | str) -> Column:
    column = password if isinstance(password, Column) else F.lit(password)
    return F.substring(F.rpad(column, 32, "#"), 1, 32).cast("binary")


def encrypt(df: DataFrame, source: Column, password: Column | str, out: str) -> DataFrame:
    """AES-256-CBC as ``iv:cipher`` in hex, with a fresh iv for each row; the key is the password padded with ``#``."""
    if not isinstance(password, Column) and not password:
        raise ValueError("a password is required")
    mixed = F.hex(F.aes_encrypt(source.cast("binary"), _key(password), F.lit("CBC"), F.lit("PKCS")))
    return df.withColumn(out, F.lower(F.concat(F.substring(mixed, 1, 32), F.lit(":"), F.substr(mixed, F.lit(33)))))


def decrypt(df: DataFrame, source: Column, password: Column | str, out: str) -> DataFrame:
    """The text of an ``iv:cipher`` column; null where it cannot be decrypted."""
    whole = F.unhex(F.replace(source, F.lit(":"), F.lit("")))
    return df.withColumn(out, F.try_aes_decrypt(whole, _key(password), F.lit("CBC"), F.lit("PKCS")).cast("string"))
