"""From raw text to structure. Every extractor keeps the row; what cannot be read is null, and ``quarantine`` splits it off.

Extractors that take a schema take it as DDL.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import array_to_map
from .enrich import FACILITIES, LEVELS

ERROR = "_error"


def quarantine(df: DataFrame, error: str = ERROR) -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and bad rows with it."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def json_extract(df: DataFrame, source: str, schema: str, out: str | None = None, error: str = ERROR) -> DataFrame:
    """Parses JSON by a schema into a struct column ``out``, or into columns of the row.

    Text that is not JSON of that shape leaves nulls and its own text in ``error``; null text is no error.
    """
    parsed = F.from_json(F.col(source), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = df.withColumn("__fluvia_parsed", parsed)
    bad = F.when(F.col(source).isNotNull() & (F.col("__fluvia_parsed").isNull() | F.col("__fluvia_parsed._bad").isNotNull() | (F.trim(source) == "")), F.col(source))
    df = df.withColumn(error, bad)
    value = F.when(F.col(error).isNull(), F.col("__fluvia_parsed").dropFields("_bad"))
    if out:
        return df.withColumn(out, value).drop("__fluvia_parsed")
    names = [f for f in df.schema["__fluvia_parsed"].dataType.names if f != "_bad"]
    return df.withColumns({n: value.getField(n) for n in names}).drop("__fluvia_parsed")


def json_variant(df: DataFrame, source: str, out: str, error: str = ERROR) -> DataFrame:
    """Parses JSON of any shape into a variant column."""
    df = df.withColumn(out, F.try_parse_json(source))
    return df.withColumn(error, F.when(F.col(source).isNotNull() & F.col(out).isNull(), F.col(source)))


def unpack_dotted(df: DataFrame, source: str, shape: Mapping | Sequence, out: str) -> DataFrame:
    """Nests a map column with dotted keys (``a.b.0``; whole numbers are array indexes) into a declared shape.

    ``shape`` is a dict of fields whose values are dicts, lists of item shapes, or ``None`` for a leaf.
    """

    def build(at: Mapping | Sequence | None, key: str) -> Column:
        dot = f"{key}." if key else ""
        if at is None:
            return F.try_element_at(F.col(source), F.lit(key))
        if isinstance(at, Mapping):
            return F.struct(*(build(v, dot + k).alias(k) for k, v in at.items()))
        return F.array(*(build(v, f"{dot}{i}") for i, v in enumerate(at)))

    return df.withColumn(out, build(shape, ""))


def csv_extract(df: DataFrame, source: str, schema: str, out: str | None = None, options: Mapping[str, str] | None = None, error: str = ERROR) -> DataFrame:
    """Parses a CSV line by a schema; lines with too few columns or values of another type go to ``error``."""
    given = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"} | dict(options or {})
    df = df.withColumn("__fluvia_parsed", F.from_csv(F.col(source), f"{schema}, _bad string", given))
    df = df.withColumn(error, F.when(F.col(source).isNotNull() & F.col("__fluvia_parsed._bad").isNotNull(), F.col(source)))
    value = F.when(F.col(error).isNull(), F.col("__fluvia_parsed").dropFields("_bad"))
    if out:
        return df.withColumn(out, value).drop("__fluvia_parsed")
    names = [f for f in df.schema["__fluvia_parsed"].dataType.names if f != "_bad"]
    return df.withColumns({n: value.getField(n) for n in names}).drop("__fluvia_parsed")


def xml_elements(source: Column, tag: str) -> Column:
    """Every outermost ``<tag ...>...</tag>`` and ``<tag .../>`` of a text, in order.

    One match of a pattern finds them where none nests in itself. Where one does, the text is cut at its tags, and a
    fold over the cuts counts how many are open.
    """
    name = re.escape(tag)
    opened = rf"<{name}(?:\s[^<>]*?)?"
    plain = F.regexp_extract_all(source, F.lit(rf"(?s){opened}(?:/>|(?<!/)>.*?</{name}\s*>)"), F.lit(0))
    nested = F.exists(plain, lambda x: F.regexp_count(x, F.lit(rf"{opened}(?<!/)>")) > 1)
    cuts = F.regexp_extract_all(source, F.lit(rf"(?s).*?(?:{opened}/?>|</{name}\s*>)"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, cut: Column) -> Column:
        token = F.regexp_extract(cut, rf"(?:{opened}/?>|</{name}\s*>)\z", 0)
        ends, alone = token.startswith("</"), token.endswith("/>")
        depth = F.greatest(state["depth"] + F.when(ends, -1).when(alone, 0).otherwise(1), F.lit(0))
        text = F.concat(state["open"], F.when(state["depth"] > 0, cut).when(ends, "").otherwise(token))
        done = (depth == 0) & (text != "")
        found = F.when(done, F.array_append(state["found"], text)).otherwise(state["found"])
        return F.struct(depth.alias("depth"), F.when(done, "").otherwise(text).alias("open"), found.alias("found"))

    return F.when(nested, F.aggregate(cuts, start, step, lambda s: s["found"])).otherwise(plain)


def xml_extract(df: DataFrame, source: str, schema: str, out: str, tag: str | None = None, error: str = ERROR) -> DataFrame:
    """Parses XML by a schema; attributes are fields beside the elements, text beside attributes is ``_``.

    With ``tag``, ``out`` is the array of all elements of that name in the text; a text without one has an empty array,
    and ``error`` is the first element that cannot be read.
    """
    options = {"attributePrefix": "", "valueTag": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    one = lambda c: F.from_xml(c, f"{schema}, _bad string", options)
    if tag is None:
        df = df.withColumn("__fluvia_parsed", one(F.col(source)))
        bad = F.col(source).isNotNull() & (F.col("__fluvia_parsed").isNull() | F.col("__fluvia_parsed._bad").isNotNull())
        df = df.withColumn(error, F.when(bad, F.col(source)))
        return df.withColumn(out, F.when(F.col(error).isNull(), F.col("__fluvia_parsed").dropFields("_bad"))).drop("__fluvia_parsed")
    df = df.withColumn("__fluvia_items", F.transform(xml_elements(F.col(source), tag), lambda x: F.struct(x.alias("xml"), one(x).alias("parsed"))))
    bad = F.filter("__fluvia_items", lambda x: x["parsed"].isNull() | x["parsed"]["_bad"].isNotNull())
    df = df.withColumn(error, F.get(bad, F.lit(0))["xml"])
    return df.withColumn(out, F.transform("__fluvia_items", lambda x: x["parsed"].dropFields("_bad"))).drop("__fluvia_items")


def xml_rows(df: DataFrame, source: str, schema: str, tag: str, error: str = ERROR) -> DataFrame:
    """One row for each element named ``tag``, with its fields as columns; other columns stay, the text goes."""
    options = {"attributePrefix": "", "valueTag": "_", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    each = df.withColumn("__fluvia_xml", F.explode(xml_elements(F.col(source), tag))).drop(source)
    each = each.withColumn("__fluvia_parsed", F.from_xml(F.col("__fluvia_xml"), f"{schema}, _bad string", options))
    each = each.withColumn(error, F.when(F.col("__fluvia_parsed").isNull() | F.col("__fluvia_parsed._bad").isNotNull(), F.col("__fluvia_xml")))
    names = [f for f in each.schema["__fluvia_parsed"].dataType.names if f != "_bad"]
    return each.withColumns({n: F.col("__fluvia_parsed").getField(n) for n in names}).drop("__fluvia_xml", "__fluvia_parsed")


WINEVT_SCHEMA = (
    "System struct<Provider: struct<Name: string>, EventID: struct<`_`: string, Qualifiers: string>, Level: string, "
    "Task: string, Keywords: string, TimeCreated: struct<SystemTime: string>, EventRecordID: string, Channel: string, "
    "Computer: string>, EventData struct<Data: array<struct<`_`: string, Name: string>>>"
)


def winevt_extract(df: DataFrame, source: str, out: str = "event", error: str = ERROR) -> DataFrame:
    """Windows event XML: the system fields with the event id and its qualifiers apart, the time again as
    ``SystemTime``, and the event data as a map by name. Unnamed items are keyed by their place; a single unnamed one is
    ``Message``."""
    df = xml_extract(df, source, WINEVT_SCHEMA, "__fluvia_event", error=error)
    system, items = F.col("__fluvia_event.System"), F.col("__fluvia_event.EventData.Data")
    key = lambda x, i: F.coalesce(x["Name"], F.when(F.size(items) == 1, "Message").otherwise(i.cast("string")))
    data = array_to_map(F.transform(items, lambda x, i: F.struct(key(x, i).alias("k"), x["_"].alias("v"))))
    flat = system.withField("Qualifiers", system["EventID"]["Qualifiers"]).withField("EventID", system["EventID"]["_"])
    event = F.struct(flat.alias("System"), system["TimeCreated"]["SystemTime"].alias("SystemTime"), data.alias("Data"))
    return df.withColumn(out, F.when(F.col("__fluvia_event").isNotNull(), event)).drop("__fluvia_event")


def keyval_extract(df: DataFrame, source: str, out: str | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """``key=value`` pairs between blanks; quoted values may hold blanks. A map in ``out``, or columns for ``fields``.

    Values run to the next blank, so they may hold ``=``; of equal keys the last one counts; a key alone is ignored.
    """
    text = F.coalesce(F.col(source), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r'([^ =]+)=("[^"]*"|[^ ]*)'), F.lit(0))
    cut = lambda p: F.split(p, "=", 2)
    bare = lambda v: F.when(v.startswith('"') & v.endswith('"') & (F.length(v) >= 2), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    halves = F.transform(found, cut)
    pairs = F.transform(halves, lambda h: F.struct(h[0].alias("k"), bare(h[1]).alias("v")))
    if out:
        return df.withColumn(out, F.when(F.col(source).isNotNull(), array_to_map(pairs)))

    def last(field: str) -> Column:
        own = F.filter(pairs, lambda p: p["k"] == field)
        return F.when(F.size(own) > 0, F.element_at(own, -1)["v"])

    return df.withColumns({f: last(f) for f in fields})


def regex_extract(df: DataFrame, source: str, pattern: str, fields: Sequence[str], out: str | None = None) -> DataFrame:
    """Groups of the first match as fields; groups beyond ``fields`` are named by their number from 0. Rows without a
    match keep what they had in those columns (null if new)."""
    groups = re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern)).groups
    names = [fields[i] if i < len(fields) and fields[i] else str(i) for i in range(groups)]
    hit = F.coalesce(F.rlike(F.col(source), F.lit(pattern)), F.lit(False))
    found = {n: F.regexp_extract(F.col(source), pattern, i + 1) for i, n in enumerate(names)}
    if out:
        return df.withColumn(out, F.when(hit, F.struct(*(c.alias(n) for n, c in found.items()))))
    there = set(df.columns)
    return df.withColumns({n: F.when(hit, c).otherwise(F.col(n) if n in there else F.lit(None)) for n, c in found.items()})


_PARAM = r" ([^\s\]=\"]+)=\"([^\"\\\]]*+(?:\\.[^\"\\\]]*+)*+)\""
_SD = r"-|(?:\[[^\s\]=\"]++(?:" + _PARAM + r")*+\])++"
_RFC5424 = r"(?s)^<\d{1,3}>\d{1,2} \S+ \S+ \S+ \S+ \S+ (?:" + _SD + r")(?: .*)?$"
_BSD = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}|[A-Z][a-z]{2} \d \d{2}:\d{2}:\d{2}) (\S+) (?:([^\s:\[]+)(?:\[([^\]]*)\])?: ?)?(.*)$"
_CEF_FIELD = r"([^|\\]*+(?:\\.[^|\\]*+)*+)\|"
_CEF = r"(?s)^(?:<\d{1,3}>)?.*?(CEF:\d+\|" + 6 * _CEF_FIELD.replace("([^", "(?:[^", 1) + r")(.*)$"
_CEF_PAIR = r"(?s)([^\s=|]+)=(.*?)(?=\s+[^\s=|]+=|\s*$)"


def syslog_extract(df: DataFrame, source: str, out: str = "syslog") -> DataFrame:
    """RFC 5424, BSD and CEF lines as one struct; ``type`` tells which, null where none fits.

    Fields: ``prival, facilityval, levelval, facility, level, version, type, ts (text), host, app_name, pid, messageid,
    message, structured_data`` (array of maps with ``$id``), ``cef`` (struct) and ``fields`` (map of the CEF extension).

    The kind is found once a line. A CEF line is matched for its header and its extension; the header is then cut at its bars and the
    extension into pairs, each in one pass. An RFC 5424 header is cut at its blanks, and only its structured data and what
    the BSD form needs are matched again. No expression recurses with the length of a field.
    """
    c, kind, parts, data = F.col(source), F.col("__fluvia_kind"), F.col("__fluvia_parts"), F.col("__fluvia_data")
    head, heads, extension, pieces = (F.col(f"__fluvia_{x}") for x in ("head", "heads", "extension", "pieces"))
    # the header from "CEF:" on, empty where the line is no CEF
    df = df.withColumn("__fluvia_head", F.when(F.contains(c, F.lit("CEF:")), F.regexp_extract(c, _CEF, 1)))
    found = F.when(head != "", "CEF")
    found = found.when(F.startswith(c, F.lit("<")) & F.rlike(c, F.lit(_RFC5424)), "RFC5424").when(F.rlike(c, F.lit(_BSD)), "BSD")
    df = df.withColumn("__fluvia_kind", found)
    df = df.withColumn("__fluvia_parts", F.when(kind == "RFC5424", F.split(c, " ", 7)))
    df = df.withColumn("__fluvia_data", F.regexp_extract(parts[6], f"^(?:{_SD})", 0))
    df = df.withColumn("__fluvia_heads", F.when(kind == "CEF", F.regexp_extract_all(head, F.lit("(?s)" + _CEF_FIELD), F.lit(1))))
    df = df.withColumn("__fluvia_extension", F.when(kind == "CEF", F.regexp_extract(c, _CEF, 2)))
    df = df.withColumn("__fluvia_pieces", F.when(kind == "CEF", F.regexp_extract_all(extension, F.lit(_CEF_PAIR), F.lit(0))))
    group = lambda p, i: F.regexp_extract(c, p, i)
    nil = lambda x: F.when((x != "-") & (x != ""), x)
    tagged = F.regexp_extract(F.left(c, F.lit(5)), r"^<(\d{1,3})>", 1)
    prival = F.when(tagged != "", tagged.cast("int"))  # a try_cast of empty text costs an exception a line
    named = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    sd = F.regexp_extract_all(data, F.lit(r"\[[^\s\]=\"]++(?:" + _PARAM + r")*+\]"), F.lit(0))
    # the message stands behind one blank, with or without a byte order mark
    message = F.regexp_replace(F.substr(parts[6], F.length(data) + 2), "^\\x{FEFF}", "")

    def element(x: Column) -> Column:
        keys = F.regexp_extract_all(x, F.lit(_PARAM), F.lit(1))
        values = F.regexp_extract_all(x, F.lit(_PARAM), F.lit(2))
        pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), F.regexp_replace(v, r'\\(["\\\]])', "$1").alias("v")))
        own = F.array(F.struct(F.lit("$id").alias("k"), F.regexp_extract(x, r"^\[([^\s\]]+)", 1).alias("v")))
        return array_to_map(F.concat(own, pairs))

    cef_names = ("version", "device_vendor", "device_product", "device_version", "device_event_class_id", "name", "severity", "extension")
    cef = F.struct(*(heads[i].alias(n) for i, n in enumerate(cef_names[:-1])), extension.alias(cef_names[-1]))
    key = lambda x: F.substring_index(x, "=", 1)
    pairs = F.transform(pieces, lambda x: F.struct(key(x).alias("k"), F.substr(x, F.length(key(x)) + 2).alias("v")))
    by = lambda rfc, bsd=None, cef=None: F.when(kind == "RFC5424", rfc).when(kind == "BSD", bsd).when(kind == "CEF", cef)
    none = F.lit(None).cast("string")
    parsed = F.struct(
        prival.alias("prival"),
        F.floor(prival / 8).cast("int").alias("facilityval"),
        (prival % 8).cast("int").alias("levelval"),
        named(FACILITIES, F.floor(prival / 8).cast("int")).alias("facility"),
        named(LEVELS, (prival % 8).cast("int")).alias("level"),
        F.split_part(parts[0], F.lit(">"), F.lit(2)).try_cast("int").alias("version"),
        kind.alias("type"),
        by(nil(parts[1]), group(_BSD, 2), none).alias("ts"),
        by(nil(parts[2]), group(_BSD, 3), none).alias("host"),
        by(nil(parts[3]), nil(group(_BSD, 4)), none).alias("app_name"),
        by(nil(parts[4]), nil(group(_BSD, 5)), none).alias("pid"),
        nil(parts[5]).alias("messageid"),
        by(message, group(_BSD, 6), c).alias("message"),
        F.when(kind == "RFC5424", F.transform(sd, element)).alias("structured_data"),
        F.when(kind == "CEF", cef).alias("cef"),
        F.when(kind == "CEF", array_to_map(pairs)).alias("fields"),
    )
    return df.withColumn(out, F.when(kind.isNotNull(), parsed)).drop(*(f"__fluvia_{x}" for x in ("kind", "parts", "data", "head", "heads", "extension", "pieces")))


def split_array(df: DataFrame, source: str, separator: str, out: str) -> DataFrame:
    return df.withColumn(out, F.split(source, re.escape(separator), -1))


def split_columns(df: DataFrame, source: str, separator: str, names: Sequence[str], out: str | None = None) -> DataFrame:
    """Pieces by place, as columns or as a struct; missing pieces are null."""
    pieces = F.split(source, re.escape(separator), -1)
    found = [F.get(pieces, F.lit(i)).alias(n) for i, n in enumerate(names)]
    return df.withColumn(out, F.struct(*found)) if out else df.select("*", *found)


def split_rows(df: DataFrame, source: str, separator: str, out: str) -> DataFrame:
    """One row for each piece, with the other columns; null text gives no row."""
    return df.withColumn(out, F.explode(F.split(source, re.escape(separator), -1)))
