"""Order MinHash fingerprints, which follow the edit distance of texts, from SQL functions alone.

Marcais et al., "Locality-sensitive hashing for the edit distance" (2019). The k-mers of a text are runs of
``k`` words; the i-th occurrence of a k-mer is an element of its own. Elements are hashed once and dealt into
``slots`` by the top bits of the hash (one permutation for all slots). Of each slot the ``pick`` smallest elements are
kept, put back into text order, and hashed as a tuple: a slot agrees between two texts only if the same k-mers, with
the same occurrence numbers, come in the same order.

Everything stays inside a row: an element is one long, 36 bits of hash over 28 bits of position, so sorting longs
brings the occurrences of a k-mer together in text order. Ideographs are words of one character, and words of more
than 16 characters are cut, so texts without blanks have k-mers, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"\p{IsIdeographic}|[^\s\p{IsIdeographic}]{1,16}"
LOW = (1 << 28) - 1
SLOT_BITS = 5


def sketch(df: DataFrame, text: str, out: str, k: int = 3, pick: int = 2) -> DataFrame:
    """Adds ``out``: an array of longs, the slots in use (the slot's number over 32 bits of hash), ascending.

    Null and empty texts and texts of white space have an empty array; fewer than ``k`` words are one k-mer. Each
    step is a column of its own that the next reads more than once, so that none is evaluated inside a lambda.
    """
    kept = df.columns
    unit, n, e, s, t = (f"_{out}_{x}" for x in ("unit", "n", "elements", "starts", "chosen"))
    grams = ", ".join(f"get({unit}, i + {j})" for j in range(k))
    keyed = f"(xxhash64(%s) & {~LOW}L) | (get({e}, t) & {LOW}L)"
    kmer = f"shiftrightunsigned(get({e}, t), 28)"
    slot = f"shiftrightunsigned(%s, {64 - SLOT_BITS})"
    df = df.select("*", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)).alias(unit))
    df = df.select(
        *kept,
        F.expr(
            f"if(size({unit}) = 0, cast(array() as array<bigint>), sort_array(transform("
            f"sequence(0, greatest(size({unit}) - {k}, 0)), i -> (xxhash64({grams}) & {~LOW}L) | cast(i as bigint))))"
        ).alias(e),
    )
    df = df.select(
        *kept,
        e,
        F.size(e).alias(n),
        F.expr(
            f"if(size({e}) = 0, cast(array() as array<int>), filter(sequence(0, size({e}) - 1), "
            f"t -> t = 0 or {kmer} <> shiftrightunsigned(get({e}, t - 1), 28)))"
        ).alias(s),
    )
    run_end = f"coalesce(get({s}, j + 1), {n})"
    again = (
        f"flatten(transform(filter(sequence(0, size({s}) - 1), j -> {run_end} - get({s}, j) > 1), "
        f"j -> transform(sequence(get({s}, j) + 1, {run_end} - 1), t -> {keyed % f'{kmer}, t - get({s}, j)'})))"
    )
    df = df.select(
        *kept,
        F.expr(
            f"if({n} = 0, cast(array() as array<bigint>), sort_array(concat("
            f"transform({s}, t -> {keyed % f'{kmer}, 0'}), "
            f"if(size({s}) = {n}, cast(array() as array<bigint>), {again}))))"
        ).alias(t),
    )
    text_order = (
        f"sort_array(transform(filter(slice({t}, i + 1, {pick}), x -> {slot % 'x'} = {slot % f'get({t}, i)'}), "
        f"x -> shiftleft(x & {LOW}L, 36) | shiftrightunsigned(x, 28)))"
    )
    # slots come in the order of unsigned numbers, sorting in that of signed ones, so the result is sorted again
    return df.select(
        *kept,
        F.expr(
            f"if(size({t}) = 0, cast(array() as array<bigint>), sort_array(transform(filter(sequence(0, size({t}) - 1), "
            f"i -> i = 0 or {slot % f'get({t}, i)'} <> {slot % f'get({t}, i - 1)'}), "
            f"i -> shiftleft({slot % f'get({t}, i)'}, 32) | "
            f"(xxhash64(transform({text_order}, x -> x & {(1 << 36) - 1}L)) & 4294967295L))))"
        ).alias(out),
    )


def likeness(a: str, b: str):
    """Share of slots in use in either sketch that agree, from 0 to 1; 1 for two empty sketches."""
    slots = f"size(array_union(transform({a}, x -> shiftright(x, 32)), transform({b}, x -> shiftright(x, 32))))"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, size(array_intersect({a}, {b})) / {slots})")


def as_text(a: str):
    """A sketch as text: ten hex digits a slot."""
    return F.expr(f"array_join(transform({a}, x -> lower(lpad(hex(x), 10, '0'))), '')")


def with_next(df: DataFrame, id_col: str, carry: list[str], prefix: str = "next_", parts: int | None = None) -> DataFrame:
    """Adds for each column of ``carry`` the value of the next row in ascending order of a whole-number id (null ids
    first, ties by the first carried column); after the last row comes the first.

    Rows are dealt by ranges of ids, cut at approximate quantiles; the first row of each range also goes to the range
    before it, so every row is shuffled once and no task holds more than a few ranges.
    """
    spark = df.sparkSession
    parts = parts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    shares = [i / parts for i in range(1, parts)]
    keys = df.select(key.alias("key"))
    cuts = keys.agg(F.percentile_approx("key", shares, 20_000)).first()[0] or []
    cuts = sorted(set(cuts))
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    if cuts:
        listed, powers = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, steps))
        bucket = F.aggregate(  # binary search: cuts at or below the key
            powers, F.lit(0), lambda at, p: F.when(F.get(listed, at + p - 1) <= F.col("_key"), at + p).otherwise(at)
        )
    else:
        bucket = F.lit(0)
    placed = keys.select(F.col("key").alias("_key")).select(bucket.alias("bucket"), "_key")
    first = {r["bucket"]: r["key"] for r in placed.groupBy("bucket").agg(F.min("_key").alias("key")).collect()}
    if not first:
        return df.select("*", *(F.col(c).alias(prefix + c) for c in carry))
    there = sorted(first)
    before = dict(zip(there, [there[-1], *there[:-1]], strict=True))
    span = range(len(cuts) + 1)
    heads = F.array(*(F.lit(first.get(b)).cast("long") for b in span))
    backs = F.array(*(F.lit(before.get(b)).cast("int") for b in span))
    own = df.select("*", key.alias("_key")).select("*", bucket.alias("_bucket"))
    home = F.struct(F.col("_bucket").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(backs, F.col("_bucket")).alias("part"), F.lit(True).alias("guest"))
    is_head = F.get(heads, F.col("_bucket")) == F.col("_key")
    dealt = own.select("*", F.explode(F.when(is_head, F.array(home, guest)).otherwise(F.array(home))).alias("_at"))
    order = Window.partitionBy("_at.part").orderBy("_at.guest", "_key", carry[0])
    led = dealt.select("*", *(F.lead(c).over(order).alias(prefix + c) for c in carry))
    return led.filter(~F.col("_at.guest")).drop("_key", "_bucket", "_at")


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: ``id_col, n_chars, edited, sketch, edited_sketch, next_sketch``.

    ``edited`` is the text whose last quarter (whole code points, rounded down) is replaced by as many code points
    from the start of the next document's text, or by all of it. Null texts are empty; repeated rows stay rows.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chained = with_next(sketch(own, "text", "sketch"), "_id", ["text", "sketch"])
    sized = chained.select("*", F.length("text").alias("n"))
    edited = F.expr("concat(left(text, n - n div 4), left(next_text, n div 4))")
    made = sized.select("_id", F.col("n").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return sketch(made, "edited", "edited_sketch").withColumnRenamed("_id", id_col)
