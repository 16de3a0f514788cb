"""Quality rules: fixed limits, then robust multivariate outliers of text statistics.

Documents of each language and source have a centre and a covariance by the minimum covariance determinant: those of the
three quarters of the rows whose covariance has the least determinant (Rousseeuw and Van Driessen, 1999).

* Starts: of each group a bounded sample (about ``sample`` rows, drawn by chance) goes to one task. There ``STARTS`` random
  small subsets are each led to the nearest rows by two concentration steps, the best ten until they no longer change,
  and the one with the least determinant starts the group.
* Concentration runs over all rows, as Spark aggregations: one counts the rows of each group by narrow bins of their
  squared Mahalanobis distance, which gives the distance that holds three quarters of the group; one adds up sums and
  products of the rows within, one row a group and task. Steps repeat until no group's determinant falls.
* Reweighting: the covariance is made consistent with the normal distribution, rows within the 97.5 % ellipsoid give
  the final estimates, and these are made consistent again.

Statistics that hardly vary (most texts have no symbols at all) would give singular covariances and reject whatever
differs a little; so variances along the principal axes are at least those of ``LEAST``, measured in its units. Where a
least variance applies, distances are shorter than chi-square, never longer. Rows are rejected whose squared distance
exceeds the chi-square quantile ``limit``. Groups with fewer than ``least_group`` rows borrow the estimates of their
language, and languages those of all rows; ``level`` tells which was used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

SYMBOLS = b"#*$%&|<>"
SALTS = 64
#: Bins a doubling of the squared distance, over 2^-12 to 2^12.
FINE, FAR = 32, 12
STARTS = 40
#: By how much the logarithm of the determinant has to fall for another step.
FALL = 1e-4
STATS = ("s_words", "s_length", "s_symbols", "s_lines", "s_repeats")
#: Least standard deviation of each statistic, in its own unit: what differs by less is alike.
LEAST = (0.5, 0.08, 0.05, 0.5, 0.17)
PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text has more than once, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    window = code[:n]
    for i in range(1, size):  # rank after each word, so that no two windows share a number
        window = np.unique(window * len(ids) + code[i : i + n], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(window)[window] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words in repeated windows of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at exactly the six ASCII blanks
    blanks = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = Counter(x for x in data.split(b"\n") if x.strip())
    return len(words), len(text or "") - blanks, symbols, sum(n - 1 for n in lines.values()), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        rows = np.array([base_statistics(t.as_py()) for t in batch.column(3)], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(rows[:, i]) for i in range(5))], names)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``id, lang, source`` and the base statistics of every row."""
    own = docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return own.mapInArrow(_measured, f"id {kind}, lang string, source string, {counts}")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def transformed() -> list[Column]:
    """The statistics on scales where typical documents spread evenly. The mean word length counts 50 words of 5 code
    points along, as that of few words spreads more than that of many."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words").alias(STATS[0]),
        F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)).alias(STATS[1]),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias(STATS[2]),
        F.log1p("n_dup_lines").alias(STATS[3]),
        F.sqrt(F.col("n_repeat_words") / words).alias(STATS[4]),
    ]


def chi_cdf(x: float, freedom: int) -> float:
    """Share of a chi-square distribution below ``x``, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi_square(share: float, freedom: int) -> float:
    """The quantile, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_cdf(mid, freedom) < share else (low, mid)
    return low


def consistency(share: float, freedom: int) -> float:
    """By how much the covariance of the nearest ``share`` of normal rows falls short of that of all."""
    return share / chi_cdf(chi_square(share, freedom), freedom + 2)


def bounded(cov: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance with variances of at least 1 along its principal axes in units of ``least``, inverted, and the
    logarithm of its determinant in those units."""
    unit = np.outer(least, least)
    values, axes = np.linalg.eigh(cov / unit)
    values = np.maximum(values, 1.0)
    return (axes / values) @ axes.T / unit, float(np.log(values).sum())


def concentrate(rows: np.ndarray, subset: np.ndarray, held: int, least: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Concentration steps from a subset; the ``held`` nearest rows of the last one and their log determinant."""
    seen = math.inf
    for _ in range(steps):
        own = rows[subset]
        centre = own.mean(axis=0)
        inverse, size = bounded(np.cov(own.T, bias=True), least)
        if len(subset) == held and size >= seen - 1e-9:
            break
        seen = size if len(subset) == held else math.inf
        off = rows - centre
        d2 = np.einsum("ij,jk,ik->i", off, inverse, off)
        subset = np.argsort(d2, kind="stable")[:held]
    return subset, bounded(np.cov(rows[subset].T, bias=True), least)[1]


def least_determinant(rows: np.ndarray, coverage: float, least: np.ndarray, starts: int = STARTS, seed: int = 1) -> np.ndarray:
    """Indexes of the ``coverage`` of the rows whose covariance has the least determinant found from random starts."""
    n, rng = len(rows), np.random.default_rng(seed)
    held = min(n, math.ceil(coverage * n))
    found = []
    for _ in range(starts):
        subset, size = concentrate(rows, rng.permutation(n)[: rows.shape[1] + 1], held, least, 3)
        found.append((size, subset.tolist()))
    ends = [concentrate(rows, np.array(subset), held, least, 100) for _, subset in sorted(found)[:10]]
    return min(ends, key=lambda e: e[1])[0]


def _estimate(grp: str, centre: np.ndarray, cov: np.ndarray, n: int, scale: float) -> dict:
    inverse, size = bounded(cov * scale, np.array(LEAST))
    out = {"grp": grp, "n": int(n), "size": size} | {f"c{i}": float(centre[i]) for i in range(len(STATS))}
    return out | {f"i{i}_{j}": float(inverse[i, j]) * (1 if i == j else 2) for i, j in PAIRS}


ESTIMATES = "grp string, n long, size double, " + ", ".join(
    [f"c{i} double" for i in range(len(STATS))] + [f"i{i}_{j} double" for i, j in PAIRS]
)


def _distance() -> Column:
    d = [F.col(s) - F.col(f"c{i}") for i, s in enumerate(STATS)]
    return sum((F.col(f"i{i}_{j}") * d[i] * d[j] for i, j in PAIRS[1:]), F.col("i0_0") * d[0] * d[0])


def _binned(distance: Column) -> Column:
    at = F.floor(FINE * (F.log2(F.greatest(distance, F.lit(2.0**-FAR))) + FAR))
    return F.least(at, F.lit(2 * FINE * FAR)).cast("int")


def _over_salts(estimates: DataFrame) -> DataFrame:
    """A group may hold a third of the rows, and one holds all: its rows are dealt over salts, its estimates copied."""
    return estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _gathered(near: DataFrame, scale: float) -> DataFrame:
    """New estimates from the rows of ``near``, which bear their group's old centre: deviations are added up."""
    off = [F.col(s) - F.col(f"c{i}") for i, s in enumerate(STATS)]
    sums = [F.sum(x).alias(f"m{i}") for i, x in enumerate(off)]
    products = [F.sum(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in PAIRS]
    old = [F.first(f"c{i}").alias(f"o{i}") for i in range(len(STATS))]
    added = near.groupBy("grp").agg(F.count("*").alias("n"), *sums, *products, *old)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ESTIMATES.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                mean = np.array([r[f"m{i}"] for i in range(len(STATS))]) / r["n"]
                cov = np.zeros((len(STATS), len(STATS)))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
                centre = mean + [r[f"o{i}"] for i in range(len(STATS))]
                out.append(_estimate(r["grp"], centre, cov, r["n"], scale))
            yield pd.DataFrame(out, columns=names)

    return added.mapInPandas(made, ESTIMATES)


def fit(
    rows: DataFrame, tables: Tables, least_group: int = 50, coverage: float = 0.75, sample: int = 500, most_steps: int = 30
) -> DataFrame:
    """``rows(lang, source, STATS)`` -> estimates by ``grp``; ``grp`` is a language and source, a language, or all.

    Each row counts in its group, its language and in all. A ``RuntimeError`` tells that the steps did not converge.
    """
    salted = rows.select("lang", "source", *STATS, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    levels = salted.select(F.explode(group_names()).alias("grp"), "salt", *STATS)
    sizes = levels.groupBy("grp").agg(F.count("*").alias("rows")).filter((F.col("rows") >= least_group) | (F.col("grp") == "*"))
    sizes = tables.write(sizes)
    drawn = levels.join(_over_salts(sizes), ["grp", "salt"]).filter(F.rand(7) * F.col("rows") < sample)

    def start(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        values = own[list(STATS)].to_numpy()
        values = values[np.lexsort(values.T)]  # the order of arrival plays no part
        near = values[least_determinant(values, coverage, np.array(LEAST))]
        return pd.DataFrame([_estimate(key[0], near.mean(axis=0), np.cov(near.T, bias=True), len(near), 1.0)])

    now = tables.write(drawn.groupBy("grp").applyInPandas(start, ESTIMATES))
    for step in range(most_steps):
        counts = levels.join(_over_salts(now), ["grp", "salt"]).groupBy("grp", _binned(_distance()).alias("bin")).agg(F.count("*").alias("k"))
        of_group = Window.partitionBy("grp")
        upto = counts.select("grp", "bin", F.sum("k").over(of_group.orderBy("bin")).alias("within"), F.sum("k").over(of_group).alias("whole"))
        limits = upto.filter(F.col("within") >= coverage * F.col("whole")).groupBy("grp").agg(F.min("bin").alias("most"))
        near = levels.join(_over_salts(now.join(limits, "grp")), ["grp", "salt"]).filter(_binned(_distance()) <= F.col("most"))
        made = _gathered(near, 1.0).withColumn("falls", F.lit(True))
        if step:  # the first one leads from the sample to all rows
            kept = [F.when(F.expr(f"a.size < b.size - {FALL}"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in now.columns if c != "grp"]
            falls = F.expr(f"a.size < b.size - {FALL}").alias("falls")
            made = made.drop("falls").alias("a").join(now.alias("b"), "grp").select("grp", *kept, falls)
        made = tables.write(made)
        tables.drop(now)
        now = made.drop("falls")
        now.written_path = made.written_path
        if made.filter("falls").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"no convergence in {most_steps} concentration steps")
    freedom = len(STATS)
    widened = levels.join(_over_salts(now), ["grp", "salt"]).filter(_distance() <= chi_square(0.975, freedom) * consistency(coverage, freedom))
    final = tables.write(_gathered(widened, consistency(0.975, freedom)))
    tables.drop(now)
    return final


def _named(x: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("null"))


def group_names() -> Column:
    """The row's group, its language, and all rows; null languages and sources are groups of their own."""
    lang = F.concat(F.length(_named("lang")).cast("string"), F.lit(":"), _named("lang"))
    return F.array(F.concat(lang, F.lit("/"), _named("source")), lang, F.lit("*"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_group: int = 50,
    limit: float = 1 - 1e-4,
    name: str = "robust-outliers",
) -> DataFrame:
    """One row per document: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2,
    level, kept``.

    Null texts are empty and fail the fixed limits, as do very short ones. Estimates use the documents that pass them.
    ``d2`` is the squared distance from the centre of the group, ``level`` the group it was taken from (``source``,
    ``language`` or ``all``); both are null if the limits failed. ``kept`` is false if they failed or ``d2`` exceeds the
    chi-square quantile ``limit``. Null languages and sources are groups of their own, repeated rows stay rows, no rows
    give no rows, and other columns, whatever their names, are not read. A text of any length is read whole, in a
    worker's memory.
    """
    tables = Tables(docs.sparkSession, name)
    counted = tables.write(measured(docs, id_col, text, lang, source))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    rows = counted.select("*", failed.alias("base_failed"), *transformed())
    estimates = fit(rows.filter(~F.col("base_failed")), tables, least_group).drop("n", "size")
    # the finest level with estimates: names of groups that have some, looked up level by level on the few groups
    groups = rows.select("lang", "source").distinct().select("lang", "source", F.posexplode(group_names()).alias("level", "grp"))
    picked = groups.join(estimates, "grp").groupBy("lang", "source").agg(F.min_by("grp", "level").alias("grp"), F.min("level").alias("at"))
    levels = F.get(F.array(*map(F.lit, ("source", "language", "all"))), F.col("at")).alias("level")
    by_group = tables.write(picked.join(estimates, "grp").select(F.struct("lang", "source").alias("of"), levels, *[c for c in estimates.columns if c != "grp"]))
    joined = rows.join(by_group, F.struct(rows["lang"], rows["source"]).eqNullSafe(by_group["of"]), "left")
    d2 = F.when(~F.col("base_failed"), _distance())
    far = d2 > chi_square(limit, len(STATS))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        d2.alias("d2"),
        F.when(~F.col("base_failed"), F.col("level")).alias("level"),
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
    )
