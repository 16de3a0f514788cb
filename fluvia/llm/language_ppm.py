"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``order`` bytes, counted once over its sample and frozen. A byte
that was seen n times after a context seen T times with D different bytes has probability n / (T + D) there, an unseen
one escapes with D / (T + D) to the next shorter context, and below the empty context all 256 bytes are alike
(method C). Contexts seen less than ``seen`` times are left out, so the order varies from place to place. The code
length of a text in a language is the exact sum of its bytes' code lengths; the shortest one names the language.

Because the statistics are frozen, the code length of a byte depends on the ``order`` bytes before it alone. So the
trees of all languages are laid out as sorted arrays of contexts with one column for each language, and whole texts
are scored by array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, free_name

UNKNOWN = "und"
BLOCK = 1 << 16


def grams(data: bytes, order: int) -> np.ndarray:
    """For each byte, itself and the ``order`` bytes before it (zeros before the text) as one integer."""
    at = np.concatenate((np.zeros(order, np.uint64), np.frombuffer(data, np.uint8).astype(np.uint64)))
    out = np.zeros(len(data), np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | at[i : i + len(data)]
    return out


@dataclass
class Layer:
    """One order of all trees: grams with code lengths, contexts with the code lengths of an escape."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Trees:
    """The context trees of all languages under frozen statistics."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3, seen: int = 2) -> None:
        """``samples``: texts of each language; languages are kept in sorted order."""
        self.langs, self.order = sorted(samples), order
        whole = [np.concatenate([grams(t, order) for t in samples[x]] or [np.zeros(0, np.uint64)]) for x in self.langs]
        self.layers: list[Layer] = []
        for k in range(order + 1 if self.langs else 0):
            self._add(k, whole, seen if k else 1)

    def _add(self, k: int, whole: list[np.ndarray], seen: int) -> None:
        per = []
        for keys in whole:
            known, n = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            contexts, start = np.unique(known >> np.uint64(8), return_index=True)
            total, distinct = np.add.reduceat(n, start) if len(n) else n, np.diff(np.append(start, len(known)))
            often = total >= seen
            parent = np.repeat(np.arange(len(contexts)), distinct)
            kept = often[parent] if len(parent) else np.zeros(0, bool)
            bits = -np.log2(n / (total + distinct)[parent]) if len(n) else np.zeros(0)
            escape = -np.log2(distinct / (total + distinct))
            per.append((known[kept], bits[kept], contexts[often], escape[often]))
        keys = np.unique(np.concatenate([p[0] for p in per]))
        contexts = np.unique(np.concatenate([p[2] for p in per]))
        escapes = np.zeros((len(contexts), len(per)), np.float32)
        for j, p in enumerate(per):
            escapes[np.searchsorted(contexts, p[2]), j] = p[3]
        layer = Layer(np.zeros(0, np.uint64), np.zeros((0, len(per)), np.float32), contexts, escapes)
        self.layers.append(layer)
        bits = self._bits(k, keys)  # as if no gram were known: escapes and shorter contexts
        for j, p in enumerate(per):
            bits[np.searchsorted(keys, p[0]), j] = p[1]
        layer.grams, layer.bits = keys, bits.astype(np.float32)

    def _bits(self, k: int, keys: np.ndarray) -> np.ndarray:
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        layer = self.layers[k]
        at, hit = _find(layer.grams, keys)
        if hit.all() and len(keys):
            return layer.bits[at]
        out = np.empty((len(keys), len(self.langs)), np.float32)
        out[hit] = layer.bits[at[hit]]
        rest = keys[~hit]
        at, hit2 = _find(layer.contexts, rest >> np.uint64(8))
        escape = np.zeros((len(rest), len(self.langs)), np.float32)
        escape[hit2] = layer.escapes[at[hit2]]
        out[~hit] = escape + self._bits(k - 1, rest & np.uint64((1 << 8 * k) - 1))
        return out

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        total = np.zeros(len(self.langs))
        for at in range(0, len(data), BLOCK):
            before = data[max(0, at - self.order) : at]
            keys = grams(before + data[at : at + BLOCK], self.order)[len(before) :]
            total += self._bits(self.order, keys).sum(axis=0, dtype=np.float64)
        return total

    def measure(self, text: str | None) -> tuple[str, float, int, float]:
        """The language of the shortest code, its bits, the bytes of the text, and its share of the likelihoods; ``und``
        and zeros for a text without a letter. The first language in order wins a tie."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, 0.0
        data = text.encode("utf-8", "surrogatepass")
        bits = self.code_lengths(data)
        best = int(bits.argmin())
        return self.langs[best], float(bits[best]), len(data), float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the likelihoods."""
        lang, _, _, share = self.measure(text)
        return lang, share


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    id_col: str = "doc_id",
    sample_bytes: int = 1_500_000,
    order: int = 3,
    seen: int = 2,
) -> Trees:
    """Trees from the rows of ``docs`` that have a language and a text.

    ``sample_bytes`` bounds what each language gives. A text gives its first ``sample_bytes`` characters at most; where a
    language has more, rows are drawn by a hash with the share that the bound is of all its bytes, and of those, in the
    order of that hash, rows come to the driver up to the one that reaches the bound. No rows give trees without
    languages, which answer ``und``.
    """
    known = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.left(F.col(text), F.lit(sample_bytes)).alias("text"), F.xxhash64(F.col(id_col), F.length(text)).alias("draw")
    )
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"))
    drawn = known.join(sizes, "lang").filter(F.expr(f"(draw & 1048575) / 1048576D < {sample_bytes} / n"))
    sorted_ = Window.partitionBy("lang").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(sorted_), F.lit(0))
    samples: dict[str, list[bytes]] = {}
    for r in drawn.withColumn("before", before).filter(F.col("before") < sample_bytes).orderBy("lang", "draw", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass"))
    return Trees(samples, order, seen)


def fit_on_rest(docs: DataFrame, folds: int = 4, held_out: int = 2, **options) -> Trees:
    """``fit`` on the rows whose crc32 of the id as text, modulo ``folds``, is not ``held_out``."""
    return fit(docs.filter(crc32_mod(options.get("id_col", "doc_id"), folds) != held_out), **options)


def predict(docs: DataFrame, trees: Trees, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the predicted language and its score to every row, from the whole text alone; columns of those names are
    replaced. Null texts and texts without a letter are ``und`` with score 0. Repeated rows stay rows, no rows give no
    rows. Long texts are scored in blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score"])

    name = free_name([*docs.columns, lang_out, score_out], "guess")
    judged = docs.withColumn(name, guess(F.col(text)))
    return judged.withColumns({lang_out: F.col(f"{name}.lang"), score_out: F.col(f"{name}.score")}).drop(name)


def usual_rates(docs: DataFrame, trees: Trees, text: str = "text", parts: int = 16) -> dict[str, float]:
    """For each predicted language the middle, over all documents, of the bits a byte that their texts take: read off
    counts by bins of ``1 / parts`` bit, which is all that comes to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang string, bin int")
    def placed(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.measure(t) for t in texts]
        return pd.DataFrame({"lang": [x for x, *_ in found], "bin": [int(bits / max(1, n) * parts) for _, bits, n, _ in found]})

    counts = docs.select(placed(F.col(text)).alias("p")).groupBy("p.lang", "p.bin").agg(F.count("*").alias("n")).collect()
    out = {}
    for lang in {r["lang"] for r in counts} - {UNKNOWN}:
        own = sorted((r["bin"], r["n"]) for r in counts if r["lang"] == lang)
        whole, seen = sum(n for _, n in own), 0
        for at, n in own:
            seen += n
            if 2 * seen >= whole:
                out[lang] = (at + 0.5) / parts
                break
    return out


def keep_known(
    docs: DataFrame, trees: Trees, rates: dict[str, float], least: float = 0.5, times: float = 3.0, spare: int = 16, text: str = "text"
) -> DataFrame:
    """Documents stay if a language claims them: one has at least ``least`` of the likelihood, and the code of the text
    in it takes at most ``times`` the usual bits a byte of that language (see ``usual_rates``), ``spare`` bytes more
    granted for short texts. So foreign and garbled texts go, whose code is long in every learned language. Null texts and
    texts without a letter go. The columns stay, whatever their names, and so do repeated rows; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((trees, rates))

    @F.pandas_udf("boolean")
    def claimed(texts: pd.Series) -> pd.Series:
        own, usual = shared.value
        out = []
        for t in texts:
            lang, bits, n, share = own.measure(t)
            out.append(lang != UNKNOWN and share >= least and bits <= times * usual.get(lang, 8.0) * (n + spare))
        return pd.Series(out, dtype=bool)

    return docs.filter(claimed(F.col(text)))
