"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed rows for the word and for its first three, four and five letters, so inflected
and compound forms share what their stems have learned. Filters one, two and three words wide slide over the whole
text; of each the largest few values are kept (k-max pooling, which also tells one slip from many) and weighted into a
logit. All of it is trained in numpy with Adam. The first embedding column starts at the log-odds of its hash bucket,
so rare words count from the first step.

Thresholds are calibrated by language on all labelled rows kept from training. The language is guessed from the text's words, as
the language column is no input; the logit is shifted so that the threshold of the guessed language scores 0.7.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod

WORD = re.compile(r"[^\W\d_]+")
#: Labelled ids, of some 50 bytes, up to which they are broadcast.
SENT = 1_000_000
CUT = 0.7
BLOCK = 1 << 15
HELD = 50_000
#: Bins a unit of the logit, and the logits beyond which all rows share a bin, for the thresholds.
BINS, FAR = 64, 40


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    top: int = 3
    epochs: int = 5
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall((text or "").lower())


def features(word: str, buckets: int) -> list[int]:
    """Hash buckets of the word and of its first three, four and five letters."""
    return [zlib.crc32(f"{n}:{word[:n] if n else word}".encode("utf-8", "surrogatepass")) % buckets for n in (0, 3, 4, 5)]


@dataclass
class Model:
    """The trained classifier. ``score`` takes a text and gives a number from 0 to 1."""

    shape: Shape
    embed: np.ndarray
    filters: list[np.ndarray]  # of each width: width x dim x filters
    bias: np.ndarray
    weights: np.ndarray  # all filters x top
    offset: float
    langs: list[str] = field(default_factory=list)
    lang_rows: np.ndarray | None = None  # buckets x langs
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    known: dict[str, int] = field(default_factory=dict)  # words that have a row
    rows: np.ndarray | None = None
    flat: np.ndarray | None = None

    def _projected(self, found: list[str]) -> np.ndarray:
        """The row of each word: its product with every filter position, then its log-likelihoods by language."""
        known = self.known
        if self.rows is None or len(known) + len(found) > len(self.rows):
            known.clear()
            self.flat = np.concatenate([f.transpose(1, 0, 2).reshape(self.shape.dim, -1) for f in self.filters], axis=1)
            self.rows = np.zeros((HELD + BLOCK, self.flat.shape[1] + len(self.langs)), np.float32)
        if new := [w for w in dict.fromkeys(found) if w not in known]:
            at = np.array([features(w, self.shape.buckets) for w in new])
            rows = self.rows[len(known) : len(known) + len(new)]
            rows[:, : self.flat.shape[1]] = self.embed[at].sum(axis=1) @ self.flat
            if self.langs:
                rows[:, self.flat.shape[1] :] = self.lang_rows[at[:, 0]]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return self.rows[np.fromiter(map(known.__getitem__, found), np.int64, len(found))]

    def logit(self, text: str | None) -> tuple[float, str]:
        """The logit of the whole text and its guessed language."""
        found, s = words(text), self.shape
        n, k, over = s.filters, s.top, max(s.widths) - 1
        best = np.zeros((k, n * len(s.widths)), np.float32)
        lang = np.zeros(len(self.langs))
        for at in range(0, len(found), BLOCK):
            block = found[at : at + BLOCK + over]
            size = min(BLOCK, len(found) - at)
            rows = self._projected(block)
            conv = np.empty((size, best.shape[1]), np.float32)
            column = 0
            for j, width in enumerate(s.widths):
                own = np.repeat(self.bias[None, j * n : (j + 1) * n], size, axis=0)
                for o in range(width):
                    part = rows[o : o + size, column : column + n]
                    own[: len(part)] += part
                    column += n
                conv[:, j * n : (j + 1) * n] = own
            lang += rows[:size, column:].sum(axis=0, dtype=np.float64)
            both = np.concatenate((best, conv))
            best = np.partition(both, len(both) - k, axis=0)[-k:] if len(both) > k else both
        best = np.sort(best, axis=0)[::-1]
        guess = self.langs[int(lang.argmax())] if self.langs and found else ""
        return float((best * self.weights.T).sum() + self.offset), guess

    def score(self, text: str | None) -> float:
        logit, lang = self.logit(text)
        z = logit - self.thresholds.get(lang, self.threshold) + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "rows": None}


class _Adam:
    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * m / (np.sqrt(v) + 1e-7)


def train(texts: list[str], labels: np.ndarray, shape: Shape = Shape()) -> Model:
    """Trains embeddings, filters and weights; the same rows in the same order give the same model."""
    rng = np.random.default_rng(shape.seed)
    s, vocab = shape, {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words(t)], np.int64) for t in texts]
    feats = np.array([features(w, s.buckets) for w in vocab] or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    n_pos, n_neg = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    pos, neg = np.zeros(s.buckets), np.zeros(s.buckets)
    for d, y in zip(docs, labels, strict=True):
        (pos if y else neg)[np.unique(feats[d])] += 1
    odds = np.log((pos + 0.3) / (n_pos + 0.6)) - np.log((neg + 0.3) / (n_neg + 0.6))
    odds[pos + neg < 3] = 0
    n, count = s.filters, s.filters * len(s.widths)
    embed = rng.normal(0, 0.05, (s.buckets, s.dim)).astype(np.float32)
    embed[:, 0] = 0.25 * np.clip(odds, -1, 4)
    filters = [rng.normal(0, 0.2, (w, s.dim, n)).astype(np.float32) for w in s.widths]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5 / len(f)
    bias = np.zeros(count, np.float32)
    weights = np.abs(rng.normal(0.05, 0.02, (count, s.top))).astype(np.float32)
    offset = np.array([-2.0], np.float32)
    adam = _Adam([embed, *filters, bias, weights, offset], s.rate)
    weigh = np.where(labels == 1, min(5.0, max(1.0, n_neg / n_pos)), 1.0)
    pad = max(s.widths) - 1
    for _ in range(s.epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            pick = order[at : at + s.batch]
            grads = [np.zeros_like(p) for p in adam.params]
            tail = np.full(pad, -1)
            seq = np.concatenate([x for i in pick for x in (docs[i], tail)])
            used, where = np.unique(seq, return_inverse=True)
            real = used >= 0
            vec = np.zeros((len(used), s.dim), np.float32)
            vec[real] = embed[feats[used[real]]].sum(axis=1)
            d_vec = np.zeros_like(vec)
            conv = np.empty((len(seq), count), np.float32)
            for j, w in enumerate(s.widths):
                own = np.repeat(bias[None, j * n : (j + 1) * n], len(seq), axis=0)
                for o in range(w):
                    own[: len(seq) - o] += (vec @ filters[j][o])[where[o:]]
                conv[:, j * n : (j + 1) * n] = own
            start = 0
            for i in pick:
                size = len(docs[i])
                own = conv[start : start + size]
                k = min(s.top, size)
                logit = float(offset[0])
                if k:
                    top = np.argpartition(-own, k - 1, axis=0)[:k] if size > k else np.arange(size)[:, None].repeat(count, 1)
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(own, top, 0), axis=0), 0)
                    value = np.maximum(0, np.take_along_axis(own, top, 0))
                    logit += float((value * weights[:, :k].T).sum())
                g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[i]) * weigh[i] / len(pick)
                grads[-1][0] += g
                if k:
                    grads[-2][:, :k] += (g * value).T
                    rank, col = np.nonzero(value > 0)
                    amount = (g * weights[col, rank]).astype(np.float32)
                    grads[-3][:] += np.bincount(col, amount, count)
                    place = start + top[rank, col]
                    for j, w in enumerate(s.widths):
                        mine = (col >= j * n) & (col < (j + 1) * n)
                        c, a, p = col[mine] - j * n, amount[mine], place[mine]
                        for o in range(w):
                            word = where[p + o]
                            np.add.at(grads[1 + j][o].T, c, a[:, None] * vec[word])
                            np.add.at(d_vec, word, a[:, None] * filters[j][o].T[c])
                start += size + pad
            touched = real & d_vec.any(axis=1)
            np.add.at(grads[0], feats[used[touched]].ravel(), np.repeat(d_vec[touched], 4, axis=0))
            adam.step(grads)
    return Model(s, embed, filters, bias, weights, float(offset[0]))


def _threshold(bins: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float:
    """The middle of the gap with the best F1, from the toxic rows and all rows of each bin; with both classes present."""
    order = np.argsort(-bins, kind="stable")
    z, hit, total = bins[order], np.cumsum(hits[order]), np.cumsum(rows[order])
    best = int(np.argmax(2 * hit / (total + hits.sum())))
    above = z[best + 1] + 1 if best + 1 < len(z) else z[best] - BINS
    return float((z[best] + above) / 2 / BINS)


def calibrate(model: Model, counts: pd.DataFrame, least: int = 8) -> None:
    """Thresholds from ``counts(lang, bin, y, n)`` of rows that were not trained on: one for each guessed language
    with at least ``least`` rows of either class, and one over all rows for the rest."""

    def cut(own: pd.DataFrame, least: int) -> float | None:
        by = own.assign(hits=own.n * own.y).groupby("bin")[["hits", "n"]].sum()
        if min(by.hits.sum(), by.n.sum() - by.hits.sum()) < least:
            return None
        return _threshold(by.index.to_numpy(np.int64), by.hits.to_numpy(np.int64), by.n.to_numpy(np.int64))

    model.threshold = cut(counts, 1) or model.threshold
    for lang, own in counts.groupby("lang"):
        if (found := cut(own, least)) is not None:
            model.thresholds[lang] = found


def _counts(rows: DataFrame, model: Model) -> pd.DataFrame:
    """``rows(text, y)`` by guessed language, label and bin of the logit: a table of bounded size."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, bin int")
    def placed(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.logit(t) for t in texts]
        bins = [int(np.floor(np.clip(z, -FAR, FAR) * BINS)) for z, _ in found]
        return pd.DataFrame({"lang": pd.Series([x for _, x in found], dtype=object), "bin": np.array(bins, np.int32)})

    found = rows.select("y", placed("text").alias("p")).groupBy("p.lang", "p.bin", "y").agg(F.count("*").alias("n"))
    return pd.DataFrame([tuple(r) for r in found.collect()], columns=["lang", "bin", "y", "n"])


def _languages(model: Model, texts: list[str], langs: list[str | None]) -> None:
    names = sorted({x for x in langs if x})
    counts = np.full((model.shape.buckets, max(1, len(names))), 0.1)
    for t, x in zip(texts, langs, strict=True):
        if x:
            np.add.at(counts[:, names.index(x)], [features(w, model.shape.buckets)[0] for w in words(t)], 1)
    model.langs = names
    model.lang_rows = np.log(counts / counts.sum(axis=0)).astype(np.float32)[:, : len(names)]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    most_rows: int = 2000,
    most_chars: int = 8_000_000,
    shape: Shape = Shape(),
) -> Model:
    """Trains on three quarters of a bounded sample of the labelled rows and calibrates on all others.

    Rows whose crc32 of the id as text modulo ``folds`` is ``held_out`` are not read. Of each class at most
    ``most_rows`` ids are drawn, in the order of a hash, and of those as many as stay within ``most_chars`` characters
    of text; both bounds keep the driver's memory fixed. Every labelled row that was not trained on is scored on the
    executors, so the thresholds see the classes in their real shares at any size of the input; only counts by language,
    label and bin of the logit come to the driver. An id that is labelled more than once counts by its largest
    label; null ids and labels are left out. Without rows of either class the model scores by its start values.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (crc32_mod(id_col, folds) != held_out))
    own = own.groupBy(F.col(id_col).alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    own = own.withColumn("draw", F.xxhash64("key"))
    ids = [r for y in (0, 1) for r in own.filter(F.col("y") == y).orderBy("draw", "key").limit(most_rows).collect()]
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def among(rows: list) -> DataFrame:
        return texts.join(F.broadcast(spark.createDataFrame(rows, own.schema)), "key")

    sizes: dict = {}
    if ids:
        for r in among(ids).select("key", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect():
            sizes[r["key"]] = sizes.get(r["key"], 0) + r["n"]
    chosen, room = [], {0: most_chars, 1: most_chars}
    for r in ids:
        if r["key"] in sizes and sizes[r["key"]] <= room[r["y"]]:
            room[r["y"]] -= sizes[r["key"]]
            chosen.append(r)
    rows = among(chosen).collect() if chosen else []
    rows.sort(key=lambda r: (r["draw"], r["key"], r["text"] or ""))
    y = np.array([r["y"] for r in rows], np.int64)
    kept = np.array([(r["draw"] >> 7) % 4 == 0 for r in rows], bool)
    own_texts = [r["text"] or "" for r in rows]
    model = train([t for t, k in zip(own_texts, kept, strict=True) if not k], y[~kept], shape)
    _languages(model, own_texts, [r["lang"] for r in rows])
    learnable = texts.filter(crc32_mod("key", folds) != held_out)
    trained = sorted({r["key"] for r, k in zip(rows, kept, strict=True) if not k})
    if trained:
        drawn = spark.createDataFrame([(k,) for k in trained], own.select("key").schema)
        own = own.join(F.broadcast(drawn), "key", "left_anti")
    few = own.count() <= SENT  # else texts are shuffled to their labels
    calibrate(model, _counts(learnable.join(F.broadcast(own) if few else own, "key").select("text", "y"), model))
    return model


def scored(spark: SparkSession, model: Model, text: str) -> Column:
    """The score of every whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def found(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t) for t in texts], dtype="float64")

    return found(F.col(text))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the score of every whole text (a column of that name is replaced).

    Null and empty texts score like texts without words. Repeated rows and other columns stay, no rows give no rows.
    The filters slide over blocks of a long text, so its words are all that is held beside it.
    """
    return docs.withColumn(out, scored(docs.sparkSession, model, text))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents that score below the threshold stay, with their columns, whatever their names; null, empty and
    repeated ones are scored like any other. No rows give no rows."""
    return docs.filter(scored(docs.sparkSession, model, text) < CUT)
