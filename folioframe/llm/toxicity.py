"""Toxicity scores by a convolutional text classifier, trained here in numpy.

Words, cut to their first letters so that forms of one word are one, are hashed into a fixed number of
buckets, each with an embedding; filters of
several widths run over the text, each filter's maximum is a feature, and a linear layer
gives the score.  An embedding's first place starts as the evidence that the training
rows hold for the bucket (the signed root of the log-likelihood ratio), the rest at random.

A filter over words i to i + w is a sum of one table look-up for each of its places, the
tables being embeddings times weights.  So scoring costs a few look-ups per word, and what
is sent to the tasks has a fixed size whatever the corpus.

The classifier is fitted on a bounded sample of the labelled rows (``most_positive``,
``most_negative``, in order of a hash of the id).  Its score is calibrated on rows that a
model of the other half scored, such that the best cut over all languages lies at 0.7; cuts
for each language are kept beside it and never enter a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import append_columns, text_or_empty

BUCKETS = 1 << 15
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
CUT = 0.7
#: Letters of a word that count.
STEM = 5
#: A bucket that fewer training rows hold keeps a zero embedding.
LEAST_ROWS = 3
WORDS = re.compile(r"[^\W\d_]+")
#: Words looked up at once.
STRETCH = 1 << 16


class Buckets(dict):
    """Word to bucket, remembered up to a fixed number; bucket 0 is left for padding."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
        return found


def word_ids(text: str, buckets: Buckets) -> np.ndarray:
    """Buckets of the words' stems in lower case, padded to the widest filter."""
    ids = [buckets[w[:STEM]] for w in WORDS.findall(text.lower())]
    ids += [0] * (max(WIDTHS) - len(ids))
    return np.array(ids, np.int32)


@dataclass
class Model:
    """``tables[w]``: for each place of a filter of width w, buckets by filters."""

    embeddings: np.ndarray
    weights: dict[int, np.ndarray]  # width -> (width, dimensions, filters)
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)
    constant: bool = False

    def tables(self) -> dict[int, np.ndarray]:
        return {w: np.ascontiguousarray(np.einsum("bd,jdf->jbf", self.embeddings, k, optimize=True), np.float32) for w, k in self.weights.items()}

    def score_of(self, logit: float) -> float:
        return 0.0 if self.constant else float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40))))


def pooled(ids: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
    """Maxima of all filters over a text."""
    out = []
    for w, table in tables.items():
        best = None
        for at in range(0, len(ids) - w + 1, STRETCH):
            part = ids[at : at + STRETCH + w - 1]
            n = len(part) - w + 1
            sums = table[0][part[:n]]
            for j in range(1, w):
                sums += table[j][part[j : j + n]]
            top = sums.max(0)
            best = top if best is None else np.maximum(best, top)
        out.append(best)
    return np.concatenate(out)


def logit(model: Model, tables: dict[int, np.ndarray], ids: np.ndarray) -> float:
    features = np.maximum(pooled(ids, tables) + np.concatenate([model.biases[w] for w in WIDTHS]), 0)
    return float(features @ model.dense + model.offset)


def evidence(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the signed root of the log-likelihood ratio, and how many rows hold it."""
    held = np.zeros((2, BUCKETS))
    for ids, y in zip(rows, labels, strict=True):
        held[int(y), np.unique(ids)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)[:, None]
    seen = held.sum(0)
    rate = seen / n.sum()

    def part(observed, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(observed > 0, observed * np.log(observed / np.maximum(expected, 1e-12)), 0)

    ratio = 2 * (part(held, n * rate) + part(n - held, n * (1 - rate))).sum(0)
    sign = np.sign(held[1] / n[1] - held[0] / n[0])
    return sign * np.sqrt(np.maximum(ratio, 0)), seen


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int, batch: int, seed: int) -> Model:
    """Adam on the logistic loss; gradients reach the words that a filter's maximum came from."""
    random = np.random.default_rng(seed)
    strength, seen = evidence(rows, labels)
    live = (seen >= LEAST_ROWS).astype(np.float64)
    live[0] = 0
    total = len(WIDTHS) * FILTERS
    theta = {"E": random.normal(0, 0.1, (BUCKETS, DIMENSIONS)) * live[:, None], "dense": random.normal(0, 0.1, total), "offset": np.array([np.log(max(labels.mean(), 1e-3))])}
    theta["E"][:, 0] = strength * live / 5
    for w in WIDTHS:
        theta[f"W{w}"] = random.normal(0, 0.1, (w, DIMENSIONS, FILTERS))
        theta[f"W{w}"][:, 0, : FILTERS // 2] += 1.0 / w
        theta[f"b{w}"] = np.full(FILTERS, -0.3)
    theta["dense"][:: FILTERS // 4] += 0.5
    first = {k: np.zeros_like(v) for k, v in theta.items()}
    second = {k: np.zeros_like(v) for k, v in theta.items()}
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            grads = gradients(theta, [rows[i] for i in chosen], labels[chosen])
            grads["E"] *= live[:, None]
            grads["dense"] += 1e-3 * theta["dense"]
            step += 1
            for k, g in grads.items():
                rows_in = np.flatnonzero(np.abs(g).sum(1)) if k == "E" else slice(None)
                m, v = first[k], second[k]
                m[rows_in] = 0.9 * m[rows_in] + 0.1 * g[rows_in]
                v[rows_in] = 0.99 * v[rows_in] + 0.01 * g[rows_in] ** 2
                theta[k][rows_in] -= 0.01 * (m[rows_in] / (1 - 0.9**step)) / (np.sqrt(v[rows_in] / (1 - 0.99**step)) + 1e-8)
    return Model(
        theta["E"], {w: theta[f"W{w}"] for w in WIDTHS}, {w: theta[f"b{w}"] for w in WIDTHS}, theta["dense"], float(theta["offset"][0])
    )


def gradients(theta: dict[str, np.ndarray], rows: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Mean gradients over a batch."""
    used, local = np.unique(np.concatenate(rows), return_inverse=True)
    own = theta["E"][used]
    tables = {w: np.einsum("bd,jdf->jbf", own, theta[f"W{w}"], optimize=True).astype(np.float32) for w in WIDTHS}
    pools, tops, at = [], [], 0
    for ids in rows:
        here = local[at : at + len(ids)]
        at += len(ids)
        top = {}
        values = []
        for w in WIDTHS:
            n = len(here) - w + 1
            sums = tables[w][0][here[:n]].copy()
            for j in range(1, w):
                sums += tables[w][j][here[j : j + n]]
            place = sums.argmax(0)
            top[w] = np.stack([here[place + j] for j in range(w)])
            values.append(sums[place, np.arange(FILTERS)])
        pools.append(np.concatenate(values))
        tops.append(top)
    bias = np.concatenate([theta[f"b{w}"] for w in WIDTHS])
    raw = np.array(pools, np.float64) + bias
    features = np.maximum(raw, 0)
    error = (1 / (1 + np.exp(-np.clip(features @ theta["dense"] + theta["offset"][0], -40, 40))) - labels) / len(rows)
    out = {k: np.zeros_like(v) for k, v in theta.items() if k != "E"}
    out["dense"], out["offset"][0] = features.T @ error, error.sum()
    back = error[:, None] * theta["dense"][None, :] * (raw > 0)
    grad = np.zeros_like(own)
    for k, w in enumerate(WIDTHS):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        out[f"b{w}"] = part.sum(0)
        for j in range(w):
            which = np.stack([t[w][j] for t in tops])  # rows by filters: the word at place j of the maximum
            out[f"W{w}"][j] = np.einsum("rfd,rf->df", own[which], part)
            np.add.at(grad, which.ravel(), (part[:, :, None] * theta[f"W{w}"][j].T[None, :, :]).reshape(-1, DIMENSIONS))
    out["E"] = np.zeros_like(theta["E"])
    out["E"][used] = grad
    return out


def best_cut(values: np.ndarray, labels: np.ndarray, negatives: float) -> float:
    """The cut with the largest F1, in the middle of the gap it lies in; each negative counts ``negatives`` times."""
    order = np.argsort(-values)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (hits + negatives * np.cumsum(1 - labels[order]) + labels.sum())
    k = int(np.argmax(f1))
    low = values[order[k + 1]] if k + 1 < len(order) else values[order[k]] - 1
    return float((values[order[k]] + low) / 2)


def train(
    texts: list[str], labels: list[int], langs: list[str], negatives: float = 1.0, epochs: int = 5, batch: int = 32, seed: int = 7
) -> Model:
    """A calibrated model; one that scores 0 throughout if a class is missing.

    ``negatives``: how many negatives of the labelled rows one in the sample stands for, for one
    such positive; the cuts are set for the labelled rows' mix of classes, not the sample's.
    """
    y = np.array(labels, float)
    buckets = Buckets()
    rows = [word_ids(t or "", buckets) for t in texts]
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((BUCKETS, DIMENSIONS)), {w: np.zeros((w, DIMENSIONS, FILTERS)) for w in WIDTHS}, {w: np.zeros(FILTERS) for w in WIDTHS}, np.zeros(len(WIDTHS) * FILTERS), 0.0, constant=True)
    model = fit(rows, y, epochs, batch, seed)
    side = np.arange(len(y)) % 2
    apart = np.zeros(len(y))
    for half in (0, 1):
        there = np.flatnonzero(side != half)
        if y[there].min() == y[there].max():
            other = model
        else:
            other = fit([rows[i] for i in there], y[there], epochs, batch, seed)
        tables = other.tables()
        for i in np.flatnonzero(side == half):
            apart[i] = logit(other, tables, rows[i])
    cut = best_cut(apart, y, negatives)
    model.scale = 1.0 / max(0.25, float(apart.std()) / 2)
    model.shift = float(np.log(CUT / (1 - CUT))) - model.scale * cut
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if y[own].sum() >= 30:
            model.cuts[lang] = float(np.clip(model.score_of(best_cut(apart[own], y[own], negatives)), 0.5, 0.9))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null id counts as the empty text and isn't one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             label_col: str = "toxic", most_positive: int = 1500, most_negative: int = 3000) -> Model:
    """Fits on at most ``most_positive`` and ``most_negative`` labelled rows that aren't held out.

    They are the first in order of a hash of the id, so the same rows are chosen each time.
    Labels that are neither 0 nor 1 and null ids are left out.  Of rows that repeat an id the one with the least
    text counts, so what comes to the driver is one text for each chosen label.
    """
    able = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    order = [F.xxhash64("id"), F.col("id"), F.col("y")]
    chosen = able.where("y = 1").orderBy(*order).limit(most_positive).unionByName(able.where("y = 0").orderBy(*order).limit(most_negative))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(chosen), "id")
    found = found.groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("r")).select("id", "y", "r.text", "r.lang")
    rows = sorted(found.collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["y"], r["text"] or ""))
    counts = dict(able.where("y IN (0, 1)").groupBy("y").count().collect())
    negatives = max(1, counts.get(0, 0) / most_negative) / max(1, counts.get(1, 0) / most_positive)
    return train([r["text"] for r in rows], [r["y"] for r in rows], [r["lang"] for r in rows], negatives)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Rows of ``docs`` with the score of the whole text, from 0 to 1.  Null and texts without words get the score of padding."""
    spark = docs.sparkSession
    slim = Model(np.zeros((0, 0)), {}, model.biases, model.dense, model.offset, model.scale, model.shift, {}, model.constant)
    sent = spark.sparkContext.broadcast((slim, model.tables()))

    def maker():
        own, tables = sent.value
        buckets = Buckets()
        return lambda texts: [[own.score_of(logit(own, tables, word_ids(t, buckets))) for t in texts]]

    return append_columns(docs, text_or_empty(text_col), StructType([StructField(name, DoubleType())]), maker)


def rejected(model: Model, lang: Column, value: Column) -> Column:
    """Whether a score reaches the cut of its language; other and null languages have the common cut."""
    cut = F.lit(CUT)
    for name, own in model.cuts.items():
        cut = F.when(lang.eqNullSafe(F.lit(name)), F.lit(own)).otherwise(cut)
    return value >= cut
