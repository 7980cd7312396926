"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams that occur in it.  Each counts by the log ratio of its smoothed document
frequencies among toxic and other texts; a logistic regression over the scaled features gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices, utf8

BITS, SIZES = 20, (3, 4, 5, 6, 7)
SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


def hashed(raw: np.ndarray):
    """For each size, the bucket of the n-gram that starts at every byte (A-Z in lower case)."""
    low = x = LOWER[raw]
    for n in range(2, max(SIZES) + 1):
        x = x[:-1] * np.uint64(0x100000001B3) + low[n - 1 :] if len(x) > 1 else x[:0]
        if n in SIZES:
            y = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            yield n, (y >> np.uint64(64 - BITS)).astype(np.int32)


def present(raw: np.ndarray, at: np.ndarray):
    """For each text, the sorted buckets of the n-grams that occur in it."""
    seen = np.zeros(1 << BITS, bool)
    for a, b in slices(at, SLICE):
        hashes = list(hashed(raw[at[a] : at[b]]))
        for r in range(a, b):
            i, j = int(at[r] - at[a]), int(at[r + 1] - at[a])
            for n, h in hashes:
                seen[h[i : max(i, j - n + 1)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


class Model:
    """``weights``: naive Bayes ratio times regression weight of every bucket; most are zero."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = np.full(len(at) - 1, self.bias)
        for a, b in slices(at, SLICE):
            edge, keys = at[a : b + 1] - at[a], [np.zeros(0, np.int64)]
            for n, h in hashed(raw[at[a] : at[b]]):
                place = np.flatnonzero(self.weights[h])
                row = np.searchsorted(edge, place, side="right") - 1
                inside = place + n <= edge[row + 1]
                keys.append(row[inside] << BITS | h[place[inside]])
            key = np.unique(np.concatenate(keys))
            z[a:b] += np.bincount(key >> BITS, weights=self.weights[key & ((1 << BITS) - 1)], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def constant(label: np.ndarray) -> Model:
    """With rows of one class only, every score is that class's smoothed share; with none, one half."""
    p = (label.sum() + 1) / (len(label) + 2)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))


def fit(features: list[np.ndarray], label: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, ridge: float = 3.0, rounds: int = 200) -> Model:
    """Logistic regression by Adam steps over all rows; ``features`` are places in ``chosen``, the buckets that take
    part, and each counts by its log-count ratio."""
    label = np.asarray(label, np.float64)
    if not len(label) or label.min() == label.max():
        return constant(label)
    flat, row = np.concatenate(features).astype(np.int64), np.repeat(np.arange(len(features)), [len(c) for c in features])
    scaled = ratio[flat]
    weight, bias = np.zeros(len(chosen)), float(np.log(label.mean() / (1 - label.mean())))
    m = v = np.zeros(len(chosen))
    mb = vb = 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=scaled * weight[flat], minlength=len(label)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / len(label)
        g = np.bincount(flat, weights=scaled * error[row], minlength=len(chosen)) + ridge * weight / len(label)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        weight -= 0.02 * scale * m / (np.sqrt(v) + 1e-10)
        bias -= 0.05 * scale * mb / (np.sqrt(vb) + 1e-10)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = weight * ratio
    return Model(weights, float(bias))


def counted(sample: DataFrame) -> DataFrame:
    """bucket, pos, neg: in how many of the sample's texts (text, label) of either class each bucket's n-grams occur."""

    def run(batches):
        for batch in batches:
            held = np.zeros((2, 1 << BITS), np.int32)
            for x, y in zip(present(*utf8(batch.column(0))), batch.column(1).to_pylist(), strict=True):
                held[y, x] += 1
            bucket = np.flatnonzero(held.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(held[1, bucket]), pa.array(held[0, bucket])], ["bucket", "pos", "neg"])

    each = map_arrow(sample.select("text", "label"), run, "bucket int, pos int, neg int")
    return each.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train(
    docs: DataFrame, labels: DataFrame, limit: int = 2000, keep: int = 2048, least: int = 4, alpha: float = 0.5, miss: float = 4.0,
    doc: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Fit on a sample of at most about ``limit`` labelled rows of each class, by a hash of the id; rows without a
    label are not used.

    Class frequencies are counted in Spark.  Only the ``keep`` buckets take part that tell the classes apart best (by
    chi-squared) among those in ``least`` texts or more: long texts hold so many others that their noise would drown
    these.  Just these buckets, and which of them each sampled text holds, come to the driver.  Scores follow the
    labels' own shares of the classes, with a toxic text that is missed weighing as much as ``miss`` clean ones flagged.
    """
    rows = labels.where(F.col(label).isNotNull()).select(F.col(doc).alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    sizes = dict(rows.groupBy("label").count().collect())
    share = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, limit / max(1, sizes.get(k, 0))))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("label")] * (1 << 20))
    # ``limit`` bounds what is broadcast, and no text moves but those drawn.
    found = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")
    sample = materialise(found.select("text", "label"), "op2-sample")
    drawn_sizes = dict(sample.groupBy("label").count().collect())
    n1, n0 = drawn_sizes.get(1, 0), drawn_sizes.get(0, 0)
    if not n1 or not n0:
        return constant(np.repeat([0.0, 1.0], [n0, n1]))
    df = F.col("pos") + F.col("neg")
    chi = (F.col("pos") * F.lit(float(n0)) - F.col("neg") * F.lit(float(n1))) ** 2 / F.greatest(df * (F.lit(n1 + n0) - df), F.lit(1))
    best = counted(sample).where(df >= least).withColumn("chi", chi).where("chi > 0").orderBy(F.desc("chi"), "bucket").limit(keep).toPandas().sort_values("bucket")
    chosen, pos, neg = (best[c].to_numpy() for c in ("bucket", "pos", "neg"))
    ratio = np.log((pos + alpha) / (n1 + 2 * alpha)) - np.log((neg + alpha) / (n0 + 2 * alpha))

    def run(batches):
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            held = (place[x] for x in present(*utf8(batch.column(0))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[x >= 0].tobytes() for x in held], pa.binary())], ["label", "features"])

    got = map_arrow(sample.select("text", "label"), run, "label int, features binary").toPandas().sort_values(["label", "features"])
    model = fit([np.frombuffer(x, np.int32) for x in got.features], got.label.to_numpy(np.float64), chosen, ratio)
    prior = sizes.get(1, 0) / sum(sizes.values())
    # From the sample's shares back to the labels' own, and on to the costs.
    model.bias += float(np.log(prior / (1 - prior)) - np.log(n1 / n0) + np.log(miss))
    return model


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5) for every row; null texts are empty, and an empty text scores by
    the bias alone.  Texts of any length are scored whole, some million bytes of a batch at a time.  Repeated rows and
    null ids stay; other columns are not read; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = sent.value.score(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, score double, predicted int")
