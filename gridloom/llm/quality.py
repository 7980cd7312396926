"""Quality by histogram gradient-boosted trees over document statistics.

A text becomes a row of statistics.  Training bins each statistic at quantiles, so a split is found from histograms of
gradients.  The trees are kept as flat arrays, and a batch of texts walks them level by level in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, utf8

#: Byte classes: letters of either case, digits, blanks, line ends, sentence ends, other marks, bytes beyond ASCII.
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "mark", "high")
CLASS = np.full(256, 7, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 8
CLASS[[32, 9]], CLASS[[10, 13]] = 3, 4
CLASS[[33, 46, 63]], CLASS[[44, 58, 59]] = 5, 6
STATISTICS = (
    "bytes", *CLASSES, "words", "word_length", "distinct_words", "top_word", "repeated_pairs", "lines", "line_length",
    "distinct_lines", "bullets", "long_words", "letterless_words", "class_changes",
)


def word_statistics(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    m = max(1, n)
    k = max(1, len(lines))
    return [
        n, sum(map(len, counts)) / max(1, len(counts)), len(counts) / m, max(counts.values(), default=0) / m,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0, len(lines), len(text) / k, len(set(lines)) / k,
        sum(x[0] in "-*•#|>" for x in lines) / k, sum(c for w, c in counts.items() if len(w) > 20) / m,
        sum(c for w, c in counts.items() if not any(map(str.isalpha, w))) / m,
    ]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS per text; null counts as empty."""
    raw, at = utf8(column)
    n = len(at) - 1
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = np.diff(at)
    size = np.maximum(1, out[:, 0])
    k = len(CLASSES)
    for a, b in slices(at, 1 << 20):
        kinds = CLASS[raw[at[a] : at[b]]]
        row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        out[a:b, 1 : k + 1] = np.bincount(row * k + kinds, minlength=(b - a) * k).reshape(b - a, k)
        change = np.append(False, kinds[1:] != kinds[:-1])
        out[a:b, -1] = np.bincount(row, weights=change, minlength=b - a)
    out[:, 1 : k + 1] /= size[:, None]
    out[:, -1] /= size
    for r, text in enumerate(column.fill_null("").to_pylist()):
        out[r, k + 1 : -1] = word_statistics(text)
    return out


class Model:
    """Trees of one depth as arrays: of node k the children are 2 k + 1 and 2 k + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, bias: float):
        self.feature, self.threshold, self.value, self.bias = feature, threshold, value, bias

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += value[node - inner]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_score(x), -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Model:
    """Newton boosting of the logistic loss.  With rows of one class only, every score is that class's smoothed share;
    with none, one half.  Of equal gains the first statistic and bin win."""
    label = np.asarray(label, np.float64)
    p = (label.sum() + 1) / (len(label) + 2)
    bias = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    if not len(label) or label.min() == label.max():
        return Model(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(n, bias)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        grad, hess = q - label, np.maximum(q * (1 - q), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            nodes, base = 2**level, 2**level - 1
            at = node - base
            best = np.full(nodes, 1e-6)
            bin_of = np.full(nodes, bins)
            for f in range(width):
                cell = at * bins + binned[:, f]
                g, h, c = (np.bincount(cell, weights=w, minlength=nodes * bins).reshape(nodes, bins).cumsum(1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(c < least) | (ct - c < least)] = 0
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                win = top > best
                best = np.where(win, top, best)
                bin_of = np.where(win, k, bin_of)
                feature[base : base + nodes] = np.where(win, f, feature[base : base + nodes])
                threshold[base : base + nodes] = np.where(win, edges[f][np.minimum(k, max(0, len(edges[f]) - 1))] if len(edges[f]) else np.inf, threshold[base : base + nodes])
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (grad, hess))
        value = -rate * g / (h + ridge)
        z += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Model(np.array(features), np.array(thresholds), np.array(values), bias)


def train(docs: DataFrame, labels: DataFrame, limit: int = 20_000, doc: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on a sample of at most about ``limit`` labelled rows, by a hash of the id.  The statistics are found by the
    executors; only they come to the driver."""
    rows = labels.where(F.col(label).isNotNull()).select(F.col(doc).alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    share = min(1.0, limit / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # ``limit`` bounds what is broadcast, and no text moves but those drawn.
    sample = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    got = map_arrow(sample.select("text", "label"), run, "label int, x binary").toPandas()
    x = np.frombuffer(b"".join(got.x), np.float64).reshape(len(got), len(STATISTICS))
    order = np.lexsort((*x.T, got.label.to_numpy()))  # Spark returns rows in no fixed order
    return fit(x[order], got.label.to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5) for every row; null texts are empty, with statistics of zero.
    Texts of any length count whole.  Repeated rows and null ids stay; other columns are not read; an empty table
    gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = sent.value.score(statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, score double, predicted int")
