"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, fit_labels, held_out, label_sample, table
from .textstats import base_counts

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "stress_share", "stop_share", "wide_share", "distinct_share",
    "dup_line_share", "repeat_share", "log_line_words", "top_word_share", "long_word_share", "short_word_share", "space_share",
)
#: Most labelled rows of either class that the fit takes.
SAMPLE_PER_CLASS = 6000
_CLASS = np.zeros(256, np.uint8)
for _code, _chars in enumerate((bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>", b"!?", b".,;:", bytes(range(128, 256)), b" \t\n\x0b\x0c\r"), 1):
    _CLASS[list(_chars)] = _code


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES; zeros for a text without words."""
    words, hashes, chars, _, lines, repeats = base_counts(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper, digit, symbol, stress, stop, wide, space = (np.bincount(_CLASS[raw], minlength=8)[1:] / len(raw)).tolist()
    ranked = np.sort(hashes)
    bounds = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    n_lines = text.count("\n") + 1
    return [
        float(np.log1p(n)), chars / n, upper, digit, symbol, stress, stop, wide, (len(bounds) - 1) / n,
        lines / n_lines, repeats / n, float(np.log1p(n / n_lines)), float(np.diff(bounds).max()) / n, float((lengths > 14).mean()), float((lengths < 3).mean()), space,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: node k of a tree has the children 2k + 1 and 2k + 2; leaves hold values."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features, all rows and trees at a time, one step for each level."""
        trees = np.arange(self.feature.shape[0])
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(int(np.log2(self.value.shape[1]))):
            f, t = self.feature[trees, node], self.threshold[trees, node]
            node = 2 * node + 1 + (np.take_along_axis(x, f, 1) > t)
        margin = self.start + self.value[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0) -> Forest:
    """Boosted trees on logistic loss, each grown level by level from histograms of gradients over binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    n_features, inner, leaves = x.shape[1], 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    offsets = np.arange(n_features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (n_features * bins) + offsets + binned).ravel()
            g, h = (np.bincount(at, np.repeat(v, n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(2) for v in (gradient, hessian))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + smooth) + (all_g - g) ** 2 / (all_h - h + smooth) - all_g**2 / (all_h + smooth)
            gain[(h < 1) | (all_h - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (np.take_along_axis(x, feature[t, node][:, None], 1)[:, 0] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + smooth)
        margin += value[t, leaf]
    return Forest(feature, threshold, value, start)


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Forest:
    """A forest from at most per_class labelled documents of either class that are not held out.

    Statistics are computed on the executors; the driver gets numbers only, 2 * per_class rows at most. Both classes weigh what
    they weigh among the labels that are not held out; without such labels of both classes the scores are the share of label 1 (1
    without any). Null labels and null ids, and labels of unknown documents, are ignored; a repeated id counts with each of its rows.
    """
    sample, share = label_sample(fit_labels(labels, "quality"), per_class)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(statistics, batch.column(1).to_pylist())), pa.list_(pa.float64()))], names=["label", "x"])

    # the sample's size is bounded by per_class
    rows = texts.join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(measure, "label int, x array<double>").toPandas()
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Forest(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), 30.0 if share is None or share == 1 else -30.0 if share == 0 else float(np.log(share / (1 - share))))
    x = np.array(rows["x"].tolist(), float)
    order = np.lexsort([*x.T, y])  # rows come in no fixed order, sums of floats shall
    x, y = x[order], y[order]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return fit_forest(x, y, weight)


def score_quality(documents: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a map without a shuffle over whole texts.

    Null or empty text is scored by statistics of zero. Null ids keep their row, with held_out null; repeated rows keep a row each.
    An empty table gives no rows; other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                found = forest.score(np.array(list(map(statistics, batch.column(1).to_pylist())), float))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([held_out(x) for x in batch.column(0).to_pylist()], pa.bool_()), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, table(spark, sf_dir, "labels")))


def predicted_quality(forest: Forest, threshold: float = 0.3):
    """The prediction as a function of a text column, for filters."""

    @F.pandas_udf("int")
    def predicted(text: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype="int32")
        return pd.Series((forest.score(np.array(list(map(statistics, text)), float)) >= threshold).astype("int32"))

    return predicted
