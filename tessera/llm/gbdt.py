"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in one pass over all texts.  The trees are fitted on a bounded,
hash-ordered sample of labelled rows (``MAX_ROWS``): features are cut into quantile bins,
each split is the best of the gradient histograms of its node's bins.  The trees are
complete, so a tree is three arrays (feature, threshold, leaf value) and a whole Arrow
batch walks down all of them at once by index arithmetic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, map_texts, materialize

#: Most labelled rows that a fit takes (by hash of the id); the only bound of this operator.
MAX_ROWS = 40_000
TREES, DEPTH, BINS, RATE, SMOOTH = 40, 3, 64, 0.2, 1.0

_CONTINUATION = bytes(range(0x80, 0xC0))
_ASCII = {"upper": bytes(range(0x41, 0x5B)), "lower": bytes(range(0x61, 0x7B)), "digit": b"0123456789",
          "stop": b".!?", "pause": b",;:", "symbol": b"#*$%&|<>", "quote": b"\"'()[]{}",
          "mark": b"!", "slash": b"/\\@=_~^+"}
FEATURES = ["log_words", "word_chars", "word_spread", "distinct", "top_word", "once", "log_lines",
            "line_words", "dup_lines", "white", "other", *_ASCII]


def features(data: bytes) -> tuple[float, ...]:
    """The statistics named by FEATURES, of a whole UTF-8 text; all 0 for one without words."""
    words = data.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = len(data.translate(None, _CONTINUATION))
    lens = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [(len(data) - len(data.translate(None, drop))) / chars for drop in _ASCII.values()]
    white = (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))) / chars
    return (math.log1p(n), float(lens.mean()), float(lens.std()), len(seen) / n,
            max(seen.values()) / n, sum(1 for c in seen.values() if c == 1) / n,
            math.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), white,
            1 - white - sum(shares[:6]), *shares)


class Forest(NamedTuple):
    """``feature``, ``threshold``: (trees, 2**DEPTH - 1); ``leaf``: (trees, 2**DEPTH)."""
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Logistic boosting; without rows of both labels a constant smoothed share."""
    n, width = x.shape
    start = math.log((y.sum() + 1) / (n - y.sum() + 1))
    nodes = 2 ** depth - 1
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), start)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    margin = np.full(n, start)
    feature, threshold = np.zeros((trees, nodes), int), np.full((trees, nodes), np.inf)
    leaf = np.zeros((trees, nodes + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, int)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            best = np.zeros(count)
            for f in range(width):
                bins = len(cuts[f]) + 1
                cell = (at - first) * bins + binned[f]
                g, h = (np.bincount(cell, w, count * bins).reshape(count, bins) for w in (grad, hess))
                lg, lh = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
                if not lg.shape[1]:
                    continue
                ag, ah = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
                gain = lg ** 2 / (lh + SMOOTH) + (ag - lg) ** 2 / (ah - lh + SMOOTH) \
                    - ag ** 2 / (ah + SMOOTH)
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                for k in np.nonzero(value > best + 1e-12)[0]:
                    best[k] = value[k]
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][top[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        g = np.bincount(at - nodes, grad, nodes + 1)
        leaf[t] = RATE * g / (np.bincount(at - nodes, hess, nodes + 1) + SMOOTH)
        margin += leaf[t][at - nodes]
    return Forest(feature, threshold, leaf, start)


def predict(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for every row: all rows step down a tree level by level."""
    nodes = forest.feature.shape[1]
    margin = np.full(len(x), forest.start)
    rows = np.arange(len(x))
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        at = np.zeros(len(x), int)
        while len(at) and at[0] < nodes:
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        margin += leaf[at - nodes]
    return 1 / (1 + np.exp(-margin))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", folds: int = 5, cutoff: float = 0.3) -> DataFrame:
    """Per row: id, held_out, score, predicted.

    Labels are learnt only from ids whose crc32 modulo ``folds`` is not 0.  Null and empty
    texts are scored by their (zero) statistics; a null id is held like the text ''; null
    labels are left out, an id with both labels counts as 0; repeated rows each return;
    without labels every score is 0.5; an empty table returns no rows.  Other columns are
    ignored."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    measured = materialize(spark, map_texts(
        src, ["_id"], "_t", features, ", ".join(f"{c} double" for c in FEATURES),
        [pa.float64()] * len(FEATURES)), "features")
    truth = labels.filter("quality is not null").groupBy(F.col(id_col).alias("_label_id")).agg(
        F.min("quality").alias("_y")).filter(crc32_mod(F.col("_label_id"), folds) != 0)
    sample = measured.join(truth, F.col("_id") == F.col("_label_id")).orderBy(
        F.xxhash64("_id"), *FEATURES).limit(MAX_ROWS).select("_y", *FEATURES).toPandas()
    forest = fit(sample[FEATURES].to_numpy(float), sample["_y"].to_numpy(float))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(1 + i).to_numpy() for i in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predict(forest, x))],
                                             names=["_id", "score"])

    kind = measured.schema["_id"].dataType.simpleString()
    return measured.mapInArrow(score, f"_id {kind}, score double").select(
        F.col("_id").alias(id_col), (crc32_mod(F.col("_id"), folds) == 0).alias("held_out"), "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"))
