import math
import random
import re
import zlib

import numpy as np
from llm_fixtures import SF01, frame  # noqa: F401

from tessera.llm import gbdt as G


def walk(forest, row):
    """One row down one tree at a time."""
    margin = forest.start
    nodes = forest.feature.shape[1]
    for t in range(len(forest.feature)):
        at = 0
        while at < nodes:
            at = 2 * at + (2 if row[forest.feature[t][at]] > forest.threshold[t][at] else 1)
        margin += forest.leaf[t][at - nodes]
    return 1 / (1 + math.exp(-margin))


def test_flat_arrays_match_a_tree_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] * x[:, 1] > 0)).astype(float)
    forest = G.fit(x, y)
    p = G.predict(forest, x)
    assert np.allclose(p, [walk(forest, r) for r in x])
    assert ((p > 0.5) == y).mean() > 0.85
    assert G.predict(forest, x[:0]).shape == (0,)


def test_split_is_the_best_of_all():
    """A single stump equals the exhaustive search over all cuts."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 1] > 4).astype(float)
    f = G.fit(x, y, trees=1, depth=1)
    assert (f.feature[0, 0], f.threshold[0, 0]) == (1, 4.0)


def test_split_equals_exhaustive_search():
    """The first stump against every feature and cut, on noisy labels."""
    for seed in range(5):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 12, (150, 4)).astype(float)
        y = (rng.random(150) < 0.2 + 0.6 * (x[:, seed % 4] > 5)).astype(float)
        f = G.fit(x, y, trees=1, depth=1)
        p = 1 / (1 + math.exp(-f.start))
        g, h = y - p, p * (1 - p)
        side = lambda m: g[m].sum() ** 2 / (h * m.sum() + G.SMOOTH)
        gain = {(j, c): side(x[:, j] <= c) + side(x[:, j] > c) for j in range(4) for c in range(11)}
        assert gain[int(f.feature[0, 0]), float(f.threshold[0, 0])] >= max(gain.values()) - 1e-9


def plain_features(text):
    """Every statistic by its name, character by character."""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    if not words:
        return [0.0] * len(G.FEATURES)
    sizes = [len(w.encode()) for w in words]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    mean = sum(sizes) / len(sizes)
    count = lambda chars: sum(c in chars for c in text) / len(text)
    shares = {"upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": count("abcdefghijklmnopqrstuvwxyz"),
              "digit": count("0123456789"), "stop": count(".!?"), "pause": count(",;:"), "symbol": count("#*$%&|<>"),
              "quote": count("\"'()[]{}"), "mark": count("!"), "slash": count("/\\@=_~^+")}
    white = count(" \t\n\x0b\x0c\r")
    first = ("upper", "lower", "digit", "stop", "pause", "symbol")
    named = {"log_words": math.log1p(len(words)), "word_chars": mean,
             "word_spread": math.sqrt(sum((n - mean) ** 2 for n in sizes) / len(sizes)),
             "distinct": len(set(words)) / len(words), "top_word": max(words.count(w) for w in words) / len(words),
             "once": sum(words.count(w) == 1 for w in set(words)) / len(words), "log_lines": math.log1p(len(lines)),
             "line_words": len(words) / len(lines), "dup_lines": 1 - len(set(lines)) / len(lines), "white": white,
             "other": 1 - white - sum(shares[c] for c in first), **shares}
    return [named[f] for f in G.FEATURES]


def test_features_match_a_plain_form():
    own = random.Random(5)
    bits = ["word", "Word", "\u00e9t\u00e9", "12", ".", "!", ", ", "#", "(", "\"", "/", "\n", " ", "\t", "\x0b", "\U0001f600",
            "\x1c", "line one\n", "line one\n"]
    texts = ["".join(own.choice(bits) for _ in range(own.randrange(0, 60))) for _ in range(400)]
    for t in [*texts, "", " \n", "a", "a\n a\n a", "x" * 5000]:
        assert np.allclose(G.features(t.encode()), plain_features(t), atol=1e-12), t


def test_constant_labels_and_no_rows():
    assert G.predict(G.fit(np.zeros((0, 2)), np.zeros(0)), np.ones((3, 2))).tolist() == [0.5] * 3
    assert (G.predict(G.fit(np.ones((8, 2)), np.ones(8)), np.ones((2, 2))) > 0.85).all()
    assert set(G.features(b" \n")) == {0.0}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = G.quality_scores(spark, docs, labels).join(labels, "doc_id").filter("held_out").collect()
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
    pairs = [(r.score, r.quality) for r in rows]
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([(s >= 0.3) == q for s, q in pairs]) > 0.95


def test_labels_of_the_held_fold_are_not_read(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in G.quality_scores(spark, docs, labels).collect()}
    b = {r.doc_id: r.score for r in G.quality_scores(spark, docs, flipped).collect()}
    assert a == b


def test_edge_rows(frame, spark):
    docs = frame([(1, None, 1), (2, "", 2), (2, "twice", 2), (None, "no id", 3), (3, "w " * 300000, 4)],
                 "doc_id long, text string, upper int")
    labels = frame([(1, 1), (1, 0), (2, None), (77, 1)], "doc_id long, quality int")
    rows = G.quality_scores(spark, docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert G.quality_scores(spark, docs.filter("false"), labels).count() == 0
