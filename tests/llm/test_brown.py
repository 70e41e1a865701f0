import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import SF01, frame  # noqa: F401

from tessera.llm import brown as B


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*filter(None, re.split("[ \\t\\n\\x0b\\x0c\\r]+", low)), B.END]


def training(rows):
    return [tokens(t) for i, t in rows if not held(i)]


def history(seed, w):
    """The class that a word stands for as the word before."""
    return seed.class_of[seed.units.get(w, len(seed.units) + B.ending(w))]


def brute(spark, rows):
    """Counts and both scores token by token, with the classes the operator's clustering gives."""
    train = training(rows)
    model, words = B.fit(spark, spark.createDataFrame([(t or "",) for i, t in rows if not held(i)], "t string"))
    seed, cls = model.seed, {r["word"]: r["class"] for r in words.collect()}
    c = Counter(w for t in train for w in t)
    assert {r["word"]: r["n"] for r in words.collect()} == c
    n, v, k = sum(c.values()), len(c), seed.classes
    two, vocab = np.zeros((k, k)), Counter(cls.values())
    for t in train:
        for a, b in zip([B.END, *t], t):
            two[history(seed, a), cls[b]] += 1
    out = []
    for i, t in rows:
        seq = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq)
        score, prev = 0.0, B.END
        for w in seq:
            h, x = history(seed, prev), cls.get(w, history(seed, w))
            score += math.log10((two[h, x] + 0.5) / (two[h].sum() + 0.5 * k))
            score += math.log10((c[w] + 1) / (two[:, x].sum() + vocab[x] + 1))
            prev = w
        out.append((i, held(i), len(seq), sum(c[w] > 0 for w in seq), n, base, score))
    return out


def check(spark, frame, rows):
    df = frame([(i, t, "x") for i, t in rows], "doc_id long, text string, model string")
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
           for r in B.score_texts(spark, df).collect()]
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(brute(spark, rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_scores_match_token_by_token(spark, frame, monkeypatch):
    rng = np.random.default_rng(0)
    words = ["w%d" % i for i in range(120)] + ["É", "The", "the"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, "\n"), (5, "again w1 w1"), (None, "no id"), (102, "never seen words " * 50)]
    check(spark, frame, rows)
    monkeypatch.setattr(B, "FREQUENT", 10)  # most words come through the join
    monkeypatch.setattr(B, "UNITS", 8)
    monkeypatch.setattr(B, "SLICE_BYTES", 200)
    monkeypatch.setattr(B, "GAINS", 7)
    check(spark, frame, rows)


def test_emissions_and_transitions_sum_to_one(spark):
    texts = spark.createDataFrame([("a b c a b",), ("c b a d e f",), ("",)], "t string")
    m, words = B.fit(spark, texts)
    assert np.allclose((10.0 ** m.step).sum(axis=1), 1)
    mass = Counter()
    for r in words.collect():
        mass[r["class"]] += (r["n"] + 1) / 10 ** m.base[r["class"]]
    for k in range(len(m.base)):
        assert mass[k] + 1 / 10 ** m.base[k] == pytest.approx(1)


def topics(docs, words=60):
    """Texts in which words of two kinds alternate; the kinds have like endings."""
    own = np.random.default_rng(7)
    nouns, verbs = [f"{i}n{i % 7}x" for i in range(words)], [f"{i}v{i % 7}x" for i in range(words)]
    return [" ".join(w for _ in range(15) for w in (own.choice(nouns), own.choice(verbs))) for _ in range(docs)]


def test_sweeps_match_a_walk_and_raise_the_likelihood(spark, monkeypatch):
    monkeypatch.setattr(B, "UNITS", 12)
    texts = topics(60) + ["once", "", "0n0x 1v1x " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    fitted, words = B.fit(spark, df)
    seed = fitted.seed
    hist = {}
    for t in map(tokens, texts):
        for a, b in zip([B.END, *t], t):
            hist.setdefault(b, Counter())[history(seed, a)] += 1
    cls = {w: history(seed, w) for w in hist}
    f = lambda v: v * math.log(v) if v > 0 else 0.0

    def matrix():
        out = np.zeros((seed.classes, seed.classes))
        for w, x in hist.items():
            for h, n in x.items():
                out[h, cls[w]] += n
        return out

    def value(m):
        return sum(map(f, m.ravel())) - sum(map(f, m.sum(axis=0)))
    values = [value(matrix())]
    for sweep in range(B.WORD_SWEEPS):
        m, new = matrix(), dict(cls)
        for w, x in hist.items():
            n, home = sum(x.values()), cls[w]
            if w in seed.units or n < 2 or zlib.crc32(w.encode()) % 2 != sweep % 2:
                continue
            total = m.sum(axis=0)
            gain = [sum(f(m[h, c] + k) - f(m[h, c]) for h, k in x.items()) - f(total[c] + n) + f(total[c]) if c != home
                    else sum(f(m[h, c]) - f(m[h, c] - k) for h, k in x.items()) - f(total[c]) + f(total[c] - n)
                    for c in range(seed.classes)]
            if max(gain) > gain[home] + 1e-9:
                new[w] = int(np.argmax(gain))
        cls = new
        values.append(value(matrix()))
    got = {r["word"]: r["class"] for r in words.collect()}
    assert sum(got[w] == c for w, c in cls.items()) >= 0.98 * len(cls)  # equal gains may round apart
    assert values[-1] > values[0] and sum(cls[w] != history(seed, w) for w in cls) > 10
    kinds = Counter((got[w], w.lstrip("0123456789")[0]) for w in got if w and w != "once")
    pure = sum(max(kinds[c, "n"], kinds[c, "v"]) for c in range(seed.classes))
    assert pure >= 0.8 * sum(kinds.values())  # 0.5 with the endings alone


def test_hot_words_span_batches(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_BYTES", 5)
    texts = spark.createDataFrame([("hot hot a",)] * 50 + [(f"z{i} hot",) for i in range(30)], "t string").repartition(4)
    seed = B.Seed({B.END: 0}, np.array([0] + [i % 3 for i in range(B.GROUPS)]), 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = {r.word: r for r in B.word_histograms(texts, seed).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 33 and rows["hot"].n == 130 and rows[""].n == 80 and rows["a"].n == 50
    assert sum(rows["hot"].times) == 130 and rows["hot"].prev == sorted(set(rows["hot"].prev))


def test_endings_from_arrow_bytes():
    import pyarrow as pa
    words = pa.array(["", "a", "ab", "abc", "é", "xé", "", "日本", "z"])
    assert B.endings(words).tolist() == [B.ending(w) for w in words.to_pylist()]
    assert B.endings(words.slice(3, 4)).tolist() == [B.ending(w) for w in words.to_pylist()[3:7]]
    assert B.endings(words.slice(0, 0)).tolist() == []


def test_classes_grow_with_the_corpus():
    assert [B.class_count(n) for n in (0, 10**6, 10**9, 10**14)] == [8, 28, 110, 1099]


def likelihood(pairs, cls):
    k = cls.max() + 1
    n = np.zeros((k, k))
    np.add.at(n, (cls[:, None], cls[None, :]), pairs)
    f = lambda v: (v * np.log(np.maximum(v, 1))).sum()
    return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))


def test_no_exchange_improves():
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 6, (18, 18)).astype(float)
    pairs[:9, 9:] += 20
    cls = B.exchange(pairs, classes=4, sweeps=50)
    best = likelihood(pairs, cls)
    for u in range(18):
        for c in range(4):
            other = cls.copy()
            other[u] = c
            assert likelihood(pairs, other) <= best + 1e-6


def test_better_than_unigrams_on_held_out(spark):
    rows = B.score_texts(spark, spark.read.parquet(f"{SF01}/documents.parquet")).filter("held_out").collect()
    score, base, n = (sum(r[c] for r in rows) for c in ("score", "base_score", "n_tokens"))
    print("held out log10 per token", score / n, "base", base / n)
    assert score > base


def test_empty_tables(spark, frame):
    df = frame([(1, "a")], "doc_id long, text string")
    assert B.score_texts(spark, df.filter("false")).count() == 0
    only_held = next(i for i in range(100) if held(i))
    r = B.score_texts(spark, frame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_units_are_the_most_frequent_words_of_all_texts(spark):
    texts = spark.range(25000).selectExpr("concat('w', CAST(floor(sqrt(id)) AS INT)) AS text")
    model, _ = B.fit(spark, texts)
    times = Counter(f"w{math.isqrt(i)}" for i in range(25000))
    assert list(model.seed.units) == [B.END, *sorted(times, key=lambda w: (-times[w], w))]
