"""Language-model scoring with Brown class-based bigrams.

P(word | previous word) = P(class | class of the previous word) * P(word | class).  Every word
has a class; what a word says about its successor is the class of its unit: itself, if it is
one of the ``UNITS`` most frequent words, else its ending (the hash of its last
two bytes).  Exchange clustering assigns the classes in two steps.

Units are few, so their pair counts over the whole training part fit one matrix, and units
move one at a time to the class that raises the likelihood most until nothing moves.  All
other training words seen twice or more start in the class of their ending and are moved in
Spark: a task counts (word, class before it) for its texts, the counts of a word meet once,
and a sweep moves words by the exact gain against the small matrix of class counts.  A sweep
moves every other word, so that words do not all rush to one class; its matrix is summed
before the next one.  Words seen once, and words never seen, have the class of their ending.

The number of classes grows with the corpus.  Scoring needs count and class of every word:
those of the ``FREQUENT`` most frequent ones are known in every task, all others are looked
up by an equi-join of (row, word, class before, times) with the word table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, materialize

UNITS, GROUPS, FREQUENT = 1024, 128, 1 << 17
#: Sweeps of the driver's exchange at most, and sweeps over all other words.
SWEEPS, WORD_SWEEPS = 10, 4
#: Text bytes that a task holds as numbers at once, for counts and for scores.
SLICE_BYTES, SCORE_BYTES = 1 << 23, 1 << 22
#: Counts whose gains by class are worked out at once.
GAINS = 1 << 14
#: The token after a text's last word; no word is empty.
END = ""
_ADD = 0.5


def class_count(text_bytes: int) -> int:
    """Classes for a corpus of that size: 24 for 1 MB, about 100 for 1 GB, 1,100 for 100 TB."""
    return max(8, round(4 * (text_bytes / 64) ** 0.2))


class Coded(NamedTuple):
    """Texts as numbers: ``ids`` are positions in ``words``, END after every text; ``ends`` are the
    places of those ENDs."""
    words: pa.Array
    ids: np.ndarray
    ends: np.ndarray


def code(texts: pa.Array) -> Coded:
    """Words, A-Z lower-cased, cut at ASCII white space; then one END per text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    real = pc.greater(pc.binary_length(cut.values), 0)
    row = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
    found = cut.values.filter(real).dictionary_encode()
    n = np.bincount(row, minlength=len(texts))
    words = pa.concat_arrays([found.dictionary, pa.array([END])])
    ids = np.insert(found.indices.to_numpy(), np.cumsum(n), len(words) - 1)
    return Coded(words, ids, np.cumsum(n + 1) - 1)


def slices(b: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``b`` with up to ``most`` bytes in the text column (null: none), or a single row."""
    most = most or SLICE_BYTES
    low = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()):
        if i > low and held + n > most:
            yield b.slice(low, i - low)
            low, held = i, 0
        held += int(n)
    if len(b) > low:
        yield b.slice(low)


def before(c: Coded, of_word: np.ndarray) -> np.ndarray:
    """``of_word`` of the token before each one; a text's first token stands after an END."""
    seq = of_word[c.ids]
    return np.concatenate([of_word[-1:], seq[:-1]])


def ending(word: str) -> int:
    return zlib.crc32(word.encode()[-2:]) % GROUPS


@lru_cache(maxsize=1)
def _ending_table() -> np.ndarray:
    """``ending`` by the last two bytes: 257 * (the last but one + 1, 0: none) + the last + 1."""
    parts = [b"", *(bytes([b]) for b in range(256))]
    return np.array([zlib.crc32(x + y) % GROUPS for x in parts for y in parts])


def endings(words: pa.Array) -> np.ndarray:
    """``ending`` of every word, from the bytes that Arrow holds."""
    one = pa.concat_arrays([words, pa.array([""])])  # with an offset of its own
    offsets = np.frombuffer(one.buffers()[1], np.int32, len(one) + 1, 4 * one.offset)[:len(words) + 1]
    data = np.frombuffer(one.buffers()[2] or b"", np.uint8)
    size, last = np.diff(offsets), offsets[1:] - 1
    padded = np.concatenate([data.astype(np.int64) + 1, [0]])  # -1: no such byte
    return _ending_table()[257 * padded[np.where(size > 1, last - 1, -1)] + padded[np.where(size > 0, last, -1)]]


def unit_numbers(words: pa.Array, units: dict[str, int]) -> np.ndarray:
    """The unit of each word: its own, else that of its ending after those."""
    own = pc.fill_null(pc.index_in(words, value_set=pa.array(list(units))), -1).to_numpy()
    return np.where(own < 0, len(units) + endings(words), own)


def frequent_words(texts: DataFrame, n: int) -> list[str]:
    """The ``n`` most frequent words of all texts, ties by the word."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                c = code(part.column(0))
                yield pa.RecordBatch.from_arrays([c.words, pa.array(np.bincount(c.ids, minlength=len(c.words)))],
                                                 names=["word", "n"])
    rows = texts.mapInArrow(run, "word string, n long").filter(F.col("word") != END).groupBy("word").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()
    return [r["word"] for r in rows]


def unit_pairs(texts: DataFrame, units: dict[str, int]) -> np.ndarray:
    """How often a unit follows another; every text starts after an END."""
    size = len(units) + GROUPS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * size, np.int64)
        for b in batches:
            for part in slices(b, 0):
                c = code(part.column(0))
                unit = unit_numbers(c.words, units)
                cell, n = np.unique(before(c, unit) * size + unit[c.ids], return_counts=True)
                counts[cell] += n
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["cell", "n"])
    got = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[got["cell"]] = got["n"]
    return out.reshape(size, size)


def _xlogx(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit.  Maximises sum N(a,b) log N(a,b) - sum N(a) log N(a) over left
    and right class counts, the class model's log likelihood but for a constant."""
    size = len(pairs)
    k = min(classes, size)
    order = np.argsort(-pairs.sum(axis=0), kind="stable")
    at = np.empty(size, int)
    at[order] = np.arange(size) % k

    def fold(m: np.ndarray) -> np.ndarray:
        out = np.zeros((k, m.shape[1]))
        np.add.at(out, at, m)
        return out
    n = fold(fold(pairs).T).T
    for _ in range(sweeps):
        moved = False
        for u in order:
            right, left, self_ = np.zeros(k), np.zeros(k), pairs[u, u]
            np.add.at(right, at, pairs[u])
            np.add.at(left, at, pairs[:, u])
            home = at[u]
            right[home] -= self_
            left[home] -= self_
            n[home] -= right
            n[:, home] -= left
            n[home, home] -= self_
            rows, cols = n.sum(axis=1), n.sum(axis=0)
            # What each class gains in its row, its column and their crossing.
            gain = (_xlogx(n + right) - _xlogx(n)).sum(axis=1) + (_xlogx(n.T + left) - _xlogx(n.T)).sum(axis=1)
            d = np.diagonal(n)
            gain += _xlogx(d + right + left + self_) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            # A class's total grows by the pairs with the unit on the other side anyway.
            gain -= _xlogx(rows + left + right.sum() + self_) - _xlogx(rows + left)
            gain -= _xlogx(cols + right + left.sum() + self_) - _xlogx(cols + right)
            best = int(gain.argmax())
            if gain[best] <= gain[home] + 1e-9:
                best = home
            moved |= best != home
            at[u] = best
            n[best] += right
            n[:, best] += left
            n[best, best] += self_
        if not moved:
            break
    return at


class Seed(NamedTuple):
    """Classes of the units; ``class_of`` has the units first, then the endings."""
    units: dict[str, int]
    class_of: np.ndarray
    classes: int


def start_classes(words: pa.Array, seed: Seed) -> np.ndarray:
    return seed.class_of[unit_numbers(words, seed.units)]


HIST = "word string, n long, prev array<int>, times array<long>"
TABLE = HIST + ", class int"


def word_histograms(texts: DataFrame, seed: Seed) -> DataFrame:
    """(word, n, prev, times, class): how often each training word occurs, and after which classes;
    its class to start with.

    A task emits a row per word and slice; rows of a word meet in one partition (one a slice,
    so no word weighs there) and are added up in order of the words."""
    k = seed.classes

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                c = code(part.column(0))
                cell, n = np.unique(c.ids.astype(np.int64) * k + before(c, start_classes(c.words, seed)),
                                    return_counts=True)
                yield _rows(c.words.take(np.unique(cell // k)), cell // k, cell % k, n)

    def table_rows(words: pa.Array, *counts: np.ndarray) -> pa.RecordBatch:
        return _with_class(_rows(words, *counts), start_classes(words, seed))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, held = None, np.zeros(k, np.int64)  # the last word so far may go on
        for b in batches:
            if not len(b):
                continue
            col = b.column(0).dictionary_encode()
            words, of_row = col.dictionary, col.indices.to_numpy()
            head, tail = words[0].as_py(), words[len(words) - 1].as_py()
            lists = b.column(2)
            row = np.repeat(of_row, np.diff(lists.offsets.to_numpy()))
            cell, which = np.unique(row.astype(np.int64) * k + lists.flatten().to_numpy(), return_inverse=True)
            n = np.bincount(which, b.column(3).flatten().to_numpy(), len(cell)).astype(np.int64)
            if word is not None:
                if head == word:
                    add = np.zeros(k, np.int64)
                    mine = cell // k == 0
                    add[cell[mine] % k] = n[mine]
                    held += add
                    cell, n = cell[~mine], n[~mine]
                if len(words) > 1 or head != word:
                    at = np.nonzero(held)[0]
                    yield table_rows(pa.array([word]), np.zeros(len(at), np.int64), at, held[at])
                    word = None
            last = len(words) - 1
            if word is None:
                mine = cell // k == last
                word, held = tail, np.zeros(k, np.int64)
                held[cell[mine] % k] = n[mine]
                cell, n = cell[~mine], n[~mine]
            if len(cell):
                yield table_rows(words.take(np.unique(cell // k)), cell // k, cell % k, n)
        if word is not None:
            at = np.nonzero(held)[0]
            yield table_rows(pa.array([word]), np.zeros(len(at), np.int64), at, held[at])
    parts = texts.mapInArrow(count, HIST)
    return parts.repartition(F.col("word")).sortWithinPartitions("word").mapInArrow(merge, TABLE)


def _rows(words: pa.Array, word: np.ndarray, prev: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per word from parallel arrays that ascend by word."""
    first = np.flatnonzero(np.diff(word, prepend=-1))
    offsets = pa.array(np.append(first, len(word)), pa.int32())
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [words.cast(pa.string()), pa.array(total), pa.ListArray.from_arrays(offsets, pa.array(prev, pa.int32())),
         pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))], names=["word", "n", "prev", "times"])


def _with_class(b: pa.RecordBatch, cls: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cls, pa.int32())], names=[
        "word", "n", "prev", "times", "class"])


def _counts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, prev, times) of a batch's words."""
    prev, times = b.column(2), b.column(3)
    offsets = prev.offsets.to_numpy()
    return offsets - offsets[0], prev.flatten().to_numpy(), times.flatten().to_numpy()


def moved(b: pa.RecordBatch, seed: Seed, matrix: np.ndarray, sweep: int) -> np.ndarray:
    """The classes of a batch's words after a sweep; ``matrix``: counts (class before x class).

    Word w of counts x_h leaves its class a and joins the class b with the greatest
    sum_h f(N_hb + x_h) - f(N_hb) - (f(N_b + n) - f(N_b)), f(v) = v log v, N without w."""
    words, n, cls = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(4).to_numpy().copy()
    offsets, prev, times = _counts(b)
    turn = np.array([zlib.crc32(w.encode()) % 2 == sweep % 2 and w not in seed.units for w in words], bool)
    at = np.flatnonzero(turn & (n > 1))
    once = _xlogx(matrix + 1) - _xlogx(matrix)  # most counts are 1
    column = matrix.sum(axis=0)
    held = np.cumsum(offsets[at + 1] - offsets[at])
    for part in np.split(at, np.flatnonzero(np.diff(held // GAINS)) + 1):
        if not len(part):
            continue
        size = offsets[part + 1] - offsets[part]
        cut = np.concatenate([[0], np.cumsum(size)])
        entry = np.repeat(offsets[part] - cut[:-1], size) + np.arange(cut[-1])
        h, x, owner = prev[entry], times[entry], np.repeat(np.arange(len(part)), size)
        gain_of = once[h]
        more = np.flatnonzero(x > 1)
        gain_of[more] = _xlogx(matrix[h[more]] + x[more, None]) - _xlogx(matrix[h[more]])
        home = cls[part]
        mine = matrix[h, home[owner]]
        gain_of[np.arange(len(h)), home[owner]] = _xlogx(mine) - _xlogx(mine - x)
        gain = np.add.reduceat(gain_of, cut[:-1], axis=0)
        weight = n[part].astype(float)
        cost = _xlogx(column + weight[:, None]) - _xlogx(column)
        cost[np.arange(len(part)), home] = _xlogx(column[home]) - _xlogx(column[home] - weight)
        gain -= cost
        best = gain.argmax(axis=1)
        better = gain[np.arange(len(part)), best] > gain[np.arange(len(part)), home] + 1e-9
        cls[part[better]] = best[better]
    return cls


def sweep_words(table: DataFrame, seed: Seed, matrix: np.ndarray, sweep: int) -> DataFrame:
    """``table`` with the classes after one sweep over every other word."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _with_class(b, moved(b, seed, matrix, sweep))
    return table.mapInArrow(run, TABLE)


def class_matrix(table: DataFrame, seed: Seed) -> np.ndarray:
    """Counts of (class before, class)."""
    k = seed.classes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * k)
        for b in batches:
            if len(b):
                offsets, prev, times = _counts(b)
                owner = np.repeat(b.column(4).to_numpy(), np.diff(offsets))
                out += np.bincount(prev * k + owner, times, k * k)
        at = np.nonzero(out)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at].astype(np.int64))],
                                         names=["cell", "n"])
    got = table.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k)
    out[got["cell"]] = got["n"]
    return out.reshape(k, k)


class Model(NamedTuple):
    """What every task knows; its size is that of the parameters and the classes."""
    seed: Seed
    frequent: pa.Array  # words; of each log10(count + 1) and class:
    logs: np.ndarray
    classes: np.ndarray
    step: np.ndarray  # log10 P(class | class before)
    base: np.ndarray  # log10 of the emission denominator per class
    tokens: int
    words: int


def fit(spark: SparkSession, texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training texts (one string column) and (word, n, class) of its words."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]).cast("long")).alias("b")).first()
    units = {w: i for i, w in enumerate([END, *frequent_words(texts, UNITS - 1)])}
    class_of = exchange(unit_pairs(texts, units), class_count(size["b"] or 0))
    seed = Seed(units, class_of, int(class_of.max()) + 1)
    table = materialize(spark, word_histograms(texts, seed), "histograms")
    pairs = class_matrix(table, seed)
    for sweep in range(WORD_SWEEPS):
        table = materialize(spark, sweep_words(table, seed, pairs, sweep), f"sweep{sweep}")
        pairs = class_matrix(table, seed)
    words = table.select("word", "n", "class")
    k = seed.classes
    distinct, total = np.zeros(k), 0
    for r in words.groupBy("class").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():
        distinct[r["class"]] = r["v"]
        total += r["n"]
    # One share more than the class has words: that of a word never seen.
    base = np.log10(pairs.sum(axis=0) + distinct + 1)
    step = np.log10(pairs + _ADD) - np.log10(pairs.sum(axis=1, keepdims=True) + _ADD * k)
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return Model(seed, pa.array([r["word"] for r in top], pa.string()), np.log10([r["n"] + 1.0 for r in top]),
                 np.array([r["class"] for r in top], int), step, base, int(total), int(distinct.sum())), words


def _score_rows(shared):
    """A row per text with what its task knows, and rows of (row, word, class before, times) that
    the join must tell; ``other`` is the word's class if no training text holds it."""
    names = ["row", "_id", "n_tokens", "known", "logs", "model", "word", "prev", "other", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 40
        logs, classes = np.append(m.logs, 0.0), np.append(m.classes, 0)
        for b in batches:
            for part in slices(b, 1, SCORE_BYTES):
                texts = part.column(1)
                c = code(texts)
                start = start_classes(c.words, m.seed)
                fact = pc.fill_null(pc.index_in(c.words, value_set=m.frequent), len(m.frequent)).to_numpy()
                log, cls, told = logs[fact], classes[fact], fact < len(m.frequent)
                prev, mine = before(c, start), told[c.ids]
                at = np.concatenate([[0], c.ends + 1])[:-1]
                lines = np.repeat(np.arange(len(texts)), np.diff(np.append(at, len(c.ids))))
                value = np.where(mine, m.step[prev, cls[c.ids]] - m.base[cls[c.ids]], 0.0)
                rows = len(texts)
                none = lambda n, t: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(rows)), part.column(0), pa.array(c.ends - at + 1, pa.int64()),
                     pa.array(np.bincount(lines, mine, rows).astype(np.int64)),
                     pa.array(np.bincount(lines, np.where(mine, log[c.ids], 0.0), rows)),
                     pa.array(np.bincount(lines, value, rows)), none(rows, pa.string()), none(rows, pa.int32()),
                     none(rows, pa.int32()), none(rows, pa.int64())], names=names)
                # Equal (row, word, class before) together.
                rare = np.flatnonzero(~mine)
                k = m.seed.classes
                key = (lines[rare] * len(c.words) + c.ids[rare]) * k + prev[rare]
                key, times = np.unique(key, return_counts=True)
                word = key // k % len(c.words)
                n = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + key // k // len(c.words)), none(n, part.column(0).type),
                     *[none(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                     c.words.take(word), pa.array(key % k, pa.int32()),
                     pa.array(start[word], pa.int32()), pa.array(times, pa.int64())], names=names)
                row += rows
    return run


def score_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                folds: int = 7, held: int = 2) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from rows whose id's crc32 modulo ``folds`` is not ``held`` (a null id
    counts as the text '').  base_score: add-one unigrams; score: log10 probability under the
    class model.  Null and empty texts are their END alone; repeated rows each return and
    count; without training rows nothing is known and the classes are one; an empty table
    returns no rows.  Other columns are ignored."""
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    model, words = fit(spark, src.filter(crc32_mod(F.col("_id"), folds) != held).select("_t"))
    kind = src.schema["_id"].dataType.simpleString()
    parts = materialize(spark, src.mapInArrow(
        _score_rows(spark.sparkContext.broadcast(model)),
        f"row long, _id {kind}, n_tokens long, known long, logs double, model double, "
        "word string, prev int, other int, times long"), "parts")
    k = model.seed.classes
    steps = spark.createDataFrame([(h, c, float(model.step[h, c] - model.base[c])) for h in range(k) for c in range(k)],
                                  "prev int, class int, step double")  # classes x classes
    rare = parts.filter("word is not null").select("row", "word", "prev", "other", "times").join(words, "word", "left") \
        .withColumn("class", F.coalesce("class", "other")).join(F.broadcast(steps), ["prev", "class"]).groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more_logs"),
        F.sum(F.col("times") * F.col("step")).alias("more_model"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    score = F.col("model") + F.coalesce("more_model", F.lit(0.0)) + logs
    return parts.filter("word is null").drop("word", "prev", "other", "times").join(rare, "row", "left").select(
        F.col("_id").alias(id_col), (crc32_mod(F.col("_id"), folds) == held).alias("held_out"),
        "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(model.tokens + model.words + 1))).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
