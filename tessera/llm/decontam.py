"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated query set.  Terms are its words and the most frequent words of all
documents; they weigh their inverse document frequency over the whole corpus.  A randomised
SVD of TF-IDF passages (distributed products A'AX; rows of A are the passages of all documents
and all items, each of unit length with the words that are no terms counted in it) gives the
latent space.  A passage is a window of 1.5 times a length class (a
power of two) that moves by half of it, so an item lies whole in a window of its class.  Items
whose folded rows are within ``min_cosine`` of the passage's are its candidates.

A candidate leaks if the longest common subsequence of item and passage covers ``min_lcs`` of
the item's words and, below ``copy_lcs`` (a paraphrase), also enough of its answer: half of
what follows its last ``Answer:``, or of the content words of its last sentence; where that
is no proper answer, a third of the item's content words.

Every passage of every document is searched, but the cosine is worked out only where a leak
may be: a subsequence of ``min_lcs`` of an item needs some of the item's rarest words, so an
index from rare terms to items tells, with exact bounds, the windows that can hold one.
Vocabulary, weights and space are those of the whole benchmark, whatever part of it a pass
over the documents looks for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown import slices
from .common import materialize

#: Words of the items that one pass over the documents looks for.
BLOCK_WORDS = 1 << 20
#: Documents whose passages a task holds as rows at once, words of a passage, terms besides those
#: of the items.
FIT_DOCUMENTS, FIT_WORDS, FIT_TERMS = 4000, 48, 1 << 14
#: Passages that are multiplied at once, terms in a row of the sums.
FIT_ROWS, SUM_TERMS = 64, 64
#: Text bytes that a task holds as numbers at once.
WORK_BYTES = 1 << 22
#: A term that fewer than this share of the documents hold is a content word; a last sentence
#: with fewer of them is no answer.
CONTENT_SHARE, ANSWER_WORDS = 0.05, 3
#: Lower-cases A-Z and makes ASCII punctuation white space, so that neither hides a match.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b
               for b in range(256))
_SENTENCES = re.compile(rb"[.!?]+\s+|\n+")


class Params(NamedTuple):
    rank: int = 64
    min_cosine: float = 0.3
    min_lcs: float = 0.6
    copy_lcs: float = 0.8


class Space(NamedTuple):
    """The latent space of the whole benchmark; as large as its vocabulary and ``FIT_TERMS``."""
    vocab: dict[bytes, int]
    df: np.ndarray
    fold: np.ndarray  # the last row, that of all other words, is zero
    n_docs: int


class Item(NamedTuple):
    key: int  # number of the benchmark's row
    words: list[int]
    answer: list[int]
    answer_need: int  # words of the answer that a paraphrase must hold


class Model(NamedTuple):
    """Items that one pass looks for.  ``first`` and ``posted`` are the index from terms to items:
    those of term t are posted[first[t]:first[t + 1]]."""
    space: Space
    items: list[Item]
    vectors: np.ndarray
    stride: np.ndarray  # half the item's length class
    rare_need: np.ndarray  # occurrences of its indexed terms in a window that may hold it
    first: np.ndarray
    posted: np.ndarray
    times: np.ndarray  # how often the item's indexed words are the term
    params: Params


def answer_of(text: bytes) -> bytes:
    """What follows the last ``Answer:``, else the last sentence."""
    head, mark, tail = text.lower().rpartition(b"answer:")
    if mark and plain_words(tail):
        return tail
    return ([s for s in _SENTENCES.split(text.strip()) if plain_words(s)] or [b""])[-1]


def answer_terms(text: bytes, space: Space) -> tuple[list[int], int]:
    """(answer, words of it that a paraphrase must hold).

    An explicit answer counts with all its words.  A last sentence counts if another one comes
    before it and it has ``ANSWER_WORDS`` content words; those are the answer.  Else there is no
    telling answer from question, and the item's content words stand for it."""
    def content(part: bytes) -> list[int]:
        ids = word_ids(part, space.vocab)
        return ids[space.df[ids] < CONTENT_SHARE * space.n_docs].tolist()
    explicit = text.lower().rpartition(b"answer:")
    if explicit[1] and plain_words(explicit[2]):
        ids = word_ids(explicit[2], space.vocab).tolist()
        return ids, math.ceil(len(ids) / 2)
    last = answer_of(text)
    ids = content(last)
    if len(ids) >= ANSWER_WORDS and len(plain_words(last)) < len(plain_words(text)):
        return ids, math.ceil(len(ids) / 2)
    ids = content(text)
    return ids, math.ceil(len(ids) / 3)


def plain_words(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN).split()


def word_ids(data: bytes, vocab: dict[bytes, int]) -> np.ndarray:
    words = plain_words(data)
    return np.fromiter(map(vocab.get, words, repeat(-1)), np.int32, len(words))


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs_length(masks: dict[int, int], n: int, other: Iterable[int]) -> int:
    """Longest common subsequence of the n words behind ``masks`` with ``other``; one big
    integer holds a row of the table, a bit per word."""
    full = (1 << n) - 1
    row = full
    for w in other:
        m = masks.get(w)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(``plain_words`` of all texts one after the other, words of each text); a null text has none."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    plain = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(_PLAIN) if data else b""
    cut = pc.ascii_split_whitespace(pa.Array.from_buffers(
        pa.string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)]))
    real = pc.greater(pc.binary_length(cut.values), 0)
    row = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
    return cut.values.filter(real).cast(pa.binary()), np.bincount(row, minlength=len(texts))


def text_ids(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(``word_ids`` of all texts one after the other, words of each text)."""
    words, many = split_words(texts)
    return pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(), many


def term_array(vocab: dict[bytes, int]) -> pa.Array:
    return pa.array(list(vocab), pa.binary())


def word_rows(texts: DataFrame) -> DataFrame:
    """(binary word, n): how many rows of ``texts`` hold each word."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                found, many = split_words(part.column(0))
                found = found.dictionary_encode()
                words = found.dictionary
                key = np.repeat(np.arange(len(part)), many) * len(words) + found.indices.to_numpy()
                key.sort()
                held = key[np.flatnonzero(np.diff(key, prepend=-1))] % max(1, len(words))
                yield pa.RecordBatch.from_arrays(
                    [words, pa.array(np.bincount(held, minlength=len(words)))], names=["word", "n"])
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(spark: SparkSession, texts: DataFrame, items: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """(terms, rows of ``texts`` that hold each): the words of the items and the ``FIT_TERMS`` words
    that most rows hold, ties by the word."""
    own = list(dict.fromkeys(w for t in items for w in plain_words(t)))
    counts = materialize(spark, word_rows(texts), "word_rows")
    listed = spark.createDataFrame([(w,) for w in own], "word binary")
    held = {bytes(r["word"]): r["n"] for r in counts.join(F.broadcast(listed), "word").collect()}
    often = {bytes(r["word"]): r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(FIT_TERMS).collect()}
    vocab = {w: i for i, w in enumerate(dict.fromkeys([*own, *often]))}
    return vocab, np.array([often.get(w, held.get(w, 0)) for w in vocab], np.int64)


class Rows(NamedTuple):
    """A few unit TF-IDF rows: their matrix over the terms they hold, and those."""
    a: np.ndarray
    held: np.ndarray


def _rows(ids: np.ndarray, passage: np.ndarray, weights: np.ndarray, other: float) -> Iterator[Rows]:
    """Rows of the passages; ``passage``: the number of each word's passage, ascending.  Words that
    are no terms (-1) weigh ``other`` in a row's length and have no column."""
    if not len(ids) or ids.max() < 0:
        return
    n = int(passage[-1]) + 1
    missing = np.bincount(passage[ids < 0], minlength=n)
    hit = ids >= 0
    key, count = np.unique(passage[hit] * len(weights) + ids[hit], return_counts=True)
    row, term = np.divmod(key, len(weights))
    value = count * weights[term]
    value /= np.sqrt(np.bincount(row, value * value, n) + missing * other ** 2)[row]
    value = value.astype(np.float32)
    cuts = np.searchsorted(row, np.arange(0, n + FIT_ROWS, FIT_ROWS))
    place = np.zeros(len(weights), np.int64)
    for j, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low < high:
            held = np.flatnonzero(np.bincount(term[low:high], minlength=len(weights)))
            place[held] = np.arange(len(held))
            a = np.zeros((FIT_ROWS, len(held)), np.float32)
            a[row[low:high] - j * FIT_ROWS, place[term[low:high]]] = value[low:high]
            yield Rows(a, held)


def _text_rows(batches: Iterable[pa.RecordBatch], terms: pa.Array, weights: np.ndarray, other: float) -> Iterator[Rows]:
    """``_rows`` of the passages of all texts: ``FIT_WORDS`` words, or what is left of a text."""
    for b in batches:
        for part in (p.slice(low, FIT_DOCUMENTS) for p in slices(b, 0, WORK_BYTES)
                     for low in range(0, len(p), FIT_DOCUMENTS)):
            ids, many = text_ids(part.column(0), terms)
            passages = -(-many // FIT_WORDS)
            first, word = np.cumsum(passages) - passages, np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
            yield from _rows(ids, np.repeat(first, many) + word // FIT_WORDS, weights, other)


def _shares(texts: DataFrame) -> DataFrame:
    """``texts`` in a few parts to each core: what tasks sum up does not grow with the texts."""
    return texts.coalesce(4 * texts.sparkSession.sparkContext.defaultParallelism)


def gram_product(texts: DataFrame, items: list[np.ndarray], vocab: dict[bytes, int],
                 weight: np.ndarray, other: float, x: np.ndarray) -> np.ndarray:
    """A'A x with the passages of ``texts`` and the items as the rows of A; sums are shuffled with
    ``SUM_TERMS`` terms to a row."""
    narrow, blocks = x.astype(np.float32), -(-len(x) // SUM_TERMS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((blocks * SUM_TERMS, x.shape[1]))
        for a, held in _text_rows(batches, term_array(vocab), weight, other):
            z[held] += a.T @ (a @ narrow[held])
        z = z.reshape(blocks, -1)
        at = np.flatnonzero(z.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([r.tobytes() for r in z[at]], pa.binary())], names=["block", "z"])

    def add(t: pa.Table) -> pa.Table:
        z = sum(np.frombuffer(r.as_buffer()) for r in t["z"])
        return pa.table([t["block"][:1], pa.array([z.tobytes()], pa.binary())], names=["block", "z"])
    out = np.zeros((blocks, SUM_TERMS * x.shape[1]))
    for r in _shares(texts).mapInArrow(run, "block int, z binary").groupBy("block").applyInArrow(
            add, "block int, z binary").collect():  # terms x rank
        out[r["block"]] = np.frombuffer(r["z"])
    out = out.reshape(-1, x.shape[1])
    for ids in items:
        for a, held in _rows(ids, np.zeros(len(ids), np.int64), weight, other):
            out[held] += a.T @ (a @ narrow[held])
    return out[:len(x)]


def gram_form(texts: DataFrame, items: list[np.ndarray], vocab: dict[bytes, int],
              weight: np.ndarray, other: float, x: np.ndarray) -> np.ndarray:
    """x'A'A x, of rank x rank: the same rows, of which each needs its product with x only."""
    narrow, width = x.astype(np.float32), x.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.zeros((width, width))
        for a, held in _text_rows(batches, term_array(vocab), weight, other):
            y = a @ narrow[held]
            small += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([small.tobytes()], pa.binary())], names=["z"])
    out = np.zeros((width, width))
    for r in _shares(texts).mapInArrow(run, "z binary").collect():  # a small matrix to each task
        out += np.frombuffer(r["z"]).reshape(width, width)
    for ids in items:
        for a, held in _rows(ids, np.zeros(len(ids), np.int64), weight, other):
            y = a @ narrow[held]
            out += y.T @ y
    return out


def fit(spark: SparkSession, texts: DataFrame, items: list[bytes], params: Params) -> Space:
    """Weights and latent space of the benchmark.  ``texts``: (binary _text)."""
    n_docs = texts.count()
    vocab, df = vocabulary(spark, texts, items)
    weight = np.maximum(np.log((n_docs + 1) / (df + 1)), 0.01)
    other = max(math.log(n_docs + 1), 0.01)  # a word that is no term is as good as unique
    ids = [word_ids(t, vocab) for t in items]
    width = min(params.rank + 8, max(1, len(vocab)))
    x = np.linalg.qr(np.random.default_rng(1).standard_normal((len(vocab), width)))[0]
    x = np.linalg.qr(gram_product(texts, ids, vocab, weight, other, x))[0]
    small = gram_form(texts, ids, vocab, weight, other, x)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:params.rank]
    fold = (weight[:, None] * (x @ vectors[:, top])).astype(np.float32)
    return Space(vocab, df, np.concatenate([fold, np.zeros_like(fold[:1])]), n_docs)


def need_of(n: int, p: Params) -> int:
    """Words in common that ``min_lcs`` of n words asks for."""
    return math.ceil((p.min_lcs - 1e-9) * n)


def model_of(items: list[tuple[int, bytes]], space: Space, params: Params) -> Model:
    """The index of some (key, text) items.

    Of an item's n words a leak lacks n - need at most, so of its rarest n - need + k words it
    holds k.  A fifth more than it may lack are indexed."""
    built, strides, rare_needs, pairs = [], [], [], Counter()
    for key, text in items:
        words = word_ids(text, space.vocab).tolist()
        if not words:
            continue
        n, need = len(words), need_of(len(words), params)
        rare = sorted(words, key=lambda w: (space.df[w], w))[:n - need + max(1, min(need, n // 5))]
        pairs.update((w, len(built)) for w in rare)
        rare_needs.append(len(rare) - (n - need))
        strides.append(max(4, (1 << (n - 1).bit_length()) // 2))
        built.append(Item(key, words, *answer_terms(text, space)))
    terms = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum(np.bincount(terms[:, 0], minlength=len(space.vocab) + 1))])
    return Model(space, built, _unit(np.stack([space.fold[i.words].sum(axis=0) for i in built])),
                 np.array(strides), np.array(rare_needs), first, terms[:, 1],
                 np.array([pairs[p] for p in sorted(pairs)]), params)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def windows(ids: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(item, start word) of every window that holds enough of the item's indexed terms.

    Windows start at multiples of the item's stride and are three strides wide; the last one
    reaches the text's end."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(ids >= 0)
    many = m.first[ids[at] + 1] - m.first[ids[at]]
    at, many = at[many > 0], many[many > 0]
    if not len(at):
        return none

    # An item has no window if the whole text lacks its terms; a subsequence takes each word once.
    def postings(terms: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.repeat(m.first[terms] - np.cumsum(many) + many, many) + np.arange(many.sum())
    term, one, count = np.unique(ids[at], return_index=True, return_counts=True)
    place = postings(term, many[one])
    held = np.bincount(m.posted[place], np.minimum(np.repeat(count, many[one]), m.times[place]), len(m.items))
    able = held >= m.rare_need
    if not able.any():
        return none
    item = m.posted[postings(ids[at], many)]
    item, block = item[able[item]], np.repeat(at, many)[able[item]]
    block = block // m.stride[item]
    last = np.maximum(0, -(-(len(ids) - 3 * m.stride) // m.stride))
    key, count = np.unique(item << 40 | block, return_counts=True)
    item, block = key >> 40, key & ((1 << 40) - 1)
    # A block belongs to the windows that start in it and in the two before it.
    start = np.concatenate([block, block - 1, block - 2])
    item, count = np.tile(item, 3), np.tile(count, 3)
    real = (start >= 0) & (start <= last[item])
    key, which = np.unique(item[real] << 40 | start[real], return_inverse=True)
    held = np.bincount(which, count[real], len(key))
    item, start = key >> 40, key & ((1 << 40) - 1)
    good = held >= m.rare_need[item]
    return item[good], start[good] * m.stride[item[good]]


def leaks_in(ids: np.ndarray, m: Model) -> list[tuple[int, float, float, int, int]]:
    """(key, lcs share, cosine, first word, end word): the best passage per item."""
    best: dict[int, tuple] = {}
    if not len(ids) or not m.items:
        return []
    masks: dict[int, dict[int, int]] = {}
    for i, start in zip(*(a.tolist() for a in windows(ids, m))):
        item, end = m.items[i], min(len(ids), start + 3 * int(m.stride[i]))
        passage = ids[start:end]
        vector = m.space.fold[passage].sum(axis=0)
        cosine = float(vector @ m.vectors[i]) / max(float(np.linalg.norm(vector)), 1e-12)
        if cosine >= m.params.min_cosine:
            if i not in masks:
                masks[i] = _masks(item.words)
            share = verify(item, masks[i], passage[passage >= 0].tolist(), m.params)
            if share:
                best[item.key] = max(best.get(item.key, (-1.0,)), (share, cosine, start, end))
    return [(k, *v) for k, v in sorted(best.items())]


def verify(item: Item, masks: dict[int, int], passage: list[int], p: Params) -> float:
    """The share of the item that its longest common subsequence with the passage covers, or
    0 if that is too little or, in a paraphrase, the answer is not there."""
    n = len(item.words)
    common = lcs_length(masks, n, passage)
    if common < need_of(n, p):
        return 0.0
    if common / n < p.copy_lcs and item.answer_need:
        if lcs_length(_masks(item.answer), len(item.answer), passage) < item.answer_need:
            return 0.0
    return common / n


def _leaks(b: pa.RecordBatch, column: int, m: Model, terms: pa.Array) -> Iterator[list]:
    """``leaks_in`` of every row's text."""
    for part in slices(b, column, WORK_BYTES):
        ids, many = text_ids(part.column(column), terms)
        for one in np.split(ids, np.cumsum(many)[:-1]):
            yield leaks_in(one, m)


def _search(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str,
            item_col: str, item_text_col: str, params: Params) -> tuple[list, list[Model]]:
    """(ids by item key, models): the items of a pass hold up to ``BLOCK_WORDS`` words."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
                        .alias("_text"))
    rows = [(r["i"], bytes(r["t"])) for r in benchmark.select(F.col(item_col).alias("i"), F.coalesce(
        F.col(item_text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
        .orderBy("i", "t").collect()]  # the stated query set
    if not any(plain_words(t) for _, t in rows):
        return [], []
    space = fit(spark, texts, [t for _, t in rows], params)
    blocks, held = [[]], 0
    for key, (_, text) in enumerate(rows):
        n = len(plain_words(text))
        if held + n > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((key, text))
        held += n
    return [i for i, _ in rows], [model_of(b, space, params) for b in blocks
                                  if any(plain_words(t) for _, t in b)]


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               params: Params = Params()) -> DataFrame:
    """One row per leaking (row of ``docs``, row of ``benchmark``): id, item_id, lcs, cosine,
    first_word, end_word.

    Null and empty texts leak nothing; repeated rows each return theirs; items without words
    match nothing; equal items and equal item ids each match; ids may be of any type and null;
    an empty table on either side gives no rows.  Other columns are ignored; an id column with
    one of the other names keeps it, and that column gets a leading underscore.  Ties between
    passages go to the later one."""
    kinds = {"item_id": benchmark.schema[item_col].dataType.simpleString(), "lcs": "double",
             "cosine": "double", "first_word": "long", "end_word": "long"}
    names = ["_" + c if c == id_col else c for c in kinds]
    head = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    schema = ", ".join([head, *[f"`{n}` {k}" for n, k in zip(names, kinds.values())]])
    mapped = ", ".join([head, "_key long", *[f"`{n}` {k}" for n, k in zip(names[1:], list(kinds.values())[1:])]])
    ids, models = _search(spark, docs, benchmark, id_col, text_col, item_col, item_text_col, params)
    out = spark.createDataFrame([], schema)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    item_ids = spark.createDataFrame(list(enumerate(ids)), f"_key long, `{names[0]}` {kinds['item_id']}")
    for model in models:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            terms = term_array(m.space.vocab)
            for b in batches:
                found = [(at, x) for at, leaks in enumerate(_leaks(b, 1, m, terms)) for x in leaks]
                cols = list(zip(*[x for _, x in found])) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([at for at, _ in found], pa.int64())),
                     *[pa.array(c, t) for c, t in zip(cols, (
                         pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))]],
                    names=[id_col, "_key", *names[1:]])
        out = out.unionByName(src.mapInArrow(run, mapped).join(item_ids, "_key").drop("_key").select(
            id_col, *names))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               params: Params = Params()) -> DataFrame:
    """``docs`` (all columns) without the rows that leak an item."""
    at = docs.columns.index(text_col)
    left = docs
    for model in _search(spark, docs, benchmark, id_col, text_col, item_col, item_text_col, params)[1]:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            terms = term_array(m.space.vocab)
            for b in batches:
                clean = [not leaks for leaks in _leaks(b, at, m, terms)]
                yield b.filter(pa.array(clean, pa.bool_()))
        left = left.mapInArrow(run, docs.schema)
    return left
