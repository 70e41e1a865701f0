"""Filter interaction audit over a sparse document-term matrix.

Five filters A to E read the same documents; which one removes a document depends on their
order.  Two of them are sums over a row of the document-term matrix: A (too few words) is the
row's sum, B (too few distinct words) its number of nonzero entries against its sum.

The matrix is built in shards.  A task counts words of whole texts into CSR shards of bounded
size (row pointers, term numbers, counts) with term numbers of the shard's own word list; the
arrays travel packed.  The lists, each word once a shard, are what is shuffled: words are
dealt to buckets by hash, numbered by rank in their bucket, and every shard gets its own list
of global numbers back, so no token and no entry of the matrix ever meets a hot word's task.

C and D are counted in the same pass over a text, E from the least id per digest of the text.
What the audit needs of a document is then one of 32 sets of failed filters; documents are
counted per part, set and label, and all 120 orders are read off those few counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, salted_join

FILTERS = "ABCDE"
#: Text bytes of a shard; one row is never cut.
SHARD_BYTES = 1 << 23
#: Text bytes that are cut into words at once.
CUT_BYTES = 1 << 20
#: Buckets of the dictionary; a word's number is its rank in its bucket times this, plus the bucket.
BUCKETS = 4096
_UPPER = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))


class Limits(NamedTuple):
    """A: fewer words; B: a smaller percentage of distinct words; C: a greater percentage of
    capitals among the code points; D: any of these characters."""
    words: int = 100
    distinct: int = 80
    capitals: int = 10
    symbols: str = "#$%&*|"


#: A shard besides the arrays of the columns its rows keep; ``words`` is its own word list, a
#: word a line (words hold no white space).  ``matrix`` is packed by ``pack``.
SHARD = ("shard long, matrix binary, words string, digest array<binary>, capitals array<boolean>, "
         "symbols array<boolean>")
_TYPES = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.binary()), *[pa.list_(pa.bool_())] * 2)
_NAMES = [c.strip().split(" ")[0] for c in SHARD.split(", ")]


def pack(indptr: np.ndarray, indices: np.ndarray, counts: np.ndarray) -> bytes:
    """The three int32 arrays of a CSR shard as compressed bytes.  Indices ascend within a row
    and are kept as differences, whose upper bytes are mostly zero."""
    steps = np.diff(indices, prepend=0)
    planes = [np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T) for a in (
        indptr, steps, counts)]
    raw = b"".join([np.array([len(indptr), len(indices)], "<i8").tobytes(), *(p.tobytes() for p in planes)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, indices, counts) of ``pack``, the indices ascending within rows."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    rows, entries = np.frombuffer(raw, "<i8", 2).tolist()
    out, at = [], 16
    for n in (rows, entries, entries):
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<i4").ravel())
        at += 4 * n
    return out[0], np.cumsum(out[1], dtype=np.int32), out[2]


def slices(b: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``b`` with up to ``most`` bytes (``SHARD_BYTES``) in the text column, or
    a single row."""
    most = SHARD_BYTES if most is None else most
    low = held = 0
    for i, n in enumerate(pc.binary_length(b.column(column)).to_numpy()):
        if i > low and held + n > most:
            yield b.slice(low, i - low)
            low, held = i, 0
        held += int(n)
    if len(b) > low:
        yield b.slice(low)


def count_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, indptr, indices, counts): the words of ``texts`` as a CSR matrix over
    their own list.  Arrow cuts at ASCII white space and encodes; one sort of (row, word)
    brings the equal ones together."""
    coded, rows, low = [], [], 0
    for part in slices(pa.record_batch([texts], ["text"]), 0, CUT_BYTES):
        cut = pc.ascii_split_whitespace(part.column(0))
        real = pc.greater(pc.binary_length(cut.values), 0)
        row = np.repeat(np.arange(low, low + len(part)), np.diff(cut.offsets.to_numpy()))
        rows.append(row[real.to_numpy(zero_copy_only=False)])
        coded.append(cut.values.filter(real).dictionary_encode())
        low += len(part)
    # One list for all pieces, in the order in which the words come.
    coded = pa.chunked_array(coded, pa.dictionary(pa.int32(), texts.type)).unify_dictionaries()
    words = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], texts.type)
    row = np.concatenate([np.zeros(0, np.int64), *rows])
    key = row << 32 | np.concatenate([np.zeros(0, np.int64), *(c.indices.to_numpy() for c in coded.chunks)])
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=-1))
    indptr = np.concatenate([[0], np.cumsum(np.bincount(key[new] >> 32, minlength=len(texts)))])
    return words, indptr, key[new] & 0xFFFFFFFF, np.diff(new, append=len(key))


def text_facts(data: bytes, limits: Limits, symbols: bytes) -> tuple[bytes, bool, bool]:
    """Digest of the text, whether it has too many capitals, whether it holds a symbol."""
    n = len(data) if data.isascii() else len(data.translate(None, _CONTINUATION))
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (hashlib.sha256(data).digest(), 100 * capitals > limits.capitals * n,
            len(data.translate(None, symbols)) < len(data))


def local_shards(docs: DataFrame, keep: list[str], text_col: str, limits: Limits = Limits()) -> DataFrame:
    """CSR shards (schema ``SHARD``, and an array per column of ``keep``) whose term numbers
    count through the shard's own ``words``.  ``shard`` numbers its first row.

    A shard holds up to ``SHARD_BYTES`` of text, or one larger row; a task holds one at a time."""
    symbols = limits.symbols.encode()

    def whole(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in slices(b, len(keep)):
                texts = part.column(len(keep))
                words, indptr, indices, counts = count_words(texts)
                facts = [text_facts(t.as_py(), limits, symbols) for t in texts.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([pack(indptr, indices, counts)]),
                     pc.binary_join(whole(words), "\n"),
                     *[whole(pa.array(f, t.value_type)) for f, t in zip(zip(*facts), _TYPES[3:])],
                     *[whole(pa.concat_arrays([part.column(c)])) for c in range(len(keep))]],
                    names=[*_NAMES, *keep])
                at += len(part)
    src = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kept = "".join(f", `{c}` array<{docs.schema[c].dataType.simpleString()}>" for c in keep)
    return src.mapInArrow(run, SHARD + kept)


class Matrix(NamedTuple):
    """``dictionary`` (word, term).  ``shards``: as ``local_shards`` gives them, with ``numbers``, the
    (local, term) pairs of the shard's list, instead of words (null: a shard without)."""
    dictionary: DataFrame
    shards: DataFrame
    keep: list[str]


def document_term_matrix(spark: SparkSession, docs: DataFrame, keep: list[str], text_col: str,
                         limits: Limits = Limits()) -> Matrix:
    """The document-term matrix of ``docs`` in CSR shards over one dictionary of all words."""
    local = materialize(spark, local_shards(docs, keep, text_col, limits), "shards")
    words = local.filter("words <> ''").select("shard", F.posexplode(F.split("words", "\n")).alias("local", "word"))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")).cast("long") - 1
    numbered = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")).select(
        "shard", "local", "word", (rank * BUCKETS + F.col("bucket")).alias("term"))
    numbers = numbered.groupBy("shard").agg(  # a shard's own word list, bounded with the shard
        F.collect_list(F.struct("local", "term")).alias("numbers"))
    return Matrix(numbered.select("word", "term").distinct(),
                  local.drop("words").join(numbers, "shard", "left"), keep)


def row_sums(matrix: Matrix) -> DataFrame:
    """Kept columns, row_id, n_words, n_distinct, digest, capitals, symbols: the sums and the
    nonzero counts of the matrix's rows, from its CSR arrays with global term numbers."""
    keep = matrix.keep
    kept = [f"`{c}` {matrix.shards.schema[c].dataType.elementType.simpleString()}" for c in keep]
    tail = ["row_id", "n_words", "n_distinct", "digest", "capitals", "symbols"]
    schema = ", ".join([*kept, "row_id long, n_words long, n_distinct long, digest binary, "
                        "capitals boolean, symbols boolean"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, packed, numbers, *facts = (b.column(len(keep) + c)[i] for c in range(6))
                ends, column, counts = unpack(packed.as_py())
                rows = len(ends) - 1
                if len(column):
                    pairs = numbers.values
                    terms = np.empty(len(pairs), np.int64)
                    terms[pairs.field(0).to_numpy()] = pairs.field(1).to_numpy()
                    # The list's global numbers in order stand for the columns that are not empty.
                    column = np.unique(terms, return_inverse=True)[1].astype(np.int64)[column]
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                entry = np.sort(np.repeat(np.arange(rows), np.diff(ends)) << 32 | column)
                row = entry[np.diff(entry, prepend=-1) != 0] >> 32
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c)[i].values for c in range(len(keep))],
                     pa.array(shard.as_py() + np.arange(rows)),
                     pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64()),
                     pa.array(np.bincount(row, minlength=rows), pa.int64()),
                     *[f.values for f in facts]], names=[*keep, *tail])
    return matrix.shards.select(*keep, "shard", "matrix", "numbers", "digest", "capitals", "symbols") \
        .mapInArrow(run, schema)


def failing_sets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """Per row: id, part (null: empty) and fails, the set of filters it fails as bits (A is 1).

    E holds for a row whose text a smaller id has too: a null id is neither smaller nor
    greater than any, and rows of one id are no copies of each other.  A null text is empty;
    repeated rows each return; an empty table returns none; other columns are ignored."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = materialize(spark, row_sums(document_term_matrix(spark, slim, ["_id", "part"], "_text", limits)),
                       "rows")
    heads = rows.groupBy("digest").agg(F.min("_id").alias("_head"), F.count("*").alias("_n")) \
        .filter("_n > 1").drop("_n")
    told = salted_join(rows, heads, ["digest"], "left", ["row_id"])
    tests = (F.col("n_words") < limits.words,
             100 * F.col("n_distinct") < limits.distinct * F.col("n_words"),
             F.col("capitals"), F.col("symbols"),
             F.coalesce(F.col("_head") < F.col("_id"), F.lit(False)))
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return told.select(F.col("_id").alias(id_col), "part", "row_id", bits.cast("int").alias("fails"))


def orders(spark: SparkSession) -> DataFrame:
    """All orders and steps: filter_order, step, own (the filter's bit) and before (the bits of
    the filters that run before it).  A fixed table of 600 rows."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            own = 1 << FILTERS.index(f)
            out.append(("".join(order), step, own, before))
            before |= own
    return spark.createDataFrame(out, "filter_order string, step int, own int, before int")


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row per part, filter_order (all 120) and step, zeros included: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (all long).

    ``shapley``: documents that the step's filter removes, summed over all orders.  Of the
    orders of all filters, those that run a filter before the others which a document fails
    too are one in the size of its set, so the sum needs no order at all.  A document with
    several label rows has each label that any of them gives; labels of null ids are no one's.
    An empty ``docs`` has no parts and returns no rows."""
    sets = failing_sets(spark, docs, id_col, text_col, part_col, limits)
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    told = salted_join(sets.withColumnRenamed(id_col, "_doc"), marks, ["_doc"], "left", ["row_id"])
    groups = materialize(spark, told.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic")), "groups")
    # Every part meets the fixed table of orders; it has 32 sets at most.
    every = groups.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))).join(
        F.broadcast(orders(spark)), "step")
    fails, own, before = F.col("fails"), F.col("own"), F.col("before")
    failing = fails.bitwiseAND(own) != 0
    earlier = fails.bitwiseAND(before) != 0
    removed = failing & ~earlier

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    share = F.coalesce(*[F.when(F.bit_count(fails) == m, 120 // m) for m in range(1, 6)], F.lit(0))
    return every.groupBy("part", "filter_order", "step").agg(
        total(~failing & ~earlier).alias("kept"), total(removed).alias("removed"),
        total(failing & earlier).alias("redundant"), total(fails == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(failing, F.col("n") * share).otherwise(0)).cast("long").alias("shapley"))
