"""SimHash near-duplicates with covering locality-sensitive hashing.

Every document gets a 64-bit SimHash of its word shingles.  Two fingerprints link
when they differ in at most ``radius`` bits.  Candidates come from a covering family
of bit masks: bit i carries a vector m(i) of ``radius + 1`` bits, and table v (each
nonzero vector) keeps the bits whose m(i) has odd inner product with v.  Any
``radius`` differing bits span at most ``radius`` dimensions, so some v is orthogonal
to all of them, and the pair agrees on everything that table v keeps: it collides
there with certainty, not with a probability.

A bucket with more than ``cap`` different fingerprints is not compared pair by pair:
its rows pass to a second covering family over the bits the first left free, and then
to a third, after which at most 8 bits are free and a bucket has at most 256 values.
So no case is dropped and no bucket is compared in full beyond that bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, fresh, map_texts, materialize, row_hash, salted_join

BITS = 64
SEED = 42
#: Shingle hashes whose bits are counted at once (bounds the memory of a long text).
BLOCK = 1 << 15


def simhash(data: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: A-Z lower-cased, ASCII white space splits.

    A bit is 1 if set in over half of the shingles' XXH64 values, repeats counted.
    Fewer words than a shingle: the whole sequence is the one shingle; none: 0."""
    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    norm = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        starts, ends = [0], [len(norm)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(lens + 1) - 1
        starts, ends = (stop - lens)[:n].tolist(), stop[shingle - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        raw = b"".join([digest(norm[s:e], SEED)
                        for s, e in zip(starts[i:i + BLOCK], ends[i:i + BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > n).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of every row's whole text (null: empty)."""
    return map_texts(docs, [id_col], text_col, lambda t: (simhash(t, shingle),), "fp long",
                     [pa.int64()])


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the bits of ``free`` such that any ``radius`` of them miss one mask."""
    vectors = (1 << (radius + 1)) - 1
    where = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << bit for j, bit in enumerate(where) if bin((j % vectors + 1) & v).count("1") & 1)
            for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def mask_levels(radius: int, levels: int) -> list[list[tuple[int, int, int]]]:
    """Per level the (parent table, table, kept bits) rows; a child keeps its parent's bits."""
    full = (1 << BITS) - 1
    above, out = [(0, 0)], []
    for _ in range(levels):
        rows, below = [], []
        for parent, kept in above:
            for m in covering_masks(full & ~kept, radius):
                below.append((len(below), kept | m))
                rows.append((parent, below[-1][0], _signed(kept | m)))
        out.append(rows)
        above = below
    return out


def _bucket_links(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for values in b.column(0).to_pylist():
                v = np.unique(np.array(values, np.int64))
                near = np.bitwise_count((v[:, None] ^ v[None, :]).view(np.uint64)) <= radius
                open_ = np.ones(len(v), bool)
                while open_.any():  # one component a turn, grown from its least value
                    seed = int(np.argmax(open_))
                    group = front = np.zeros(len(v), bool)
                    group[seed] = True
                    while front.any():
                        reach = near[front].any(axis=0)
                        front = reach & ~group
                        group = group | reach
                    open_ &= ~group
                    members = v[group]
                    left += [int(members[0])] * (len(members) - 1)
                    right += members[1:].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
    return run


def links(spark: SparkSession, fps: DataFrame, radius: int = 3, cap: int = 512) -> DataFrame:
    """Links (a, b) between the distinct values of ``fps.fp`` that connect every pair
    within ``radius`` bits, directly or through others of its bucket (a spanning star
    per bucket and component instead of all pairs)."""
    levels = mask_levels(radius, 3)
    rows = fps.select("fp")
    found = None
    for depth, masks in enumerate(levels):
        if depth == 0:  # one parent: every value meets all tables
            dealt = rows.withColumn("m", F.explode(F.array(*[
                F.struct(F.lit(nt).alias("nt"), F.lit(mask).alias("mask")) for _, nt, mask in masks]))) \
                .select("fp", "m.nt", "m.mask")
        else:  # a fixed table, at most 3375 rows
            dealt = rows.join(F.broadcast(spark.createDataFrame(masks, "t int, nt int, mask long")), "t")
        keyed = dealt.select(F.col("nt").alias("t"),
                             F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        sizes = materialize(spark, keyed.groupBy("t", "key").agg(
            F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .filter("n > 1"), "buckets")
        near = sizes.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
                                                 <= radius)).select("a", "b")
        shared = keyed.join(sizes.filter("n > 2").select("t", "key", "n"), ["t", "key"])
        last = depth == len(levels) - 1
        small = shared if last else shared.filter(F.col("n") <= cap)
        near = near.union(small.groupBy("t", "key").agg(F.collect_list("fp").alias("v"))
                          .select("v").mapInArrow(_bucket_links(radius), "a long, b long"))
        found = near if found is None else found.union(near)
        if last or sizes.filter(F.col("n") > cap).isEmpty():
            return found
        rows = shared.filter(F.col("n") > cap).select("t", "fp")
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the least id reachable over links of at most ``radius`` bits, the
    row's own included.  Null or wordless texts have fingerprint zero and link like any
    other.  Repeated rows each return; null ids never are a component's least id unless
    it has no other (then component_id is null).  An empty table returns no rows.
    Other columns are ignored."""
    fp = materialize(spark, fingerprints(docs.select(F.col(id_col).alias("_id"),
                                                     F.col(text_col).alias("_t")),
                                         "_id", "_t", shingle), "fingerprints")
    values = materialize(spark, fp.groupBy("fp").agg(
        F.min("_id").alias("low"), F.count("*").alias("n")), "values")
    comp = connected_components(spark, links(spark, values, radius))
    linked = values.join(comp, values["fp"] == comp["node"], "left").select(
        "fp", "low", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("in_comp"))
    roots = linked.filter("in_comp").groupBy("root").agg(F.min("low").alias("root_low"))
    lows = linked.join(roots, "root", "left").filter("n > 1 or in_comp").select(
        "fp", F.coalesce("root_low", "low").alias("low"))
    return salted_join(fp, lows, ["fp"], "left", ["_id"]).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("low", "_id").alias("component_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component left: the row with its least id.

    Null ids come last.  Of rows that repeat that id in the component, the least by a 128-bit
    hash of the row (its columns but for maps) stays.  Rows of other components that repeat
    the id, null included, are left to theirs."""
    k0, k1 = fresh(docs, "_k0", "_k1")
    parts = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]

    def key(df: DataFrame) -> DataFrame:  # never null: the join and the last step share one shuffle
        return df.withColumns({k: row_hash(docs, i, parts) for i, k in enumerate((k0, k1))})
    row = F.struct(F.col("_id").isNull().alias("none"), "_id", "_k0", "_k1")
    slim = key(docs).select(F.col(id_col).alias("_id"), F.col(k0).alias("_k0"), F.col(k1).alias("_k1"),
                            F.col(text_col).alias("_t"))
    fp = map_texts(slim, ["_id", "_k0", "_k1"], "_t", lambda t: (simhash(t, shingle),), "fp long", [pa.int64()])
    # One mergeable minimum per fingerprint, then one per component.
    values = materialize(spark, fp.groupBy("fp").agg(F.min(row).alias("first")), "values")
    comp = connected_components(spark, links(spark, values, radius))
    keep = values.join(comp, values["fp"] == comp["node"], "left").groupBy(
        F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keep = materialize(spark, keep.select(F.col("first._k0").alias(k0), F.col("first._k1").alias(k1)), "keep")
    return key(docs).join(keep, [k0, k1], "left_semi").dropDuplicates([k0, k1]).drop(k0, k1)
