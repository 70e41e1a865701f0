"""Helpers shared by the operators: shared-folder tables, salted joins, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Java regex of one word: a run of anything but ASCII white space.  ``bytes.split()``
#: cuts a UTF-8 text at exactly the same places.
WORD_RE = r"[^\x20\x09-\x0D]+"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files, nothing is recomputed), and
    the file sizes give the planner true statistics for its join choice."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where columns of ``df`` have them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def row_hash(df: DataFrame, seed: int, columns: list[str]) -> Column:
    """64 bits of the columns' values; a null counts by its place."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str,
                spread: list[str], salts: int = 16) -> DataFrame:
    """Equi-join that deals every key of ``big`` over ``salts`` partitions.

    ``small`` (one row per key) is repeated ``salts`` times, so a key that holds a
    third of ``big`` still spreads.  ``spread`` names columns of ``big`` that differ
    within a key.  The copies are never broadcast: the planner sees the bytes of ``small``'s
    files, not how many rows become of them."""
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable, schema: str,
              types: list[pa.DataType], args: tuple = ()) -> DataFrame:
    """One output row per input row: ``keep`` columns, then ``fn(bytes, *args)``'s tuple.

    Texts reach Python as UTF-8 bytes in Arrow batches (null: empty)."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(t or b"", *args) for t in b.column(len(keep)).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.array(c, type=t) for c, t in zip(cols, types)], names=[*keep, *names])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    src = df.select(*keep, F.col(text).cast("string").cast("binary").alias("_text"))
    return src.mapInArrow(run, f"{kept}, {schema}" if keep else schema)


def crc32_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")),
                  F.lit(mod))


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root: the component's least node.

    Alternating large-star and small-star rounds; every round is a mergeable minimum
    and a salted join, written to the shared folder.  Ends when a round changes
    nothing, after a number of rounds logarithmic in the longest chain."""
    def summary(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
                  .alias("h")).first()
        return r["n"], r["h"]

    def star(nbr: DataFrame) -> DataFrame:
        """nbr (u, v) with each u's least neighbour m, u itself included."""
        low = nbr.groupBy("u").agg(F.min("v").alias("m"))
        return salted_join(nbr, low, ["u"], "inner", ["v"]).withColumn("m", F.least("u", "m"))

    e = materialize(spark, edges.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = summary(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .distinct()
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        e = materialize(spark, small.select(F.col("u").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("v").alias("a"), F.col("m").alias("b")))
            .filter("a != b").distinct(), "edges")
        after = summary(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
