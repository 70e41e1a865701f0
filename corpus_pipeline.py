"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result as Parquet in the shared folder and rereads it as the next one's docs.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, quality, sharding, simhash
from tessera.llm.common import fresh, materialize
from tessera.sources.tables import table

#: SimHash, the latent space and the binomial cutoffs cannot be expressed in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 3 bits): its least id."""
    return simhash.drop_near_duplicates(spark, docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(spark, docs, weights=(3, 1, 2), budget=1.5, max_epochs=2,
                      chars_col="n_chars" if "n_chars" in docs.columns else None)


def sharding_ring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; the text's hash orders copies of one id."""
    crc = fresh(docs, "_crc")[0]
    tied = docs.withColumn(crc, F.crc32(F.col("text").cast("binary")))
    return sharding.assign_shards(spark, tied, shards=40, ties=[crc]).drop(crc)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", decontamination), ("mixing", mixing_sources),
          ("sharding", sharding_ring)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
