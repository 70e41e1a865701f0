"""Readers for the parquet tables a corpus index is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_corpus_bucketed(df: DataFrame, table_name: str, key: str, buckets: int,
                          mode: str = "overwrite") -> DataFrame:
    """Store a corpus bucketed (and sorted) by its document key as a table.

    Reading it back with ``spark.table(table_name)`` and tokenizing with
    ``prepartitioned=True`` runs the whole per-document chain (tokens, scopes,
    resolution sweep) with no shuffle.  Choose ``buckets`` so that one bucket
    file is about 128-256 MB of text."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table_name)
    return df.sparkSession.table(table_name)
