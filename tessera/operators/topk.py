"""L1: the first rows of every key, without a task that holds all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt over.
SALTS = 32


def first_per_key(df: DataFrame, key: str, order: list[Column | str], limit: Column, rank: str = "rank",
                  salts: int = SALTS) -> DataFrame:
    """``df`` cut to the first ``limit`` rows of each ``key`` in ``order`` (a total order), with their
    ``rank`` from 1.  ``limit`` may differ from key to key and is the same for all rows of one.

    Two levels: rows are dealt by a hash of all their columns, the first ones of each share are
    kept, and only those (``salts`` times the limit at most) are ranked again per key."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).withColumn("_limit", limit)
    share = Window.partitionBy(key, "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(share)).filter("_r <= _limit").drop("_salt", "_r")
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))) \
        .filter(F.col(rank) <= F.col("_limit")).drop("_limit")
