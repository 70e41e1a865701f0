"""As-of lookup -- for each query row, the newest earlier source row of the
same key.  Linear: windows, no join of rows against rows.

A key may hold a large share of all rows.  Rows are therefore cut into chunks of
the ordering column (``key``, ``order div width``); the window runs per chunk,
and a per-chunk summary (one row per chunk) carries the newest source of
earlier chunks into chunks that have none before the query row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(df: DataFrame, key: str, order: str, is_source: Column,
                is_query: Column, values: list[str], width: int = 1 << 16) -> DataFrame:
    """Rows where ``is_query`` with a struct column ``match`` holding ``order``
    and ``values`` of the newest row with ``is_source`` and a smaller ``order``
    in the same ``key`` (null when there is none)."""
    payload = F.struct(F.col(order).alias(order), *[F.col(v) for v in values])
    ev = (df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
          .withColumn("_src", F.when(is_source, payload))
          .withColumn("_qry", is_query))
    w = (Window.partitionBy(key, "_chunk").orderBy(order)
         .rowsBetween(Window.unboundedPreceding, -1))
    local = (ev.withColumn("_local", F.last("_src", ignorenulls=True).over(w))
             .filter("_qry"))
    # One row per (key, chunk): the newest source inside that chunk.  Its size is
    # rows / width per key, so the carry window stays small even for a hot key.
    chunks = ev.groupBy(key, "_chunk").agg(F.max("_src").alias("_last"))
    wc = (Window.partitionBy(key).orderBy("_chunk")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = chunks.select(key, "_chunk", F.last("_last", ignorenulls=True).over(wc)
                          .alias("_carry"))
    out = local.join(carry, [key, "_chunk"], "left")
    return out.withColumn("match", F.coalesce("_local", "_carry")).drop(
        "_chunk", "_src", "_qry", "_local", "_carry")
