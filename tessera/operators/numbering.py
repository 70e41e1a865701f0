"""Dense numbering in a given order without a global window.

The rows are range-partitioned by the order (a sort), each partition is
counted, the cumulative offsets of the partitions (one row per partition, a
bounded table) are broadcast, and every row gets offset + its position inside
its partition.  The sorted, tagged rows are checkpointed to the session's
checkpoint folder so that counting and numbering see the same partitions and
a lost executor does not renumber anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def dense_number(df: DataFrame, order: list[Column | str], col: str = "no",
                 start: int = 1) -> DataFrame:
    """Adds ``col`` = start, start+1, ... following ``order`` (must be a total order)."""
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (df.orderBy(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                          F.min("_mid").alias("_first"))
    # One row per partition: a bounded table, so the single-partition window
    # and the broadcast below do not grow with the data.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = tagged.join(F.broadcast(offsets.select("_pid", "_off", "_first")), "_pid")
    return out.withColumn(col, (F.col("_off") + F.col("_mid") - F.col("_first")
                                + F.lit(start)).cast("bigint")).drop(
        "_pid", "_mid", "_off", "_first")
