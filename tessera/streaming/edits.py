"""Current text per document from an edit log, recomputing only the
documents an edit batch touches.

An edit is ``(key, seq, beg, end, new_text)`` with byte offsets; edits of one
document do not commute, so they fold in ``seq`` order.  The fold is one
native ``aggregate`` over the document's sorted edits (BINARY splices, no
Python); different documents fold in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def fold_edits(edits: DataFrame, key: str, base: DataFrame | None = None,
               base_col: str = "bin") -> DataFrame:
    """``(key, bin, n_edits, last_seq)``: base text (empty when absent) with the
    edits applied in ``seq`` order."""
    e = edits.select(key, F.struct(F.col("seq").alias("seq"), F.col("beg").alias("beg"),
                                   F.col("end").alias("end"),
                                   F.encode(F.col("new_text"), "UTF-8").alias("new")).alias("e"))
    g = e.groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("es"))
    if base is not None:
        g = g.join(base.select(key, F.col(base_col).alias("_base")), key, "left")
    else:
        g = g.withColumn("_base", F.lit(None).cast("binary"))
    start = F.coalesce(F.col("_base"), F.lit(b"").cast("binary"))
    folded = F.aggregate("es", start, lambda acc, x: T.splice(acc, x.beg, x.end, x.new))
    return g.select(key, folded.alias("bin"), F.size("es").cast("bigint").alias("n_edits"),
                    F.element_at("es", -1).seq.alias("last_seq"))


def apply_edits(state: DataFrame | None, edits: DataFrame, key: str) -> DataFrame:
    """T1 (batch): state ``(key, bin)`` after ``edits``; untouched keys kept."""
    touched = fold_edits(edits, key, state).select(key, "bin")
    if state is None:
        return touched
    kept = state.join(edits.select(key).distinct(), key, "left_anti").select(key, "bin")
    return touched.unionByName(kept)


def dirty_recompute(state: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Only the keys in the batch are recomputed (left_semi of the state on
    the dirty keys); the rest pass through with ``dirty = false``."""
    dirty = edits.select(key).distinct()
    affected = state.join(dirty, key, "left_semi")
    new = fold_edits(edits, key, affected).select(key, "bin", F.lit(True).alias("dirty"))
    clean = state.join(dirty, key, "left_anti").select(key, "bin", F.lit(False).alias("dirty"))
    return new.unionByName(clean)


def conversation_edits(conv: DataFrame) -> DataFrame:
    """Binding of ``conversations`` as an edit log: key conv_id, seq turn; a
    user turn inserts at 0, an assistant turn appends, a system turn replaces
    everything.  Byte positions come from running lengths (two windows)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.octet_length("text").cast("bigint")
    c = conv.withColumn("_n", n).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    base = F.coalesce(F.last(F.when(F.col("role") == "system", F.col("_s")), ignorenulls=True)
                      .over(before), F.lit(0))
    c = c.withColumn("_l", F.col("_s") - base)
    beg = F.when(F.col("role") == "assistant", F.col("_l")).otherwise(F.lit(0))
    end = F.when(F.col("role") == "user", F.lit(0)).otherwise(F.col("_l"))
    return c.select("conv_id", F.col("turn").alias("seq"), beg.cast("bigint").alias("beg"),
                    end.cast("bigint").alias("end"), F.col("text").alias("new_text"))


def state_schema(spark, state_path: str, key: str, kind: str) -> DataFrame:
    """Every version of every document in the state table (the path must exist)."""
    return spark.read.schema(f"`{key}` {kind}, bin binary, n_buckets int, batch long, bucket int") \
        .parquet(state_path)


def current_state(versions: DataFrame, key: str) -> DataFrame:
    """(key, bin) of the newest version of each document."""
    newest = F.max(F.struct("batch", "bin")).alias("_v")
    return versions.groupBy(key).agg(newest).select(key, F.col("_v.bin").alias("bin"))


def edit_stream_batch(batch: DataFrame, batch_id: int, state_path: str, key: str,
                      buckets: int) -> None:
    """Streaming T1/T2 step for ``foreachBatch``: recompute the touched documents only.

    The state is a log of versions, ``n_buckets=/batch=/bucket=pmod(hash(key), buckets)``.
    A step reads versions of earlier batches in the buckets it touches and writes the new
    texts of the touched documents to its own ``batch=`` folder.  A batch that is run again
    reads the same versions and replaces its own folder, so it changes nothing else; a state
    that cannot be read fails the step.  Only batch 0 starts without a state."""
    spark = batch.sparkSession
    b = F.pmod(F.hash(F.col(key)), F.lit(buckets))
    kind = batch.schema[key].dataType.simpleString()
    state = None
    if batch_id > 0:
        versions = state_schema(spark, state_path, key, kind).filter(F.col("batch") < batch_id)
        # partition columns only: no data file is opened
        if not versions.filter(F.col("n_buckets") != buckets).select("n_buckets").isEmpty():
            raise ValueError(f"the state at {state_path} has another number of buckets")
        touched = [r[0] for r in batch.select(b.alias("bucket")).distinct().collect()]
        state = current_state(versions.filter(F.col("bucket").isin(touched)).join(
            batch.select(key).distinct(), key, "left_semi"), key)
    fold_edits(batch, key, state).select(key, "bin", b.alias("bucket")).write.mode(
        "overwrite").partitionBy("bucket").parquet(
        f"{state_path.rstrip('/')}/n_buckets={buckets}/batch={batch_id}")


def edit_stream(edits: DataFrame, state_path: str, checkpoint: str, key: str, buckets: int,
                trigger: dict | None = None):
    """Structured Streaming form of T1/T2.  ``buckets``: read granularity of the state, about
    its expected size over 1 GB; it cannot change later.  The current texts are
    ``current_state(spark.read.parquet(state_path), key)``."""
    w = (edits.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, i: edit_stream_batch(batch, i, state_path, key, buckets)))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def compact_state(spark, state_path: str, into_path: str, key: str, buckets: int) -> None:
    """Write the newest version of every document as batch 0 of a new state table."""
    versions = spark.read.parquet(state_path)
    b = F.pmod(F.hash(F.col(key)), F.lit(buckets)).alias("bucket")
    current_state(versions, key).select(key, "bin", b).write.partitionBy("bucket").parquet(
        f"{into_path.rstrip('/')}/n_buckets={buckets}/batch=0")
