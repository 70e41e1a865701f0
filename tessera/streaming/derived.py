"""Symbol index and diagnostics of a changing corpus, by signed deltas.

A batch replaces the texts of some files.  What is derived from a file alone (its names: how
often it declares and uses each) is worked out for those files only.  What is derived from
many files follows by difference: the names the files had are retracted, those they have
now are inserted, and the package's symbol index is the sum of all such deltas.  A file's
diagnostics also depend on what its package declares, so a name that the batch makes
declared, or no longer declared, reaches the files of the package that use it, through the
names kept per file: these, and the batch's own files, are diagnosed again.

Every table is a folder of Parquet with one part per batch.  A batch writes its own parts
only and reads those of earlier batches, so running it again changes nothing.  ``compact``
writes the state as the part of one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES, NAMES, DELTAS, DIAGS = "files", "names", "deltas", "diagnostics"
SCHEMAS = {
    FILES: "key string, pkg string, batch long, diagnosed boolean",
    NAMES: "key string, pkg string, name string, n_decl long, n_ref long, batch long",
    DELTAS: "pkg string, name string, n_decl long, n_ref long, n_files long, batch long",
    DIAGS: "key string, name string, n long, batch long",
}


def _path(path: str, what: str) -> str:
    return f"{path.rstrip('/')}/{what}"


def _before(spark: SparkSession, path: str, what: str, batch: int, batches: list[int]) -> DataFrame:
    """The rows that batches before ``batch`` wrote."""
    parts = [f"{_path(path, what)}/part={b}" for b in batches if b < batch]
    empty = spark.createDataFrame([], SCHEMAS[what])
    return spark.read.schema(SCHEMAS[what]).parquet(*parts) if parts else empty


def _write(df: DataFrame, path: str, what: str, batch: int) -> DataFrame:
    """Writes the part of ``batch`` (again, if it is there) and reads it back."""
    to = f"{_path(path, what)}/part={batch}"
    out = df.withColumn("batch", F.lit(batch).cast("long")).select(*[c.split(" ")[0] for c in SCHEMAS[what].split(", ")])
    out.write.mode("overwrite").parquet(to)
    return df.sparkSession.read.schema(SCHEMAS[what]).parquet(to)


def _newest(files: DataFrame, kind: str | None = None) -> DataFrame:
    """(key, pkg, batch): the last batch that wrote a file's names, or diagnosed it."""
    rows = files if kind is None else files.filter(kind)
    last = F.max(F.struct("batch", "pkg"))
    return rows.groupBy("key").agg(last.alias("_l")).select("key", F.col("_l.pkg").alias("pkg"),
                                                           F.col("_l.batch").alias("batch"))


def names_of(texts: DataFrame, occurrences: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, pkg, name, n_decl, n_ref) of files (key, pkg, text); ``occurrences`` gives (key, name,
    is_decl) rows of (key, text)."""
    occ = occurrences(texts.select("key", "text")).groupBy("key", "name").agg(
        F.count(F.when(F.col("is_decl"), 1)).alias("n_decl"), F.count(F.when(~F.col("is_decl"), 1)).alias("n_ref"))
    return occ.join(texts.select("key", "pkg"), "key").select("key", "pkg", "name", "n_decl", "n_ref")


def apply_batch(spark: SparkSession, path: str, batch: int, texts: DataFrame, batches: list[int],
                occurrences: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Brings the state under ``path`` up to ``texts`` (key, pkg, text; a null text removes the
    file; one row per key).  ``batches`` are those that were applied, in any order; returns how
    many files were read, diagnosed again, and index rows changed."""
    files = _before(spark, path, FILES, batch, batches)
    names = _before(spark, path, NAMES, batch, batches)
    deltas = _before(spark, path, DELTAS, batch, batches)
    dirty = texts.select(F.col("key").cast("string").alias("key"), F.col("pkg").cast("string").alias("pkg"), "text") \
        .checkpoint()
    current = _newest(files, "NOT diagnosed")
    held = names.join(current, ["key", "pkg", "batch"], "left_semi")
    new = _write(names_of(dirty.filter("text IS NOT NULL"), occurrences), path, NAMES, batch)
    old = held.join(dirty.select("key"), "key", "left_semi")

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select("pkg", "name", (sign * F.col("n_decl")).alias("n_decl"), (sign * F.col("n_ref")).alias("n_ref"),
                           F.lit(sign).cast("long").alias("n_files"))
    delta = signed(old, -1).unionByName(signed(new, 1)).groupBy("pkg", "name").agg(
        *[F.sum(c).alias(c) for c in ("n_decl", "n_ref", "n_files")]).filter("n_decl <> 0 OR n_ref <> 0 OR n_files <> 0")
    delta = _write(delta, path, DELTAS, batch)
    # Names whose package begins or ceases to declare them.
    earlier = deltas.join(delta.select("pkg", "name"), ["pkg", "name"], "left_semi").groupBy("pkg", "name").agg(
        F.sum("n_decl").alias("was"))
    turned = delta.join(earlier, ["pkg", "name"], "left").withColumn("was", F.coalesce("was", F.lit(0))).filter(
        (F.col("was") > 0) != (F.col("was") + F.col("n_decl") > 0)).select("pkg", "name").checkpoint()
    after = held.join(dirty.select("key"), "key", "left_anti").unionByName(new)
    using = after.filter("n_ref > 0").join(turned, ["pkg", "name"], "left_semi").select("key", "pkg")
    affected = using.unionByName(dirty.select("key", "pkg")).distinct().checkpoint()
    used = after.filter("n_ref > 0").join(affected.select("key"), "key", "left_semi")
    declared = deltas.unionByName(delta).join(used.select("pkg", "name").distinct(), ["pkg", "name"], "left_semi") \
        .groupBy("pkg", "name").agg(F.sum("n_decl").alias("d")).filter("d > 0")
    _write(used.join(declared, ["pkg", "name"], "left_anti").select("key", "name", F.col("n_ref").alias("n")),
           path, DIAGS, batch)
    rows = dirty.select("key", "pkg", F.lit(False).alias("diagnosed")).unionByName(
        affected.select("key", "pkg", F.lit(True).alias("diagnosed")))
    _write(rows, path, FILES, batch)
    return {"files": dirty.count(), "diagnosed": affected.count(), "index_rows": delta.count()}


def symbol_state(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """(pkg, name, n_decl, n_ref, n_files): the sum of all deltas."""
    rows = _before(spark, path, DELTAS, max(batches, default=0) + 1, batches)
    return rows.groupBy("pkg", "name").agg(*[F.sum(c).alias(c) for c in ("n_decl", "n_ref", "n_files")]).filter("n_files > 0")


def diagnostics_state(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """(key, name, n): names that a file uses and its package does not declare."""
    end = max(batches, default=0) + 1
    last = _newest(_before(spark, path, FILES, end, batches), "diagnosed").select("key", "batch")
    return _before(spark, path, DIAGS, end, batches).join(last, ["key", "batch"], "left_semi").select("key", "name", "n")


def compact(spark: SparkSession, path: str, batches: list[int], to: str) -> list[int]:
    """Writes the state of ``batches`` under ``to`` as one batch, and returns that."""
    end = max(batches)
    files = _before(spark, path, FILES, end + 1, batches)
    current, seen = _newest(files, "NOT diagnosed"), _newest(files, "diagnosed")
    names = _before(spark, path, NAMES, end + 1, batches).join(current, ["key", "pkg", "batch"], "left_semi")
    live = names.select("key").distinct()
    _write(names.drop("batch"), to, NAMES, end)
    _write(symbol_state(spark, path, batches), to, DELTAS, end)
    _write(diagnostics_state(spark, path, batches), to, DIAGS, end)
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("diagnosed")
    _write(seen.join(live, "key", "left_semi").select("key", "pkg", both), to, FILES, end)
    return [end]


def derived_stream(stream: DataFrame, path: str, occurrences: Callable[[DataFrame], DataFrame]):
    """Writer of a stream of texts (key, pkg, text, seq): in a batch a file's last ``seq`` counts."""
    def batch(rows: DataFrame, batch_id: int) -> None:
        w = Window.partitionBy("key").orderBy(F.desc("seq"))
        last = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("key", "pkg", "text")
        apply_batch(rows.sparkSession, path, batch_id, last, list(range(batch_id)), occurrences)
    return stream.writeStream.foreachBatch(batch)
