"""Mixing sources to target weights by capped water-filling.

Each source should hold its weight's share of the budget, but may be repeated
``max_epochs`` times at most.  Clamping a source to its cap frees budget, which the
others take in proportion to their weights until none is above its cap.  That fixed
point is closed form: with sources ordered by cap / weight the clamped ones are a
prefix, and the water level is (budget - caps before) / (weights from here on).

A source's target is whole repetitions of all its documents plus a fraction of one.
The fraction takes documents in a seeded hash order until its words are reached; the
document on the edge gives its first words only, so a source's words equal its rounded
target.  The running sums come from sums per hash bucket (mergeable, one row per source
and bucket) plus a window inside a bucket, so a source with a third of all rows is
dealt over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialize

#: Hash buckets of a source, as hex digits of the hash: 16 ** 3 buckets.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD_RE)).cast("long")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``docs`` with _key (source, never null), size and _h (the seeded order)."""
    return docs.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")),
                                              F.lit(""))) \
        .withColumn("size", word_count(F.col(text_col))) \
        .withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))))


def targets(sums: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """(_key, source_size, target) of each source; ``sums``: (_key, source_size).

    Weights go round the sources by code point, the null source last.  ``budget`` is a
    multiple of all sizes; if it exceeds all caps every source stops at its cap."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_key") == "", "_key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sums.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs)) \
        .withColumn("t", F.sum("source_size").over(everything) * float(budget))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("t") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(rest)) \
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    water = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "_key", "level"))) \
        .over(everything)["level"]
    return s.select("_key", "source_size", F.when(F.col("full"), F.col("cap"))
                    .otherwise(water * F.col("w")).alias("target"))


def _bucket() -> Column:
    return F.substring("_h", 1, BUCKET_DIGITS)


def plan(spark: SparkSession, rows: DataFrame, weights: tuple[float, ...], budget: float,
         max_epochs: float) -> DataFrame:
    """(_key, _bucket, source_size, target, whole, extra, before): what each hash bucket of a
    source needs to know: whole repetitions, words of the fraction, words before the bucket."""
    sums = materialize(spark, rows.groupBy("_key", _bucket().alias("_bucket")).agg(
        F.sum("size").alias("bucket_size")), "buckets")
    per = targets(sums.groupBy("_key").agg(F.sum("bucket_size").alias("source_size")),
                  weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))) \
        .otherwise(0).cast("long")
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("_key").orderBy("_bucket")
                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(spark, sums.join(per, "_key").select(
        "_key", "_bucket", "source_size", "target", whole.alias("whole"),
        (F.round("target").cast("long") - whole * F.col("source_size")).alias("extra"),
        before.alias("before")), "plan")


def allot(rows: DataFrame, buckets: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with source_size, target, whole and part (words of the fraction it gives)."""
    inside = Window.partitionBy("_key", "_bucket").orderBy("_h", id_col, "size").rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.col("extra") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("_bucket", _bucket()).join(buckets, ["_key", "_bucket"]).withColumn(
        "part", F.greatest(F.lit(0), F.least("size", left)).cast("long"))


def mix_report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2),
               budget: float = 1.5, max_epochs: float = 2, seed: str = "mix") -> DataFrame:
    """Per row: id, size, source_size, target, taken.

    Null texts have size 0; null sources are one source; repeated rows count and return
    each (equal rows may swap their parts); an empty table returns no rows; other columns
    are ignored.  No row gives more than ``max_epochs`` times its size."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"),
                      F.col(source_col).alias("_s"))
    rows = materialize(spark, measured(src, "_id", "_t", "_s", seed).select(
        "_id", "_key", "size", "_h"), "sizes")
    return allot(rows, plan(spark, rows, weights, budget, max_epochs), "_id").select(
        F.col("_id").alias(id_col), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word: gaps and words in turn."""
    gaps, words = F.split(text, WORD_RE, -1), F.regexp_extract_all(text, F.lit(WORD_RE), 0)
    return F.array_join(F.zip_with(F.slice(gaps, 1, n), F.slice(words, 1, n),
                                   lambda gap, word: F.concat(gap, word)), "")


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5,
        max_epochs: float = 2, seed: str = "mix", chars_col: str | None = None) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken whole, and the one row
    per source on the edge of its fraction once more with its first words only (then
    ``chars_col``, if given, is that text's length).  Rows without words add none and stay
    once, if their source is taken at all."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # theirs may clash with ours
    cid, ctext, csource = names[id_col], names[text_col], names[source_col]
    hidden = docs.select([F.col(f"`{c}`").alias(h) for c, h in names.items()])
    slim = materialize(spark, measured(hidden.select(cid, ctext, csource), cid, ctext, csource, seed)
                       .select("_key", "size", "_h"), "sizes")
    buckets = plan(spark, slim, weights, budget, max_epochs)
    dealt = allot(measured(hidden, cid, ctext, csource, seed), buckets, cid)
    times = F.when(F.col("size") == 0, (F.col("target") > 0).cast("int")).otherwise(
        F.col("whole") + (F.col("part") == F.col("size")).cast("int")).cast("int")
    edge = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    # One pass: a row stands once per whole repetition (0), and once for its edge part.
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), times),
                      F.when(edge, F.array(F.col("part"))).otherwise(F.array().cast("array<long>")))
    cut = F.col("_part") > 0
    out = dealt.withColumn("_part", F.explode(copies)).withColumn(
        ctext, F.when(cut, first_words(F.col(ctext), F.col("_part").cast("int")))
        .otherwise(F.col(ctext)))
    if chars_col:
        n = names[chars_col]
        out = out.withColumn(n, F.when(cut, F.length(ctext).cast(docs.schema[chars_col].dataType))
                             .otherwise(F.col(n)))
    return out.select([F.col(h).alias(c) for c, h in names.items()])
