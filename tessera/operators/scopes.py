"""Nested scopes recovered from a token stream.

All windows are partitioned by the document key first, so on a token stream
that is hash-partitioned by the document (see ``tokenize``) no window here
adds an exchange.

* depth: running sum of +1 (open) / -1 (close).  An open carries the depth
  after it, a close the depth before it, so partners share a level and
  alternate inside (doc, level).
* partner of an open: the next tag event of the same level (``lead`` over
  (doc, level, is_tag)).
* innermost enclosing scope of any token: the last open *anchor* at the
  token's level before it.  Laminar nesting guarantees that the last open that
  brought the depth to d before a point at depth d is still open there, so no
  interval join is needed.  Each token emits its query event and, if it is a
  tag, an anchor event through ``explode`` (which keeps the partitioning; a
  union would not).
* end of that scope: the open anchor carries its partner's begin, so the same
  window yields it (a scope without a partner runs to the end of the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "open", "close"


def annotate_scopes(tokens: DataFrame, key: str, is_open: Column, is_close: Column,
                    tag: Column, keep: Column | None = None,
                    extra: str | None = None, balance: str | None = None,
                    closes: dict[str, Column] | None = None) -> DataFrame:
    """Adds to every token:

    ``kind`` open/close/null, ``tag``, ``matched`` (tags: has a partner), ``level`` (scope level of a tag, current
    depth otherwise), ``depth`` (depth of the scope that contains the token),
    ``partner_i/partner_tag/partner_beg/partner_end`` (opens: the matching close),
    ``scope_i/scope_tag/scope_beg`` (innermost enclosing open, null at top level),
    ``scope_end`` (begin of the partner close of that scope; null if it has
    none: the scope runs to the end of the file).

    ``keep``: tokens the caller needs afterwards.  The depth sum sees every
    token; all later windows see only the tags and the kept tokens, so the
    sorts do not carry tokens nobody reads.  ``extra``: a column of the open
    tokens that every token receives from its innermost scope as ``scope_extra``.
    ``balance``: a column that already holds the running sum of opens and closes; its
    sort is saved.  ``closes``: columns that a close receives from the tag event before it
    on its level (the open it closes).
    """
    wd = (Window.partitionBy(key).orderBy("i")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kind = F.when(is_open, F.lit(OPEN)).when(is_close, F.lit(CLOSE))
    delta = F.when(kind == OPEN, 1).when(kind == CLOSE, -1).otherwise(0)
    t = (tokens.withColumn("kind", kind).withColumn("tag", F.when(kind.isNotNull(), tag))
         .withColumn("_d", F.col(balance) if balance else F.sum(delta).over(wd)))
    level = F.when(F.col("kind") == CLOSE, F.col("_d") + 1).otherwise(F.col("_d"))
    t = t.withColumn("level", level.cast("bigint")).withColumn(
        "depth", F.when(F.col("kind").isNotNull(), F.col("level") - 1)
        .otherwise(F.col("level")).cast("bigint")).drop("_d")
    if keep is not None:
        t = t.filter(F.col("kind").isNotNull() | keep)

    # Partner: the next tag event at the same level.
    wp = Window.partitionBy(key, "level", F.col("kind").isNotNull()).orderBy("i")
    nxt = lambda c: F.lead(c).over(wp)
    partner_ok = (F.col("kind") == OPEN) & (nxt("kind") == CLOSE) & (nxt("tag") == F.col("tag"))
    prv = lambda c: F.lag(c).over(wp)
    closes_ok = (F.col("kind") == CLOSE) & (prv("kind") == OPEN) & (prv("tag") == F.col("tag"))
    # lead/lag are null at the ends of a level: an unmatched edge tag must read
    # false, not null (a null would vanish from ``~matched`` filters)
    both = F.coalesce(partner_ok, F.lit(False)) | F.coalesce(closes_ok, F.lit(False))
    t = (t.withColumn("matched", F.when(F.col("kind").isNotNull(), both))
         .withColumn("partner_i", F.when(partner_ok, nxt("i")))
         .withColumn("partner_tag", F.when(partner_ok, nxt("tag")))
         .withColumn("partner_beg", F.when(partner_ok, nxt("beg")))
         .withColumn("partner_end", F.when(partner_ok, nxt("end")))
         .withColumns({c: F.when(F.col("kind") == CLOSE, F.lag(v, 1).over(wp)) for c, v in (closes or {}).items()}))

    # Events: the query of every token at its depth, plus an anchor for tags.
    q = F.struct(F.lit(0).alias("role"), F.col("depth").alias("lvl"))
    a = F.when(F.col("kind").isNotNull(),
               F.struct(F.when(F.col("kind") == OPEN, 1).otherwise(2).alias("role"),
                        F.col("level").alias("lvl")))
    # explode + null filter (not a lambda filter) keeps the stage code-generated.
    ev = t.withColumn("_ev", F.explode(F.array(q, a))).filter(F.col("_ev").isNotNull())
    ev = ev.withColumn("_role", F.col("_ev.role")).withColumn("_lvl", F.col("_ev.lvl")).drop("_ev")
    before = (Window.partitionBy(key, "_lvl").orderBy("i", "_role")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The open anchor carries its partner's begin, so the end of a token's
    # innermost scope comes out of the same growing-frame window (no second,
    # reverse-ordered sort).  A scope without a partner runs to the file end.
    anchor = F.when(F.col("_role") == 1, F.struct(
        F.col("i").alias("i"), F.col("tag").alias("tag"), F.col("beg").alias("beg"),
        (F.col(extra).cast("string") if extra else F.lit(None).cast("string")).alias("x"),
        F.col("partner_beg").alias("pb")))
    ev = ev.withColumn("_scope", F.last(anchor, ignorenulls=True).over(before))
    out = ev.filter(F.col("_role") == 0)
    top = F.col("_lvl") <= 0
    return (out.withColumn("scope_i", F.when(~top, F.col("_scope.i")))
            .withColumn("scope_tag", F.when(~top, F.col("_scope.tag")))
            .withColumn("scope_beg", F.when(~top, F.col("_scope.beg")))
            .withColumn("scope_end", F.when(~top, F.col("_scope.pb")))
            .withColumn("scope_extra", F.when(~top, F.col("_scope.x")))
            .drop("_scope", "_role", "_lvl"))


def scopes(annotated: DataFrame, key: str) -> DataFrame:
    """One row per opened scope: level, tag, token span, partner, parent."""
    return annotated.filter(F.col("kind") == OPEN).select(
        key, F.col("i").alias("scope_i"), F.col("partner_i").alias("end_i"),
        F.col("level").alias("depth"), "tag", "beg",
        F.col("partner_end").alias("end"), F.col("scope_i").alias("parent_i"))


def inside_count(tokens: DataFrame, key: str, is_open: Column, is_close: Column,
                 name: str) -> DataFrame:
    """W3 helper: number of open scopes of one kind around each token
    (a running sum), e.g. 'inside nav' = count > 0."""
    w = (Window.partitionBy(key).orderBy("i")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    # An open tag itself is not inside its own scope.
    return tokens.withColumn(name, (F.sum(d).over(w) - F.when(is_open, 1).otherwise(0))
                             .cast("bigint"))
