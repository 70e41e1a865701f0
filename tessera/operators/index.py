"""Symbol index, usages, file environment and
dictionary encodings of names and paths.

Every aggregate here is mergeable (count, min/max of a struct), so Spark
combines map-side before the shuffle and a hot symbol or name costs one
partial row per task, never a collected list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from .numbering import dense_number


def first_occurrence(occ: DataFrame, group: list[str], order: list[str],
                     carry: list[str]) -> DataFrame:
    """Per group: count and the first row by ``order`` (with ``carry`` columns)."""
    first = F.min(F.struct(*[F.col(c) for c in order + carry]))
    return occ.groupBy(*group).agg(first.alias("first"), F.count(F.lit(1)).alias("n"))


#: Partitions that the rows of one group are dealt over in a join with its summary.
SALTS = 8


def spread_join(rows: DataFrame, per_group: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """``rows`` with the one row per group of ``per_group``; a group that holds most rows is
    dealt over SALTS partitions by the hash of ``by``, and its summary repeated for them."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*group, "_salt"]).drop("_salt")


def mark_definitions(occ: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """A1 role: the first occurrence of a group is the definition ('def'),
    every other one a reference ('ref').  A spread join with the per-group first
    position (one row per group) instead of a window over the group, so a hot
    group is never one task."""
    firsts = occ.groupBy(*group).agg(F.min(F.struct(*order)).alias("_first"))
    j = spread_join(occ, firsts, group, order)
    is_def = F.struct(*order) == F.col("_first")
    return j.withColumn("role", F.when(is_def, F.lit("def")).otherwise(F.lit("ref"))).drop("_first")


def symbol_index(occ: DataFrame, path: Column, fname: Column, pos: Column,
                 order: list[str], doc: str) -> DataFrame:
    """A1: per symbol path, the definition location (F14), number of references
    and number of documents that mention it."""
    o = occ.select(path.alias("path"), fname.alias("_f"), pos.alias("_p"),
                   *[F.col(c) for c in order], F.col(doc).alias("_doc"))
    first = F.min(F.struct(*[F.col(c) for c in order], F.col("_f"), F.col("_p")))
    # Two levels instead of a distinct count: per (document, path) first --
    # free of shuffles when the occurrences are partitioned by document, as
    # tokenize leaves them -- then per path over those pre-aggregated rows.
    per_doc = o.groupBy("_doc", "path").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    agg = per_doc.groupBy("path").agg(F.min("first").alias("first"), F.sum("n").alias("n"),
                                      F.count(F.lit(1)).alias("n_docs"))
    return agg.select("path", T.loc_repr(F.col("first._f"), F.col("first._p")).alias("def_loc"),
                      (F.col("n") - 1).alias("n_refs"), F.col("n_docs").cast("bigint"))


def file_env(occ: DataFrame, doc: str, name: str, order: list[str],
             carry: list[str]) -> DataFrame:
    """A5: first declaration of each name per document, with its tier
    (1 unexported, 2 exported).  Groups by (doc, name): when ``occ`` is
    hash-partitioned by ``doc`` the aggregate needs no exchange."""
    f = first_occurrence(occ, [doc, name], order, carry)
    tier = F.when(T.is_exported(F.col(name)), F.lit(2)).otherwise(F.lit(1))
    return f.select(doc, name, tier.alias("tier"),
                    *[F.col(f"first.{c}").alias(f"first_{c}") for c in order + carry])


def intern(occ: DataFrame, value: str, order: list[str], col: str = "no",
           start: int = 1) -> DataFrame:
    """Dense numbers in first-seen order.  Distinct values first (a
    mergeable min), then range-partitioned numbering (see ``dense_number``)."""
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("_first")
    d = occ.groupBy(value).agg(first).select(
        value, *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order])
    return dense_number(d, [F.col(f"first_{c}") for c in order] + [F.col(value)], col, start)


def _byte_fold(s: Column, modulus: int) -> Column:
    """(h*2 + byte) folded over the UTF-8 bytes of ``s``, reduced mod ``modulus``
    inside the fold (equal to the full 64-bit hash mod ``modulus``, since the
    modulus divides 2^64; ANSI overflow never happens)."""
    hx = F.hex(F.encode(s, "UTF-8"))
    n = F.octet_length(s)
    idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    bytes_ = F.transform(idx, lambda k: F.conv(F.substring(hx, k * 2 + 1, 2), 16, 10)
                         .cast("bigint"))
    folded = F.aggregate(bytes_, F.lit(0).cast("bigint"),
                         lambda h, b: (h * 2 + b) % F.lit(modulus))
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(folded)


def name_bucket(name: Column, buckets: int = rules.NAME_BUCKETS) -> Column:
    """I4: bucket of a name in the name table."""
    return _byte_fold(name, buckets)


def path_bucket(parts: Column, buckets: int = rules.PATH_BUCKETS) -> Column:
    """I4: a path hashes to the sum of its element hashes; bucket mod 1024."""
    hs = F.transform(parts, lambda p: _byte_fold(p, buckets))
    return F.aggregate(hs, F.lit(0).cast("bigint"), lambda a, h: (a + h) % F.lit(buckets))


def usage_counts(occ: DataFrame, group: list[str], name: str, files: list[str], fname: Column,
                 order: list[str], distinct_files: bool = False) -> DataFrame:
    """A2: per (name, role) with role def (first occurrence of a group) / ref:
    occurrences, files and first file.  ``files``: the columns that tell a file, those of
    ``order`` but its last among them; ``fname``: its name, made of ``group`` and ``files``.

    Occurrences are counted to one row per (group, file) first, by hash: within a file the
    first position is one number.  These rows are dealt once, by group and position: the
    firsts of the groups are a mergeable min over them, and meet the one row that they are
    of by all those keys, so a hot group is never one task."""
    *doc, at = order
    rest = [c for c in group if c != name]
    per_file = occ.groupBy(*group, *files).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias(at))
    for c in group:
        per_file = per_file.filter(F.col(c).isNotNull())
    by = [name, *rest, "_at"]
    per_file = per_file.withColumn("_at", F.xxhash64(*doc, at)).repartition(*by)
    # All columns, though few are read: so both readers of ``per_file`` share its exchange.
    first = per_file.groupBy(name, *rest).agg(F.min(F.struct(*order, *[c for c in files if c not in order], "_n", "_at")).alias("_first"))
    first = first.select(name, *rest, F.col("_first._at").alias("_at"), "_first")
    # Joined by the dealt columns alone; the positions themselves are compared after it.
    is_def = F.lit(True)
    for c in order:
        is_def = is_def & F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    j = per_file.join(first, by, "left").withColumn(
        "_def", F.when(F.col("_first").isNotNull() & is_def, 1).otherwise(0).cast("bigint"))
    j = j.select(F.col(name).alias("name"), fname.alias("fname"), "_def", (F.col("_n") - F.col("_def")).alias("_ref"))
    # (name, file) rows are unique per role when the file determines the
    # group's other keys (a file lies in one source), so files are counted,
    # not distinct-counted; ``distinct_files=True`` keeps the general form.
    nf = F.count_distinct if distinct_files else F.count

    def role(kind, n):
        seen = F.when(F.col(n) > 0, F.col("fname"))
        return F.struct(F.lit(kind).alias("kind"), F.sum(n).cast("bigint").alias("n"),
                        nf(seen).cast("bigint").alias("n_files"), F.min(seen).alias("first_file"))
    # One row per name and both roles in it: the join leaves the rows sorted by name.
    out = j.groupBy("name").agg(role("def", "_def").alias("_d"), role("ref", "_ref").alias("_r"))
    return out.select("name", F.explode(F.array("_d", "_r")).alias("_r")).select("name", "_r.*").filter("n > 0")
