"""The import graph of a corpus (J6, J8): edges, cycles and levels.

Packages are nodes of a graph whose size follows the number of packages, not of files.  All
steps are joins and mergeable aggregates over (package, package) edges; every round is
checkpointed, so neither lineage nor a lost executor repeats earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stored


def import_edges(files: DataFrame, imports: DataFrame, key: str = "doc_id", pkg: str = "pkg") -> DataFrame:
    """(src, dst, known, n_files) per package and imported path; ``known``: the corpus holds it."""
    packages = files.select(F.col(pkg).alias("dst")).distinct().withColumn("known", F.lit(True))
    used = imports.select(key, F.col("path").alias("dst")).distinct().join(
        files.select(key, F.col(pkg).alias("src")), key)
    return used.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_files")).join(packages, "dst", "left").select(
        "src", "dst", F.coalesce("known", F.lit(False)).alias("known"), "n_files")


def _trim(edges: DataFrame, side: str, other: str) -> DataFrame:
    """``edges`` without those whose ``side`` is no edge's ``other``, again and again."""
    left, n = edges, edges.count()
    while True:
        left = left.join(left.select(F.col(other).alias(side)).distinct(), side, "left_semi") \
            .select("src", "dst").checkpoint()
        before, n = n, left.count()
        if n == before:
            return left


def _spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` (node, own, color) with the least color that reaches each node along the edges
    (src to dst), which lie between nodes of one ``own``."""
    before = None
    while True:
        step = edges.join(marks.select(F.col("node").alias("src"), "own", "color"), "src").select(
            F.col("dst").alias("node"), "own", "color")
        marks = marks.select("node", "own", "color").unionByName(step).groupBy("node", "own").agg(
            F.min("color").alias("color")).checkpoint()
        now = marks.agg(F.sum(F.xxhash64("node", "color").cast("decimal(38,0)"))).first()
        if now == before:
            return marks
        before = now


def import_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): the packages that import themselves, through others or not; ``cycle`` is the
    least package of the strongly connected component.

    What has no cycle before it or after it is trimmed first.  In the rest every node takes the
    least package that reaches it; among the nodes of one such color those that reach that
    package back are its component.  They are taken out, and the rest starts again."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("src", "dst").distinct().checkpoint()
    found = e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    e = e.filter("src <> dst")
    while True:
        e = _trim(_trim(e, "src", "dst"), "dst", "src")
        if e.isEmpty():
            break
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        colored = _spread(e, nodes.select("node", F.lit("").alias("own"), F.col("node").alias("color")))
        back = e.join(colored.select(F.col("node").alias("src"), F.col("color").alias("own")), "src").join(
            colored.select(F.col("node").alias("dst"), F.col("color").alias("own")), ["dst", "own"]).select(
            F.col("dst").alias("src"), F.col("src").alias("dst")).checkpoint()
        home = _spread(back, colored.select("node", F.col("color").alias("own"), F.when(
            F.col("node") == F.col("color"), 0).otherwise(1).alias("color"))).filter("color = 0")
        home = home.select("node", F.col("own").alias("cycle")).checkpoint()
        many = home.groupBy("cycle").count().filter("count > 1").select("cycle")
        found = found.unionByName(home.join(many, "cycle", "left_semi").select("node", "cycle"))
        for end in ("src", "dst"):
            e = e.join(home.select(F.col("node").alias(end)), end, "left_anti")
        e = e.select("src", "dst").checkpoint()
    return stored(found, "cycles").groupBy("node").agg(F.min("cycle").alias("cycle"))


def import_levels(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, cycle) per package of ``packages`` (node): 0 for one that imports no known
    package, else one more than the highest level it imports; null for a package in a cycle
    or that imports one, directly or not.

    A round keeps the edges to packages that still have edges; a package has a level once it
    has none.  What never loses its edges holds all cycles, so only that is searched for them."""
    ensure_checkpoint_dir(packages.sparkSession)
    e = edges.filter("known").select("src", "dst").distinct().checkpoint()
    rest = packages.select("node").distinct().checkpoint()
    sources = lambda edges: edges.select(F.col("src").alias("node")).distinct()
    out, level, n = rest.join(sources(e), "node", "left_anti").withColumn("level", F.lit(0)), 0, e.count()
    while n:
        left = e.join(sources(e).withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").checkpoint()
        before, n = n, left.count()
        if n == before:
            break
        level += 1
        out = out.unionByName(sources(e).join(sources(left), "node", "left_anti").withColumn("level", F.lit(level)))
        e = left
    # Stored first: to the planner a union of branches dealt by node is dealt by node itself (it even
    # takes a repartition out again), but when it runs its branches may lie one after the other.
    return rest.join(stored(out, "levels"), "node", "left").join(import_cycles(e), "node", "left").select("node", "level", "cycle")
