"""Structural types as a graph: one number for equal structure, text for every head.

A type is a node with a head and a label (the name of a builtin or declared type, the size
of an array) and ordered edges to its parts: the element of a Ref or Array, arguments and
results of a Func, fields of a Struct.  Types may be shared and may be cyclic.

Interning is partition refinement.  A node's first color is its head and label; each round
it becomes the digest of its color and of its parts' colors by position.  Rounds end when
no color splits: after the height of the deepest type for trees, and for cyclic types when
no difference is left to find, so cycles that unfold alike get one number.  A round is one
join and one mergeable sum per node: a struct with millions of fields is no list anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .numbering import dense_number

#: Copies of the colors that the edges of one child are dealt over (``int`` is in every struct).
SALTS = 8


def _large(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sorted shuffles.  It grows with the types, while the planner's
    estimate (of small files, before any explode) would send it whole through the driver."""
    return df.hint("merge")


def _digest(*cols: Column) -> Column:
    return F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]),
                           {"ignoreNullFields": "false"}))


def _with_child(edges: DataFrame, of_child: DataFrame) -> DataFrame:
    """``edges`` with the columns of ``of_child`` (node, ...), a hot child dealt over ``SALTS``."""
    copies = of_child.withColumnRenamed("node", "child").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("node", "pos"), F.lit(SALTS)).cast("int")).join(
        _large(copies), ["child", "_salt"], "left").drop("_salt")


def refine(nodes: DataFrame, edges: DataFrame, nominal: bool = True) -> DataFrame:
    """(node, color): equal colors for equal structure.

    ``nodes`` (node, head, label), one row per node; ``edges`` (node, pos, role, name, child), one
    per part, ``pos`` distinct within a node.  With ``nominal`` a declared type (IdType) is
    its declaration, whatever it stands for; else it is compared by its parts and its label
    does not count.  A child that is no node is a part of its own kind."""
    ensure_checkpoint_dir(nodes.sparkSession)
    named = F.col("head") == "IdType"
    label = F.col("label") if nominal else F.when(~named, F.col("label"))
    colors = nodes.select("node", _digest(F.col("head"), label).alias("color")).checkpoint()
    e = edges.select("node", "pos", "role", "name", "child")
    if nominal:
        e = e.join(_large(nodes.filter(named).select("node")), "node", "left_anti")
    e = e.checkpoint()
    found = colors.select("color").distinct().count()
    while True:
        piece = _digest(F.col("pos"), F.col("role"), F.col("name"), F.col("color"))
        # 120 bits of the digest in two sums, which no order of the edges changes.
        half = [F.sum(F.conv(F.substring("piece", at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
        parts = _with_child(e, colors).select("node", piece.alias("piece")).groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), half[0].alias("a"), half[1].alias("b"))
        colors = colors.join(_large(parts), "node", "left").select(
            "node", _digest(F.col("color"), F.col("n"), F.col("a"), F.col("b")).alias("color")).checkpoint()
        before, found = found, colors.select("color").distinct().count()
        if found == before:
            return colors


def intern_structures(nodes: DataFrame, edges: DataFrame, nominal: bool = True) -> DataFrame:
    """(node, type_no, first): numbers from 1 in the order of each structure's least node."""
    colors = refine(nodes, edges, nominal)
    firsts = dense_number(colors.groupBy("color").agg(F.min("node").alias("first")), ["first"], "type_no")
    copies = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return colors.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(
        _large(copies), ["color", "_salt"]).select("node", "type_no", "first")


def structure_texts(nodes: DataFrame, edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(type_no, head, repr) of every structure.

    Texts grow from the leaves: a round writes the types whose parts are written.  A declared
    type is ``type`` and its name; parts of a cycle that no declared type cuts are written
    as ``#`` and their number."""
    ensure_checkpoint_dir(nodes.sparkSession)
    types = numbers.filter("node = first").select("node", "type_no").join(_large(nodes), "node").select(
        "type_no", "node", "head", "label").checkpoint()
    compound = types.filter(~F.col("head").isin("Builtin", "IdType")).select("node", F.col("type_no").alias("owner"))
    of = numbers.select("node", F.col("type_no").alias("part"))
    e = _with_child(edges.join(_large(compound), "node"), of).select("owner", "pos", "role", "name", "part").checkpoint()
    name = F.coalesce("label", F.lit(""))
    done = types.select("type_no", F.when(F.col("head") == "Builtin", name).when(
        F.col("head") == "IdType", F.concat(F.lit("type "), name)).alias("repr")).checkpoint()

    def written(now: DataFrame, closed: bool) -> DataFrame:
        text = F.col("repr") if closed else F.coalesce("repr", F.concat(F.lit("#"), F.col("part").cast("string")))
        sides = e.join(_large(now.select(F.col("type_no").alias("part"), "repr")), "part", "left").withColumn("text", text)
        field = F.concat(F.lit("  "), F.coalesce("name", F.lit("")), F.lit(" "), F.col("text"))

        def listed(role: str, what: Column) -> Column:
            # one type's own parts, in order: as long as its text
            rows = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", what.alias("t")))))
            return F.transform(rows, lambda x: x["t"])
        return sides.groupBy("owner").agg(
            F.max(F.col("text").isNull()).alias("open"), F.max(F.when(F.col("role") == "elem", F.col("text"))).alias("elem"),
            listed("arg", F.col("text")).alias("args"), listed("result", F.col("text")).alias("results"),
            listed("field", field).alias("fields")).select(F.col("owner").alias("type_no"), "open", "elem", "args",
                                                           "results", "fields")
    elem = F.coalesce("elem", F.lit(""))
    size = F.when(F.col("label").isNotNull(), "#").otherwise("")
    text = (F.when(F.col("head") == "Ref", F.concat(F.lit("*"), elem))
            .when(F.col("head") == "Array", F.concat(F.lit("["), size, F.lit("]"), elem))
            .when(F.col("head") == "Func", F.concat(F.lit("Func ("), F.array_join(F.coalesce("args", F.array()), ", "),
                                                    F.lit(") "), F.array_join(F.coalesce("results", F.array()), ", ")))
            .when(F.col("head") == "Struct", F.concat(F.lit("struct {\n"), F.array_join(
                F.coalesce("fields", F.array()), ""), F.lit("}\n"))))
    left = done.filter("repr IS NULL").count()
    while left:
        todo = types.join(_large(done.filter("repr IS NULL").select("type_no")), "type_no")
        made = todo.join(_large(written(done, True)), "type_no", "left").filter("open IS NULL OR NOT open").select(
            "type_no", text.alias("made"))
        done = done.join(_large(made), "type_no", "left").select("type_no", F.coalesce("repr", "made").alias("repr")).checkpoint()
        before, left = left, done.filter("repr IS NULL").count()
        if left == before:  # only cycles are left
            made = todo.join(_large(written(done, False)), "type_no", "left").select("type_no", text.alias("made"))
            done = done.join(_large(made), "type_no", "left").select("type_no", F.coalesce("repr", "made").alias("repr"))
            break
    return done.join(_large(types.select("type_no", "head")), "type_no").select("type_no", "head", "repr")
