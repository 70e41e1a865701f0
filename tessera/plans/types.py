"""Type-descriptor queries over the ``part`` table.

Binding: each part carries a type descriptor
``case p_size % 3 when 0 then p_brand when 1 then '*' || p_brand else '[]' || p_type``;
a brand is a named struct type whose members are the part types that some
part of that brand has with a retail price below ``MEMBER_PRICE``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as IX
from ..operators import structural as ST
from ..sources.tables import table
from .registry import query

MEMBER_PRICE = 950.0


def descriptor():
    m = F.col("p_size") % 3
    return (F.when(m == 0, F.col("p_brand"))
            .when(m == 1, F.concat(F.lit("*"), F.col("p_brand")))
            .otherwise(F.concat(F.lit("[]"), F.col("p_type"))))


DESC_SQL = ("CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN '*' || p_brand "
            "ELSE '[]' || p_type END")
REPR_SQL = ("regexp_extract({d}, '^((?:\\*|\\[\\])*)', 1) || 'type ' || "
            "substr({d}, strlen(regexp_extract({d}, '^((?:\\*|\\[\\])*)', 1)) + 1)")


@query("intern_types", sql=f"""
WITH d AS (SELECT {DESC_SQL} AS descriptor, p_partkey FROM part),
f AS (SELECT descriptor, min(p_partkey) AS first_part FROM d GROUP BY descriptor)
SELECT descriptor, CAST(row_number() OVER (ORDER BY first_part) AS BIGINT) AS type_no,
       CASE WHEN starts_with(descriptor, '*') THEN 'Ref' WHEN starts_with(descriptor, '[]') THEN 'Array'
            ELSE 'IdType' END AS head,
       {REPR_SQL.format(d="descriptor")} AS repr
FROM f
""")
def intern_types(spark, sf_dir):
    """I3 + F15: structural interning of type descriptors (first-seen numbering)."""
    p = table(spark, sf_dir, "part").select("p_partkey", descriptor().alias("descriptor"))
    n = IX.intern(p, "descriptor", ["p_partkey"], col="type_no")
    return n.select("descriptor", "type_no", T.type_head(F.col("descriptor")).alias("head"),
                    T.type_repr(F.col("descriptor")).alias("repr"))


@query("resolve_members", sql=f"""
WITH d AS (SELECT p_partkey, p_type, {DESC_SQL} AS descriptor FROM part),
o AS (SELECT *, CASE WHEN starts_with(descriptor, '*') THEN substr(descriptor, 2) ELSE descriptor END AS owner FROM d),
m AS (SELECT DISTINCT p_brand AS owner, p_type AS member FROM part WHERE p_retailprice < {MEMBER_PRICE})
SELECT o.p_partkey, o.owner, o.p_type AS member,
       CASE WHEN starts_with(o.owner, '[]') THEN 'struct_required'
            WHEN m.member IS NULL THEN 'no_member' ELSE 'found' END AS status,
       CASE WHEN starts_with(o.owner, '[]')
            THEN 'struct type required instead of ''' || {REPR_SQL.format(d="o.owner")} || '''' END AS msg
FROM o LEFT JOIN m ON m.owner = o.owner AND m.member = o.p_type
""")
def resolve_members(spark, sf_dir):
    """J5 + F16: ``x.member`` -- strip one pointer from the owner type, then look
    the member up in the struct's field table (left join); non-struct owners
    are an error, a missing member is a silent miss."""
    p = table(spark, sf_dir, "part")
    o = p.select("p_partkey", F.col("p_type").alias("member"),
                 T.type_strip_pointer(descriptor()).alias("owner"))
    fields = (p.filter(F.col("p_retailprice") < MEMBER_PRICE)
              .select(F.col("p_brand").alias("owner"), F.col("p_type").alias("member"))
              .distinct().withColumn("_f", F.lit(True)))
    j = o.join(fields, ["owner", "member"], "left")
    is_struct = T.type_head(F.col("owner")).isin("IdType", "Struct")
    status = (F.when(~is_struct, F.lit("struct_required"))
              .when(F.col("_f").isNull(), F.lit("no_member")).otherwise(F.lit("found")))
    msg = F.when(~is_struct, F.format_string("struct type required instead of '%s'",
                                             T.type_repr(F.col("owner"))))
    return j.select("p_partkey", "owner", "member", status.alias("status"), msg.alias("msg"))


#: Types of a part: slot 0 a builtin by its size, slots 1 to 6 built one on the other (which head
#: and which names: by size and slot), slots 7 and 8 a cyclic list whose cycle has 1 to 3 nodes.
DEPTH = 6


def _structures(spark, sf_dir):
    """(nodes, edges) of all parts; a node's number is 100 times the key plus the slot."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 100).alias("k"), F.col("p_size").alias("z"))
    lit = F.lit
    none = lit(None).cast("string")
    slot = p.withColumn("d", F.explode(F.sequence(lit(1), lit(DEPTH))))
    head = F.element_at(F.array(*map(lit, ["Ref", "Array", "Func", "Struct"])), ((F.col("z") + F.col("d")) % 4 + 1).cast("int"))
    deep = slot.withColumn("head", head)
    sized = F.when((F.col("head") == "Array") & (F.col("z") % 2 == 0), lit("4"))
    base = p.select(F.col("k").alias("node"), lit("Builtin").alias("head"), F.element_at(
        F.array(*map(lit, ["int", "string", "bool"])), (F.col("z") % 3 + 1).cast("int")).alias("label"))
    ring = p.withColumn("j", F.explode(F.sequence(lit(0), (F.col("z") % 3).cast("int"))))
    at = F.col("k") + 10 + 2 * F.col("j")
    nxt = F.col("k") + 10 + 2 * ((F.col("j") + 1) % (F.col("z") % 3 + 1))
    name = F.concat(lit("v"), (F.col("z") % 2).cast("string"))
    nodes = base.unionByName(deep.select((F.col("k") + F.col("d")).alias("node"), "head", sized.alias("label"))) \
        .unionByName(ring.select(at.alias("node"), lit("Struct").alias("head"), none.alias("label"))) \
        .unionByName(ring.select((at + 1).alias("node"), lit("Ref").alias("head"), none.alias("label")))

    def edge(rows, node, pos, role, field, child):
        return rows.select(node.alias("node"), lit(pos).alias("pos"), lit(role).alias("role"),
                           field.alias("name"), child.alias("child"))
    me, below = F.col("k") + F.col("d"), F.col("k") + F.col("d") - 1
    func, struct = deep.filter("head = 'Func'"), deep.filter("head = 'Struct'")
    edges = edge(deep.filter("head IN ('Ref', 'Array')"), me, 0, "elem", none, below)
    for part in (edge(func, me, 0, "arg", none, below), edge(func, me, 1, "arg", none, F.col("k")),
                 edge(func, me, 2, "result", none, below), edge(struct, me, 0, "field", lit("in"), below),
                 edge(struct, me, 1, "field", name, F.col("k")),
                 edge(ring, at, 0, "field", name, F.col("k")), edge(ring, at, 1, "field", lit("next"), at + 1),
                 edge(ring, at + 1, 0, "elem", none, nxt)):
        edges = edges.unionByName(part)
    return nodes, edges


@query("intern_structures", sql=f"""
WITH RECURSIVE p AS (SELECT p_partkey * 100 AS k, p_size AS z, ['int', 'string', 'bool'][p_size % 3 + 1] AS b,
                  'v' || p_size % 2 AS f FROM part),
t AS (SELECT k, z, f, b, 0 AS d, 'Builtin' AS head, b AS canon, b AS repr FROM p
      UNION ALL
      SELECT k, z, f, b, d + 1, ['Ref', 'Array', 'Func', 'Struct'][(z + d + 1) % 4 + 1],
             CASE (z + d + 1) % 4 WHEN 0 THEN 'R<' || canon || '>'
                  WHEN 1 THEN 'A' || CASE WHEN z % 2 = 0 THEN '4' ELSE '' END || '<' || canon || '>'
                  WHEN 2 THEN 'F<' || canon || '|' || b || '|' || canon || '>'
                  ELSE 'S<' || canon || '|' || f || '|' || b || '>' END,
             CASE (z + d + 1) % 4 WHEN 0 THEN '*' || repr
                  WHEN 1 THEN CASE WHEN z % 2 = 0 THEN '[#]' ELSE '[]' END || repr
                  WHEN 2 THEN 'Func (' || repr || ', ' || b || ') ' || repr
                  ELSE 'struct {{' || chr(10) || '  in ' || repr || '  ' || f || ' ' || b || '}}' || chr(10) END
      FROM t WHERE d < {DEPTH}),
r AS (SELECT k, f, b, unnest(range(z % 3 + 1)) AS j FROM p),
n AS (SELECT k + d AS node, head, canon, repr FROM t
      UNION ALL SELECT k + 10 + 2 * j, 'Struct', 'ring<' || f || '|' || b || '>', NULL FROM r
      UNION ALL SELECT k + 11 + 2 * j, 'Ref', 'R<ring<' || f || '|' || b || '>>', NULL FROM r),
c AS (SELECT canon, head, min(node) AS first, count(*) AS n_nodes, any_value(repr) AS repr FROM n GROUP BY canon, head)
SELECT CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS type_no, head, CAST(first AS BIGINT) AS first_node,
       CAST(n_nodes AS BIGINT) AS n_nodes, repr FROM c
""")
def intern_structures(spark, sf_dir):
    """I3 + F15: Ref, Array, Func and Struct types nested to depth 6, and cyclic ones: one number
    per structure, with its text (null for parts of a cycle)."""
    nodes, edges = _structures(spark, sf_dir)
    numbers = ST.intern_structures(nodes, edges).checkpoint()
    count = numbers.groupBy("type_no").agg(F.min("first").alias("first_node"), F.count(F.lit(1)).alias("n_nodes"))
    return ST.structure_texts(nodes, edges, numbers).join(count.hint("merge"), "type_no").select(
        "type_no", "head", "first_node", "n_nodes",
        F.when(~F.col("repr").contains("#") | F.col("repr").contains("[#]"), F.col("repr")).alias("repr"))
