"""Structural interning against a plain bisimulation, and texts against recursion."""

import random

import pytest

from tessera.operators import structural as S

NODES, EDGES = "node long, head string, label string", "node long, pos int, role string, name string, child long"


def blocks(nodes, edges, nominal):
    """Coarsest partition by repeated comparison of all parts."""
    named = {n for n, h, _ in nodes if h == "IdType"}
    color = {n: (h, x if nominal or h != "IdType" else None) for n, h, x in nodes}
    while True:
        new = {n: (color[n], tuple(sorted((p, r, m, str(color.get(c))) for a, p, r, m, c in edges if a == n))
                   if not (nominal and n in named) else ()) for n, _, _ in nodes}
        ids = {v: i for i, v in enumerate(sorted(set(map(str, new.values()))))}
        new = {n: ids[str(v)] for n, v in new.items()}
        if len(set(new.values())) == len(set(color.values())):
            return new
        color = new


def graph(seed, cyclic):
    own = random.Random(seed)
    nodes, edges = [], []
    for n in range(60):
        kind = own.choice(["Builtin", "IdType", "Ref", "Array", "Func", "Struct"]) if n > 5 else "Builtin"
        part = lambda: own.randrange(60) if cyclic else own.randrange(n)  # noqa: E731,B023
        label = {"Builtin": own.choice(["int", "bool"]), "IdType": own.choice("TU"),
                 "Array": own.choice([None, "3"])}.get(kind)
        nodes.append((n, kind, label))
        if kind in ("Ref", "Array", "IdType"):
            edges.append((n, 0, "elem", None, part()))
        elif kind == "Func":
            edges += [(n, i, own.choice(["arg", "result"]), None, part()) for i in range(own.randrange(3))]
        elif kind == "Struct":
            edges += [(n, i, "field", own.choice(["a", "b"]), part()) for i in range(own.randrange(3))]
    return nodes, edges


@pytest.mark.parametrize("seed,cyclic,nominal", [(1, False, True), (2, True, False), (3, True, True)])
def test_equal_structure_has_one_number(spark, seed, cyclic, nominal):
    nodes, edges = graph(seed, cyclic)
    df, ef = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    got = {r.node: r for r in S.intern_structures(df, ef, nominal).collect()}
    want = blocks(nodes, edges, nominal)
    assert len(set(want.values())) == len({r.type_no for r in got.values()})
    pairs = {(want[n], r.type_no) for n, r in got.items()}
    assert len(pairs) == len(set(want.values()))
    firsts = sorted((min(n for n in want if want[n] == want[r.node]), r.type_no) for r in got.values())
    assert [t for _, t in sorted(set(firsts))] == list(range(1, len(set(want.values())) + 1))


def test_cycles_that_unfold_alike(spark):
    """A list of one node, and lists that close after two and three, are one type."""
    nodes, edges, n = [(0, "Builtin", "int")], [], 1
    for length in (1, 2, 3):
        for i in range(length):
            s, r, nxt = n + 2 * i, n + 2 * i + 1, n + 2 * ((i + 1) % length)
            nodes += [(s, "Struct", None), (r, "Ref", None)]
            edges += [(s, 0, "field", "v", 0), (s, 1, "field", "next", r), (r, 0, "elem", None, nxt)]
        n += 2 * length
    df, ef = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    numbers = S.intern_structures(df, ef).checkpoint()
    assert {r.node: r.type_no for r in numbers.collect()} == {
        0: 1, **{x: 2 + (x - 1) % 2 for x in range(1, n)}}
    texts = {r.type_no: (r.head, r.repr) for r in S.structure_texts(df, ef, numbers).collect()}
    assert texts == {1: ("Builtin", "int"), 2: ("Struct", "struct {\n  v int  next #3}\n"), 3: ("Ref", "*#2")}


def test_texts_match_recursion(spark):
    nodes, edges = graph(5, False)
    df, ef = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    numbers = S.intern_structures(df, ef).checkpoint()
    got = {r.type_no: r.repr for r in S.structure_texts(df, ef, numbers).collect()}

    def text(n):
        _, head, label = nodes[n]
        own = sorted(e for e in edges if e[0] == n)
        if head in ("Builtin", "IdType"):
            return label if head == "Builtin" else "type " + label
        if head == "Ref":
            return "*" + text(own[0][4])
        if head == "Array":
            return ("[#]" if label else "[]") + text(own[0][4])
        if head == "Struct":
            return "struct {\n" + "".join(f"  {e[3]} {text(e[4])}" for e in own) + "}\n"
        side = lambda role: ", ".join(text(e[4]) for e in own if e[2] == role)
        return f"Func ({side('arg')}) {side('result')}"
    for r in numbers.filter("node = first").collect():
        assert got[r.type_no] == text(r.node)


def test_empty(spark):
    df, ef = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    numbers = S.intern_structures(df, ef)
    assert numbers.count() == 0 and S.structure_texts(df, ef, numbers).count() == 0


def test_joins_that_grow_with_the_types_are_not_broadcast(spark):
    node = spark.range(50).withColumnRenamed("id", "node")
    edges = node.selectExpr("node", "0 AS pos", "'elem' AS role", "CAST(NULL AS STRING) AS name", "node + 1 AS child")
    joined = S._with_child(edges, node.selectExpr("node", "'c' AS color"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
