"""Chains, packages and the import graph on inline snippets and random graphs."""

import random

import pytest

from tessera.operators import chains as C
from tessera.operators import packages as P
from tessera.operators.gosrc import go_diagnostics, go_tokens

A1 = '''package a

import (
	"lib/b"
	zz "lib/c"
	. "lib/dot"
	_ "lib/blank"
)

type T struct {
	next *T
	n    int
	in   b.Box
	p    *zz.Pt
}

func (t *T) M(q b.Box) {
	t.next.next.n.x = 1
	q.Inner.Val.y()
	b.Shared.Inner.lost.more = 2
	_ = zz.Pt
	f(t).next.n
	t.
		next.
		n = 3
	s.next.n = 4
	t.in.Inner.Val = t.p.X.z
}
'''
B1 = "package b\n\ntype Box struct {\n\tInner *In\n}\n\nvar Shared Box\n"
B2 = "package b\n\ntype In struct {\n\tVal int\n}\n"
C1 = "package c\n\ntype Pt struct {\n\tX, Y float64\n}\n"


@pytest.fixture(scope="module")
def chains(spark):
    files = spark.createDataFrame([("a1", "lib/a", A1), ("b1", "lib/b", B1), ("b2", "lib/b", B2), ("c1", "lib/c", C1)],
                                  "doc_id string, dir string, text string")
    a = go_tokens(files, package="dir").checkpoint()
    return a, C.go_chains(a, spark).filter("doc_id = 'a1'").collect()


def test_chains_through_files_and_packages(chains):
    text = A1.encode()
    got = [(r.member, r.depth, r.of, r.status, r.msg and (r.msg, text[r.x_beg:r.x_end].decode()))
           for r in sorted(chains[1], key=lambda r: r.beg)]
    need = "struct type required instead of '%s'"
    field = lambda *rows: [(m, d, "field", s, e) for m, d, s, e in rows]
    want = [("Box", 1, "package", "found", None), ("Pt", 1, "package", "found", None),
            ("Box", 1, "package", "found", None)]
    want += field(("next", 1, "found", None), ("next", 2, "found", None), ("n", 3, "found", None),
                  ("x", 4, "struct_required", (need % "int", "t.next.next.n")))
    want += field(("Inner", 1, "found", None), ("Val", 2, "found", None),
                  ("y", 3, "struct_required", (need % "int", "q.Inner.Val")))
    want += [("Shared", 1, "package", "found", None)] + field(
        ("Inner", 2, "found", None), ("lost", 3, "no_member", None), ("more", 4, "unknown", None))
    want += [("Pt", 1, "package", "found", None)]
    want += field(("next", 1, "unknown", None), ("n", 2, "unknown", None))
    want += field(("next", 1, "found", None), ("n", 2, "found", None))
    want += field(("next", 1, "unknown", None), ("n", 2, "unknown", None))
    want += field(("in", 1, "found", None), ("Inner", 2, "found", None), ("Val", 3, "found", None))
    want += field(("p", 1, "found", None), ("X", 2, "found", None),
                  ("z", 3, "struct_required", (need % "float64", "t.p.X")))
    assert got == want


def test_chain_errors_are_diagnostics(chains, spark):
    text = A1.encode()
    got = {text[r.beg:r.end].decode() for r in go_diagnostics(chains[0], spark).filter("doc_id = 'a1'").collect()
           if r.msg.startswith("struct type")}
    assert got == {"t.next.next.n", "q.Inner.Val", "t.p.X"}


def test_imports(chains):
    rows = {(r.alias, r.path) for r in C.go_imports(chains[0]).collect()}
    assert rows == {("b", "lib/b"), ("zz", "lib/c")}


@pytest.mark.parametrize("members", [1, 3, 8, 21])
def test_long_chains(spark, members):
    """Doubled tables equal a walk, also past a miss in the middle."""
    own = random.Random(members)
    types = "".join(f"type S{i} struct {{\n" + "".join(
        f"\tm{j} *S{own.randrange(6)}\n" for j in range(4)) + "\tend int\n}\n" for i in range(6))
    fields, owner = {}, None
    for line in types.splitlines():
        if line.startswith("type"):
            owner = line.split()[1]
        elif line.startswith("\t"):
            name, kind = line.split()
            fields[owner, name] = kind.lstrip("*")
    chains, lines = [], []
    for _ in range(12):
        path = [own.choice(["m0", "m1", "m2", "m3"]) for _ in range(members)]
        if own.random() < 0.5:
            path[own.randrange(members)] = own.choice(["zz", "end"])
        chains.append(path)
        lines.append("\t_ = v." + ".".join(path) + "\n")
    text = "package p\n" + types + "func f(v *S0) {\n" + "".join(lines) + "}\n"
    a = go_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).checkpoint()
    rows = sorted(C.go_chains(a, spark).collect(), key=lambda r: r.beg)
    want = []
    for path in chains:
        state = "S0"
        for m in path:
            if state is None:
                want.append((m, "unknown"))
            elif state == "int":
                want.append((m, "struct_required"))
                state = None
            elif (state, m) in fields:
                want.append((m, "found"))
                state = fields[state, m]
            else:
                want.append((m, "no_member"))
                state = None
    assert [(r.member, r.status) for r in rows] == want


def test_no_selectors(spark):
    a = go_tokens(spark.createDataFrame([(1, "package p\n"), (2, ""), (3, None)], "doc_id long, text string"))
    assert C.go_chains(a, spark).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_and_levels_of_random_graphs(spark, seed):
    own = random.Random(seed)
    nodes = [f"p{i:02d}" for i in range(24)]
    edges = {(own.choice(nodes), own.choice(nodes)) for _ in range((14, 26, 40)[seed])}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
    cycle = {n: min(m for m in nodes if m == n or (m in reach[n] and n in reach[m])) if n in reach[n] else None
             for n in nodes}
    level = {}

    def depth(n):
        if n not in level:
            level[n] = None if any(cycle[m] for m in reach[n] | {n}) else max(
                (depth(b) + 1 for a, b in edges if a == n), default=0)
        return level[n]
    e = spark.createDataFrame([(a, b, True) for a, b in edges] + [("p00", "outside", False)],
                              "src string, dst string, known boolean")
    got = P.import_levels(spark.createDataFrame([(n,) for n in nodes], "node string"), e).collect()
    assert {r.node: (r.level, r.cycle) for r in got} == {n: (depth(n), cycle[n]) for n in nodes}
    assert len(got) == len(nodes)


def test_cycles_are_searched_for_only_in_what_has_no_level(spark, monkeypatch):
    seen, search = [], P.import_cycles
    monkeypatch.setattr(P, "import_cycles", lambda e: seen.append({tuple(r) for r in e.collect()}) or search(e))
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "a"), ("t", "x")]
    got = P.import_levels(spark.createDataFrame([(n,) for n in "abctxyz"], "node string"), spark.createDataFrame(
        [(a, b, True) for a, b in edges], "src string, dst string, known boolean")).collect()
    assert seen == [{("x", "y"), ("y", "x"), ("t", "x")}]
    assert {r.node: (r.level, r.cycle) for r in got} == {
        "a": (2, None), "b": (1, None), "c": (0, None), "z": (0, None), "t": (None, None), "x": (None, "x"), "y": (None, "x")}


def test_union_of_levels_is_stored_before_it_is_joined(spark):
    edges = spark.createDataFrame([("a", "b", True), ("b", "c", True)], "src string, dst string, known boolean")
    levels = P.import_levels(spark.createDataFrame([(n,) for n in "abc"], "node string"), edges)
    assert "Union" not in levels._jdf.queryExecution().sparkPlan().toString()
    assert {r.node: r.level for r in levels.collect()} == {"a": 2, "b": 1, "c": 0}
