"""Go rules on an inline snippet (our own text)."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.gosrc import go_diagnostics, go_fontify, go_items, go_resolve, go_tokens

SRC = '''package main

import "fmt"
import str "strings"

type Point struct {
	X int
}

const Limit = 10

var count int

func helper(a int, p *Point) int {
	b := a
	if b > 0 {
		b := b + 1
		fmt.Println(b)
	}
	x := x
	_ = x
	return b + count
}

func main() {
	var q Undef
	var r count
	m := make()
	s := "héllo"
	t := s
	_ = str.ToUpper(s)
}
'''


@pytest.fixture(scope="module")
def ann(spark):
    df = spark.createDataFrame([(1, SRC)], "doc_id long, text string")
    return go_tokens(df).cache()


def _occ(word, k=0):
    """Byte offset of the k-th occurrence of ``word`` as a whole identifier."""
    import re
    b = SRC.encode()
    ms = [m.start() for m in re.finditer(rb"(?<![\w])" + word.encode() + rb"(?![\w])", b)]
    return ms[k]


def test_declarations(ann):
    d = {(r.name, r.beg): (r.kind, r.local) for r in go_items(ann).filter("is_decl").collect()}
    assert d[("main", _occ("main"))] == ("PACKAGE", False)
    assert d[("fmt", _occ('"fmt"') if False else SRC.encode().index(b'"fmt"'))] == ("PACKAGE", False)
    assert d[("str", _occ("str"))] == ("PACKAGE", False)
    assert d[("Point", _occ("Point"))] == ("TYPE", False)
    assert d[("Limit", _occ("Limit"))] == ("CONST", False)
    assert d[("count", _occ("count"))] == ("VAR", False)
    assert d[("helper", _occ("helper"))] == ("FUNC", False)
    assert d[("a", _occ("a"))] == ("VAR", True)          # parameter, visible in the body
    assert d[("b", _occ("b", 0))] == ("VAR", True)
    assert d[("b", _occ("b", 2))] == ("VAR", True)       # inner b := b + 1
    assert not any(name == "_" for name, _ in d)         # blank identifier never declared


def test_resolution(ann, spark):
    r = {r.beg: (r.tier, r.decl_i is not None, r.decl_kind)
         for r in go_resolve(ann, spark).collect()}
    items = {r.beg: r.i for r in go_items(ann).filter("is_decl").collect()}
    res = {r.beg: r.decl_i for r in go_resolve(ann, spark).collect()}
    assert res[_occ("a", 1)] == items[_occ("a", 0)]                  # b := a -> parameter
    assert res[_occ("b", 1)] == items[_occ("b", 0)]                  # if b > 0 -> outer b
    assert res[_occ("b", 3)] == items[_occ("b", 2)]                  # b := b + 1 reads the new b
    assert res[_occ("b", 4)] == items[_occ("b", 2)]                  # Println(b) -> inner b
    assert res[_occ("b", 5)] == items[_occ("b", 0)]                  # after the block -> outer b
    assert res[_occ("x", 1)] == items[_occ("x", 0)]                  # x := x reads the new x
    assert r[_occ("count", 1)][0] == 2                               # file tier
    assert r[_occ("int", 0)][0] == 3 and r[_occ("int", 0)][2] == "TYPE"  # builtin tier


def test_diagnostics(ann, spark):
    d = {(r.beg, r.msg) for r in go_diagnostics(ann, spark).collect()}
    assert (_occ("Undef"), "type `Undef' undefined") in d
    assert (_occ("count", 2), "type ident required") in d
    assert (_occ("make"), "type argument required") in d
    assert len(d) == 3


def test_fontify_and_multibyte(ann, spark):
    f = {(r.tok, r.beg): r.cls for r in go_fontify(ann, spark).collect()}
    assert f[("package", 0)] == "Keyword"
    assert f[("Point", _occ("Point"))] == "TypeDef"
    assert f[("helper", _occ("helper"))] == "MethDef"
    assert f[("count", _occ("count", 1))] == "Var"
    assert f[("Limit", _occ("Limit"))] == "ConDef"
    # offsets are bytes: 't' comes after the two-byte e-acute
    assert f[("t", _occ("t"))] == "VarDef"
    assert _occ("t") == SRC.encode().index(b"\tt := s") + 1


GROUPED = '''package g

var (
	alpha = 1
	beta  Gamma
)

const (
	One = iota
	Two
)

type (
	Gamma int
	Delta struct{ x int }
)

func use() {
	_ = alpha + One + Two
	var z Delta
	_ = z
}
'''


def test_grouped_declarations(spark):
    df = spark.createDataFrame([(2, GROUPED)], "doc_id long, text string")
    a = go_tokens(df)
    d = {r.name: r.kind for r in go_items(a).filter("is_decl").collect()}
    assert d["alpha"] == "VAR" and d["beta"] == "VAR"
    assert d["One"] == "CONST" and d["Two"] == "CONST"
    assert d["Gamma"] == "TYPE" and d["Delta"] == "TYPE"
    assert go_diagnostics(a, spark).count() == 0     # beta's type Gamma resolves
    r = {x.name: x.tier for x in go_resolve(a, spark).collect()}
    assert r["alpha"] == 2 and r["One"] == 2 and r["Two"] == 2 and r["Delta"] == 2


MEMBERS = '''package m

type Point struct {
	X int
	Y *Point
}

type Celsius float64

func f(p Point, q *Point, c Celsius, n int) {
	_ = p.X
	_ = q.Y
	_ = p.Z
	_ = c.V
	_ = n.W
	v := p
	_ = v.X
}
'''


def test_member_resolution(spark):
    from tessera.operators.gosrc import go_members
    df = spark.createDataFrame([(3, MEMBERS)], "doc_id long, text string")
    a = go_tokens(df)
    got = {r.member: (r.owner, r.status, r.msg) for r in go_members(a, spark).collect()}
    assert got["X"][1] in ("found", "unknown")          # p.X found, v.X unknown
    assert got["Y"] == ("Point", "found", None)
    assert got["Z"] == ("Point", "no_member", None)
    assert got["V"] == ("Celsius", "struct_required", "struct type required instead of 'float64'")
    assert got["W"] == ("int", "struct_required", "struct type required instead of 'int'")
    statuses = sorted((r.member, r.status) for r in go_members(a, spark).collect())
    assert ("X", "found") in statuses and ("X", "unknown") in statuses
    d = {r.msg for r in go_diagnostics(a, spark).collect()}
    assert d == {"struct type required instead of 'float64'", "struct type required instead of 'int'"}


POINTERS = '''package k

func g(a, b int, p *int) int {
	x := *p
	y := *a
	return x + y + b
}

func h(int, string) {}
'''


def test_param_lists_and_pointer_check(spark):
    df = spark.createDataFrame([(4, POINTERS)], "doc_id long, text string")
    a = go_tokens(df)
    d = {r.name: r.kind for r in go_items(a).filter("is_decl").collect()}
    assert d["a"] == "VAR" and d["b"] == "VAR" and d["p"] == "VAR"
    assert "int" not in d and "string" not in d          # unnamed parameters declare nothing
    r = {x.name: x.tier for x in go_resolve(a, spark).collect()}
    assert r["b"] == 0                                   # b from 'a, b int' resolves locally
    msgs = [(x.msg, POINTERS.encode()[x.beg:x.end].decode()) for x in go_diagnostics(a, spark).collect()]
    assert msgs == [("pointer type required", "*a")]


def test_package_tier(spark):
    a_go = "package q\n\ntype Shared struct{}\n\nfunc Helper() int { return 1 }\n"
    b_go = "package q\n\nvar s Shared\n\nfunc use() int { return Helper() + len(\"x\") }\n"
    c_go = "package other\n\nvar t Shared\n"
    files = spark.createDataFrame([("q/a.go", "q", a_go), ("q/b.go", "q", b_go), ("o/c.go", "o", c_go)],
                                  "doc_id string, dir string, text string")
    a = go_tokens(files, package="dir")
    r = {(x.doc_id, x.name): (x.tier, x.decl_doc) for x in go_resolve(a, spark).collect()}
    assert r[("q/b.go", "Shared")] == (2, "q/a.go")
    assert r[("q/b.go", "Helper")] == (2, "q/a.go")
    assert r[("q/b.go", "len")] == (3, None)
    assert r[("o/c.go", "Shared")] == (None, None)      # other package: not visible
    d = {(x.doc_id, x.msg) for x in go_diagnostics(a, spark).collect()}
    assert d == {("o/c.go", "type `Shared' undefined")}


SWITCH = '''package w

type Known struct{ V int }

func f(x interface{}) {
	switch y := x.(type) {
	case Known, Nope:
		_ = y
	}
	m := make(Missing)
	k := Known{}
	_ = k.V
	_ = m
}
'''


def test_type_switch_make_and_member_classes(spark):
    df = spark.createDataFrame([(5, SWITCH)], "doc_id long, text string")
    a = go_tokens(df)
    d = {x.msg for x in go_diagnostics(a, spark).collect()}
    assert d == {"type `Nope' undefined", "type `Missing' undefined"}
    f = {(x.tok, x.beg): x.cls for x in go_fontify(a, spark).collect()}
    v = SWITCH.encode().index(b"k.V") + 2
    assert f[("V", v)] == "Var"                    # k's type unknown (:=): open scope, Var
    assert f[("Known", SWITCH.encode().index(b"case Known") + 5)] == "Type"


LITERALS = '''package l

func outer() {
	add := func(x int, y *int) int {
		return x + *y
	}
Loop:
	for i := 0; i < 3; i++ {
		if i > 1 {
			break Loop
		}
	}
	_ = add
	_ = x
}
'''


def test_function_literal_params_and_labels(spark):
    df = spark.createDataFrame([(6, LITERALS)], "doc_id long, text string")
    a = go_tokens(df)
    d = {(x.name, x.kind) for x in go_items(a).filter("is_decl").collect()}
    assert ("x", "VAR") in d and ("y", "VAR") in d
    r = {x.beg: x.tier for x in go_resolve(a, spark).collect()}
    b = LITERALS.encode()
    assert r[b.index(b"x + *y")] == 0                     # literal parameter, local
    assert r[b.index(b"_ = x") + 4] is None               # not visible after the literal's body
    assert go_diagnostics(a, spark).count() == 0          # *y is a pointer; labels not checked
    f = {(x.tok, x.beg): x.cls for x in go_fontify(a, spark).collect()}
    assert f[("Loop", b.index(b"Loop:"))] == "Type" and f[("Loop", b.index(b"break Loop") + 6)] == "Type"


def test_members_across_package_files(spark):
    from tessera.operators.gosrc import go_members
    t_go = "package z\n\ntype Rec struct {\n\tName string\n}\n\nvar Global Rec\n"
    u_go = "package z\n\nfunc g(r *Rec) {\n\t_ = r.Name\n\t_ = r.Age\n\t_ = Global.Name\n}\n"
    files = spark.createDataFrame([("z/t.go", "z", t_go), ("z/u.go", "z", u_go)],
                                  "doc_id string, dir string, text string")
    a = go_tokens(files, package="dir")
    got = sorted((x.doc_id, x.member, x.status) for x in go_members(a, spark).collect())
    assert got == [("z/u.go", "Age", "no_member"), ("z/u.go", "Name", "found"),
                   ("z/u.go", "Name", "found")]


BAD = '''package b

import "ok/path"
import "bad
path"

type S struct{ f int }

func h() {
	var s S
	s.f := 1
	x := 2
	_ = x
}
'''


def test_ident_required_and_invalid_path(spark):
    df = spark.createDataFrame([(7, BAD)], "doc_id long, text string")
    a = go_tokens(df)
    got = {(x.msg, BAD.encode()[x.beg:x.end].decode()) for x in go_diagnostics(a, spark).collect()}
    assert ("ident node required", "f") in got
    assert not any(m == "ident node required" and t == "x" for m, t in got)
    assert ("invalid path syntax", '"') in got          # the unterminated literal's quote


def test_tokens_are_sorted_few_times_and_narrow(spark):
    files = spark.createDataFrame([(1, "package p\n")], "doc_id long, text string")
    plan = go_items(go_tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 12  # one for each order of the tokens
    assert not {"partner_beg", "partner_tag", "level", "scope_tag"} & set(go_tokens(files).columns)


def test_farther_neighbours_are_not_carried(spark):
    files = spark.createDataFrame([(1, "package p\n")], "doc_id long, text string")
    a = go_tokens(files)
    assert not {f"{s}{j}" for s in "pn" for j in range(2, 6)} & set(a.columns)
    plan = go_items(a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 11  # the next break of a name list needs no order of its own


def test_member_joins_are_not_broadcast(spark):
    from tessera.operators.gosrc import go_members
    files = spark.createDataFrame([(1, "package p\n")], "doc_id long, text string")
    a = go_tokens(files)
    plan = go_members(a, spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 1  # the fixed table of builtins


def test_queries_run_compiled_methods(spark):
    import __spark_entry__ as E
    from conftest import SF001
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        E.queries()["go_decls"](spark, SF001)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_stored_tokens_hold_their_items(spark):
    from tessera.operators.gosrc import stored_tokens
    files = spark.createDataFrame([(1, BAD), (2, "package p\n\nvar a, b = 1, 2\n")], "doc_id long, text string")
    a = go_tokens(files)
    once = stored_tokens(a)
    assert not {"q", "_body", "_header_end", "run_type"} & set(once.columns)
    plan = go_items(once)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "parquet" in plan
    assert sorted(map(str, go_items(once).collect())) == sorted(map(str, go_items(a).collect()))


def test_partitions_follow_the_texts(spark, monkeypatch):
    from tessera.operators import gosrc
    files = spark.createDataFrame([(k, "package p\n" * 10) for k in range(50)], "doc_id long, text string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert gosrc.text_parts(files) == least
    monkeypatch.setattr(gosrc, "PART_BYTES", 100)
    assert gosrc.text_parts(files) == 50
    assert go_tokens(files, parts=50).rdd.getNumPartitions() == 50
