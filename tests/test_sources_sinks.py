"""S1 corpus scan, S4 command source, S5 blocks, S6 tee, T4 routing, V1 UDTF, L3."""

import os

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators.gosrc import go_diagnostics, go_file_env, go_tokens
from tessera.operators.spans import LongestSpan
from tessera.operators.tokens import tokenize
from tessera.sources.catalog import scan_corpus
from tessera.sources.commands import parse_commands, read_commands
from tessera.sources.sinks import block_lines, errors_lines, message_text, tee_batch, write_blocks
from tessera.streaming.routes import command_rules, route_batch, validate_commands

GO_A = 'package p\n\ntype T struct {\n\tX int\n}\n\nfunc f() {\n\tvar v Missing\n\t_ = v\n}\n'
GO_B = 'package p\n\nvar top = 1\n'


def _tree(root):
    os.makedirs(os.path.join(root, "src", "p"), exist_ok=True)
    with open(os.path.join(root, "src", "p", "a.go"), "w") as f:
        f.write(GO_A)
    with open(os.path.join(root, "src", "p", "b.go"), "w") as f:
        f.write(GO_B)
    with open(os.path.join(root, "src", "p", "notes.txt"), "w") as f:
        f.write("not go")


def test_scan_corpus_and_analyze(spark, scratch):
    _tree(scratch)
    files = scan_corpus(spark, scratch)
    rows = {r.name: r for r in files.collect()}
    assert set(rows) == {"a.go", "b.go"}
    assert rows["a.go"].dir.endswith("/src/p")
    a = go_tokens(files.withColumnRenamed("path", "doc_id"), "doc_id", "text")
    d = {(os.path.basename(r.doc_id), r.msg) for r in go_diagnostics(a, spark).collect()}
    assert d == {("a.go", "type `Missing' undefined")}
    env = [(r.name, r.kind) for r in go_file_env(a).filter(F.col("doc_id").endswith("a.go")).collect()]
    assert env == [("p", "PACKAGE"), ("T", "TYPE"), ("f", "FUNC")]


def test_command_source_skips_blank_and_comments(spark, scratch):
    path = os.path.join(scratch, "cmds.txt")
    with open(path, "w") as f:
        f.write('go-root /\n\n   \n# comment\ngo-path "/home/x y"\nanalyze -n 9 "/a/b.go\n')
    c = parse_commands(read_commands(spark, path))
    got = [(r.name, r.no, list(r.args)) for r in c.collect()]
    assert got == [("go-root", 0, ["/"]), ("go-path", 0, ["/home/x y"]),
                   ("analyze", 9, ["/a/b.go"])]
    v = {r.name: r.status for r in validate_commands(c, command_rules(spark)).collect()}
    assert v == {"go-root": "ok", "go-path": "ok", "analyze": "ok"}


def test_route_batch(spark):
    c = parse_commands(spark.createDataFrame([("a x",), ("b y z",), ("a w",)], "line string"))
    seen = {}
    route_batch(c, {"a": lambda df: seen.__setitem__("a", df.count()),
                    "b": lambda df: seen.__setitem__("b", df.count())})
    assert seen == {"a": 2, "b": 1}


def test_blocks_and_sinks(spark, scratch):
    files = spark.createDataFrame([("s1", "z"), ("s1", "a"), ("s2", "m")], "src string, name string")
    lines = block_lines(files, "src", "name", "FILES", [F.lit('"non-system"')],
                        lambda c: F.concat(F.lit("  "), c))
    got = [(r.src, r.line_no, r.line) for r in lines.orderBy("src", "line_no").collect()]
    assert got[:5] == [("s1", 0, 'FILES "non-system"'), ("s1", 1, "  a"), ("s1", 2, "  z"),
                       ("s1", 3, "FILES-END"), ("s1", 4, "")]
    out = os.path.join(scratch, "blocks")
    write_blocks(lines, "src", out)
    assert {"src=s1", "src=s2"} <= set(os.listdir(out))
    diags = spark.createDataFrame([("f.go", "ERROR", 3, 4, "bad é")],
                                  "fname string, lvl string, beg long, end long, msg string")
    e = [r.line for r in errors_lines(diags, "fname").orderBy("line_no").collect()]
    assert e == ['ERRORS "f.go" 0', '  ERROR 3 4 "bad \\u00e9"', "ERRORS-END", ""]
    m = spark.range(1).select(message_text(F.lit("3 dirs found")).alias("m")).first().m
    assert m == 'MESSAGE "3 dirs found"\nMESSAGE-END\n\n'
    batch = spark.createDataFrame([("go-root /",)], "line string")
    tee_batch(batch, os.path.join(scratch, "in"), os.path.join(scratch, "out"),
              lambda b: b.select(F.upper("line").alias("value")))
    assert spark.read.text(os.path.join(scratch, "out")).first().value == "GO-ROOT /"


def test_udtf_span_processor(spark):
    spark.udtf.register("longest_span", LongestSpan)
    df = spark.createDataFrame([(1, "ab abcd x"), (2, "xyz uvw")], "doc_id long, text string")
    tokenize(df, "doc_id", "text", rules.TEXT_TOKEN_RX).createOrReplaceTempView("toks")
    got = {tuple(r) for r in spark.sql(
        "SELECT * FROM longest_span(TABLE(SELECT doc_id, i, tok FROM toks) PARTITION BY doc_id)").collect()}
    assert got == {(1, 2, "abcd", 4), (2, 0, "xyz", 3)}


def test_fontify_complete_usages_blocks(spark):
    from tessera.sources.sinks import complete_lines, fontify_lines, usages_lines
    spans = spark.createDataFrame([("f.go", "Keyword", 0, 7), ("f.go", "Var", 8, 9)],
                                  "fname string, cls string, beg long, end long")
    f = [r.line for r in fontify_lines(spans, "fname", F.lit(12)).orderBy("line_no").collect()]
    assert f == ['FONTIFY "f.go" "f.go" 0 0 12', "  Keyword 0 7", "  Var 8 9", "FONTIFY-END", ""]
    ch = spark.createDataFrame([(1, "VAR", "count", 5, 10), (1, "TYPE", "Count", 5, 10), (1, "XX", "c", 5, 6)],
                               "cur long, kind string, choice string, cbeg long, cend long")
    c = [r.line for r in complete_lines(ch, "cur", F.lit("co"), F.lit(5), F.lit(7), F.lit("co"))
         .orderBy("line_no").collect()]
    assert c[0] == 'COMPLETE "co" 5 7 "co"'
    assert sorted(c[1:4]) == ['  ??? "c" "c" 5 6', '  TYPE "Count" "Count" 5 10', '  VAR "count" "count" 5 10']
    assert c[4:] == ["COMPLETE-END", ""]
    us = spark.createDataFrame([("g", "def", "a/b.go", "zeta"), ("g", "ref", "a/c.go", "alpha")],
                               "grp string, role string, fname string, name string")
    u = [r.line for r in usages_lines(us, "grp", "ref", "al", False).orderBy("line_no").collect()]
    assert u[0] == 'USAGES ref "al" non-system'
    assert u[1] == 'ref "a/c.go" 0 0 0 "" 0 0 "alpha" 0 0 norecursive'
    assert u[2].startswith('def "a/b.go"') and u[2].endswith('"zeta" 0 0 norecursive')
