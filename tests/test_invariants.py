"""Invariants on the driver fixtures (sf0.001) and the streaming command path."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from tessera.plans import edits as ED
from tessera.plans import pages as P
from tessera.sources.commands import parse_commands, read_commands
from tessera.streaming.routes import route_stream


def test_scopes_nest_or_are_disjoint(spark):
    s = P.scopes_q(spark, SF001).collect()
    by_page = {}
    for r in s:
        by_page.setdefault(r.page_id, []).append(r)
    for rows in by_page.values():
        for a in rows:
            assert a.end is not None and a.beg < a.end
            for b in rows:
                if a.scope_i < b.scope_i:
                    nested = a.beg < b.beg and b.end <= a.end
                    disjoint = a.end <= b.beg
                    assert nested or disjoint
                    if nested and b.depth == a.depth + 1 and b.parent_i is not None:
                        # the parent is the innermost enclosing scope
                        assert b.parent_i >= a.scope_i


def test_each_reference_resolves_at_most_once(spark):
    r = P.resolve_refs_q(spark, SF001)
    assert r.groupBy("page_id", "i").count().filter("count > 1").count() == 0
    refs = P.page_items(spark, SF001).filter("is_ref").count()
    assert r.count() == refs


def test_splice_length_arithmetic(spark):
    c = spark.read.parquet(f"{SF001}/conversations.parquet")
    n = F.octet_length("text")
    beg = (F.col("conv_id") * 7) % (n + 1)
    cut = F.least(beg + F.col("turn"), n) - beg
    want = c.select("conv_id", "turn", (n - cut + 2).cast("bigint").alias("want"))
    got = ED.splice_q(spark, SF001).join(want, ["conv_id", "turn"])
    assert got.filter(F.col("n_bytes") != F.col("want")).count() == 0
    assert got.count() == c.count()


def test_command_stream_routes(spark, scratch):
    src = os.path.join(scratch, "cmds")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("go-root /\n# skip\nanalyze -n 3 a.go\n")
    with open(os.path.join(src, "b.txt"), "w") as f:
        f.write("analyze b.go\n\ncomplete a.go 10\n")
    out = os.path.join(scratch, "routes")

    def sink(name):
        return lambda df: df.select("name", F.array_join("args", " ").alias("args")).write.mode(
            "append").parquet(os.path.join(out, name))

    cmds = parse_commands(read_commands(spark, src, stream=True))
    q = route_stream(cmds, {"analyze": sink("analyze"), "complete": sink("complete")},
                     os.path.join(scratch, "ck"), {"availableNow": True})
    q.awaitTermination()
    got = sorted(r.args for r in spark.read.parquet(os.path.join(out, "analyze")).collect())
    assert got == ["a.go", "b.go"]
    assert spark.read.parquet(os.path.join(out, "complete")).count() == 1
