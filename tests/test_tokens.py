"""X1/W1 tiling and byte offsets; interning invariants."""

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import index as IX
from tessera.operators.tokens import tokenize


def test_multibyte_offsets(spark):
    df = spark.createDataFrame([(1, "é x😀y")], "doc_id long, text string")
    t = tokenize(df, "doc_id", "text", rules.TEXT_TOKEN_RX).orderBy("i").collect()
    assert [(r.tok, r.beg, r.end) for r in t] == [
        ("é", 0, 2), (" ", 2, 3), ("x", 3, 4), ("😀", 4, 8), ("y", 8, 9)]


def test_tokens_tile_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = tokenize(docs, "doc_id", "text", rules.TEXT_TOKEN_RX)
    per = t.groupBy("doc_id").agg(F.max("end").alias("n"), F.count(F.lit(1)).alias("k"),
                                  F.sum(F.octet_length("tok")).alias("s"))
    j = per.join(docs.select("doc_id", F.octet_length("text").alias("size")), "doc_id")
    assert j.filter((F.col("n") != F.col("size")) | (F.col("s") != F.col("size"))).count() == 0
    assert j.count() == docs.count()


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenize(df, "doc_id", "text", rules.TEXT_TOKEN_RX).count() == 0


def test_intern_is_bijection(spark):
    words = "b a c a b d e a".split()
    df = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "doc_id long, i long, name string")
    out = {r.name: r.no for r in IX.intern(df, "name", ["doc_id", "i"]).collect()}
    assert out == {"b": 1, "a": 2, "c": 3, "d": 4, "e": 5}


def test_name_bucket_matches_full_hash(spark):
    names = ["a", "Zeta", "x" * 80, "héllo"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.b for r in df.select("name", IX.name_bucket(F.col("name")).alias("b")).collect()}
    for n in names:
        h = 0
        for b in n.encode():
            h = (h * 2 + b) % (1 << 64)
        assert got[n] == h % 65536
