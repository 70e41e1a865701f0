"""Plan shape: the per-document chain shuffles once, offsets-free counting
does not shuffle by document, and the scan reads only needed columns."""

import re

from conftest import SF001
from tessera.operators.resolve import resolve_refs
from tessera.plans import documents as D
from tessera.plans import pages as P


def _plan(spark, df):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_resolution_chain_shuffles_once_by_page(spark):
    df = resolve_refs(P.page_items(spark, SF001), "page_id")
    plan = _plan(spark, df)
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)", plan)
    by_page = [e for e in exchanges if e[0] == "hashpartitioning" and e[1].startswith("page_id")]
    assert len(by_page) == 1, plan
    assert len([e for e in exchanges if e[0] == "hashpartitioning"]) == 1, plan
    assert plan.count("Window") >= 5


def test_counting_query_has_no_offset_window(spark):
    plan = _plan(spark, D.class_histogram(spark, SF001))
    assert "Window" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_bucketed_corpus_needs_no_shuffle(spark):
    from pyspark.sql import functions as F

    from tessera.functions import rules
    from tessera.operators.tokens import tokenize
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    (docs.write.mode("overwrite").bucketBy(4, "doc_id").sortBy("doc_id")
     .saveAsTable("docs_bucketed"))
    bucketed = spark.table("docs_bucketed")
    t = tokenize(bucketed, "doc_id", "text", rules.TEXT_TOKEN_RX, prepartitioned=True)
    plan = _plan(spark, t)
    assert "Exchange" not in plan, plan
    agg = lambda df: df.agg(F.count(F.lit(1)), F.sum("beg"), F.sum("end")).first()
    assert agg(t) == agg(tokenize(docs, "doc_id", "text", rules.TEXT_TOKEN_RX))


def test_bucketed_pages_resolution_chain_has_no_shuffle(spark):
    from tessera.functions import rules
    from tessera.operators.tokens import tokenize
    pages = spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "html")
    from tessera.sources.tables import write_corpus_bucketed
    stored = write_corpus_bucketed(pages, "pages_bucketed", "page_id", 4)
    t = tokenize(stored, "page_id", "html", rules.HTML_TOKEN_RX, prepartitioned=True)
    r = resolve_refs(P.html_items(P.annotate_html(t)), "page_id")
    plan = _plan(spark, r)
    assert "Exchange" not in plan, plan          # tokens, scopes and the sweep share the buckets
    assert r.count() == resolve_refs(P.page_items(spark, SF001), "page_id").count()


def test_usages_reads_and_splits_the_texts_once(spark):
    import __spark_entry__ as entry
    df = entry.queries()["usages"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("posexplode(regexp_extract_all") == 1 and "ReusedExchange" in plan
