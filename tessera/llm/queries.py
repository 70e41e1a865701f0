"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import table

from . import audit, brown, decontam, fim, gbdt, langid, mixing, pii, quality, secrets, sharding, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@query("op1_warc", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hx FROM p),
     m AS (SELECT hx, min(page_id) AS head FROM d GROUP BY hx)
SELECT d.page_id, d.payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(d.hx, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INT,
           1)), '') AS payload_digest,
       CASE WHEN m.head IS DISTINCT FROM d.page_id AND m.head IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.head IS DISTINCT FROM d.page_id THEN m.head END AS refers_to
FROM d JOIN m USING (hx)
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back, verified."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/warc"
    records = warc.read_warc(spark, warc.write_warc(spark, table(spark, sf_dir, "pages"), path))
    return records.select(
        warc.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", warc.page_number(F.col("refers_to")).alias("refers_to"))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query("op4_classifier")
def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gbdt.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_langid")
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the labelled documents teach the text model."""
    return langid.identify(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(spark, table(spark, sf_dir, "documents"), shards=40)


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(spark, table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


@query("op8_brown")
def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(spark, table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that leaks a benchmark item, and item."""
    return decontam.find_leaks(spark, table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"))


@query("op10_mixing", sql=r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS k,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix' || coalesce(':' || doc_id::VARCHAR, '')) AS h FROM documents),
     s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
     w AS (SELECT *, ([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY k = '', k) - 1) % 3 + 1])::DOUBLE AS w,
                  2.0::DOUBLE * source_size AS cap FROM s),
     l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
                  ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                  AS level FROM w),
     t AS (SELECT k, source_size, CASE WHEN cap <= level * w THEN cap ELSE w * (
                  SELECT x.level FROM l x WHERE x.cap > x.level * x.w ORDER BY x.cap / x.w, x.k LIMIT 1)
                  END AS target FROM l),
     p AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT
                  AS whole FROM t)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size,
           round(target)::BIGINT - whole * source_size - coalesce(sum(size) OVER (PARTITION BY k
           ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT
       AS taken
FROM d JOIN p USING (k)
""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(spark, table(spark, sf_dir, "documents"), weights=(3, 1, 2),
                             budget=1.5, max_epochs=2)


@query("op11_filter_audit", sql=r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     h AS (SELECT t, min(doc_id) AS head FROM d GROUP BY t),
     f AS (SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END)
                | (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
                | (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
                | (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
                | (CASE WHEN head < doc_id THEN 16 ELSE 0 END) AS fails
           FROM d JOIN h USING (t)),
     l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     g AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
           FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
     c AS (SELECT i, substr('ABCDE', i + 1, 1) AS c FROM range(5) x(i)),
     o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ix
           FROM c a, c b, c c, c d, c e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
     s AS (SELECT filter_order, step::INT AS step, (1 << ix[step])::INT AS own,
                  coalesce(list_sum(list_transform(ix[1:step - 1], lambda i: 1 << i)), 0)::INT AS before
           FROM o, range(1, 6) y(step)),
     e AS (SELECT part, filter_order, step, own, n, good, toxic, fails = own AS alone,
                  fails & own <> 0 AS failing, fails & before <> 0 AS earlier FROM g, s),
     r AS (SELECT part, own, sum(n) AS shapley FROM e WHERE failing AND NOT earlier GROUP BY part, own)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (failing AND NOT earlier), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (failing AND earlier), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (failing AND NOT earlier), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (failing AND NOT earlier), 0)::BIGINT AS toxic_lost,
       coalesce(max(shapley), 0)::BIGINT AS shapley
FROM e LEFT JOIN r USING (part, own) GROUP BY part, filter_order, step
""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, per language."""
    return audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(spark, table(spark, sf_dir, "documents"))


@query("op13_fill_in_middle", sql=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hx FROM documents),
     u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
                  ('0x' || substr(hx, 1, 8))::BIGINT AS h1, ('0x' || substr(hx, 9, 8))::BIGINT AS h2,
                  ('0x' || substr(hx, 17, 8))::BIGINT AS h3, ('0x' || substr(hx, 25, 8))::BIGINT AS h4
           FROM d),
     c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo,
                  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi FROM u),
     p AS (SELECT *, array_to_string(units[1:lo], '') AS head, array_to_string(units[lo + 1:hi], '') AS mid,
                  array_to_string(units[hi + 1:n], '') AS tail,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                            OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
              ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))
