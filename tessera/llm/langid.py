"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a page: its text (byte trigrams against a model per
language), the language its markup declares, its address suffix and its host.  The
declared language enters by P(declared | language), estimated over all pages.  Suffix,
domain and host give the prior: each level's share of languages is smoothed towards the
level above (all pages, suffix, domain, host), with the page's own share left out.  All
these counts are sums of text posteriors per group: mergeable, so a hot host is cheap.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, salted_join

BUCKETS = 8192
#: Trigrams overlap and are not independent: this many count as one observation.
TEMPER = 6.0
#: Pages of the level above that a level's own counts are mixed with.
STRENGTH = 4.0
_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>|&#?\w+;")
#: The same where no ``>`` follows (like the first, it leaves a line feed at the very end).
_HIDDEN_AT_END = re.compile(rb"(?is)<(?:script|style)\b.*?$|<!--.*?$|&#?\w+;")
_DECLARED = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def trigrams(data: bytes) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased words, white space made one space."""
    a = np.frombuffer(b" " + b" ".join(data.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    return ((a[:-2] * np.uint32(65599 * 65599 % 2**32) + a[1:-1] * np.uint32(65599) + a[2:])
            * np.uint32(2654435761) >> np.uint32(19)).astype(np.int64)


def visible(html: bytes) -> bytes:
    """The text of a page: without scripts, styles, comments, tags and entities.  A ``<`` that no
    ``>`` follows is text; with one put at the end, each search stops at the first of them."""
    out, at = [], 0
    for m in _HIDDEN.finditer(html + b">"):
        if m.end() > len(html):
            return b" ".join([*out, _HIDDEN_AT_END.sub(b" ", html[at:])])
        out.append(html[at:m.start()])
        at = m.end()
    return b" ".join([*out, html[at:]])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)) from all rows with a language.

    Each task adds up one count vector per language; Spark sums them.  The result has one
    number per language and bucket, whatever the data."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                grams = trigrams(t or b"")
                for i in range(0, len(grams), 1 << 20):
                    v += np.bincount(grams[i:i + (1 << 20)], minlength=BUCKETS)
        rows = [(k, int(i), int(v[i])) for k, v in counts.items() for i in np.nonzero(v)[0]]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()))],
            names=["lang", "bucket", "n"])
    src = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary"))
    got = src.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in got["lang"]], got["bucket"]] = got["n"]
    counts += 0.5
    return langs, np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))


def log_likelihood(html: bytes, model: np.ndarray) -> list[float]:
    """Tempered log likelihood of the page's text per language, the best at 0."""
    grams = trigrams(visible(html))
    ll = model[:, grams].sum(axis=1) / TEMPER if len(grams) else np.zeros(len(model))
    return (ll - ll.max()).tolist() if len(ll) else []


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _HOST, 1))


def _softmax(ll: Column) -> Column:
    e = F.transform(F.transform(ll, lambda x: x - F.array_max(ll)), F.exp)
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _plus(a: Column, b: Column, sign: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def _sums(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """(key, name): per group the summed text posteriors."""
    return rows.groupBy(key).agg(F.array(*[F.sum(F.col("post")[i]) for i in range(n)]).alias(name))


def _share(own: Column, above: Column) -> Column:
    """Shares of the languages in a level without the page, smoothed towards ``above``."""
    total = F.aggregate(own, F.lit(STRENGTH), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    return F.zip_with(own, above, lambda x, p: (F.greatest(x, F.lit(0.0)) + STRENGTH * p) / total)


def identify(spark: SparkSession, pages: DataFrame, docs: DataFrame, id_col: str = "page_id",
             url_col: str = "url", html_col: str = "html", lang_col: str = "lang",
             text_col: str = "text") -> DataFrame:
    """Per page: id, host, suffix, declared, text_lang, lang, prob.

    ``docs`` with a language teach the text model.  A page without text, url or declaration
    lacks that piece of evidence (empty strings); ties go to the first language by code
    point; repeated rows each return and count; without labelled documents lang and prob
    are null; an empty table returns no rows.  Other columns are ignored."""
    langs, model = fit(docs, lang_col, text_col)
    n = len(langs)
    host = host_of(F.col(url_col))
    src = pages.select(
        F.col(id_col).alias("_id"), host.alias("host"),
        F.lower(F.regexp_extract(F.coalesce(F.col(html_col).cast("string"), F.lit("")), _DECLARED, 1))
        .alias("declared"), F.col(html_col).alias("_t"))
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers
    scored = map_texts(src, ["_id", "host", "declared"], "_t",
                       lambda t: (log_likelihood(t, shared.value),), "ll array<double>",
                       [pa.list_(pa.float64())])
    if not n:
        return scored.select(F.col("_id").alias(id_col), "host", F.substring_index("host", ".", -1)
                             .alias("suffix"), "declared", F.lit(None).cast("string").alias("text_lang"),
                             F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"))
    rows = materialize(spark, scored.withColumn("post", _softmax(F.col("ll"))).withColumn(
        "suffix", F.substring_index("host", ".", -1)).withColumn(
        "domain", F.substring_index("host", ".", -2)), "pages")
    flat = F.array(*[F.lit(1.0 / n)] * n)
    # Sums of the levels; a host belongs to one domain and a domain to one suffix.
    hosts = _sums(rows, "host", n, "host_sum").withColumn("suffix", F.substring_index("host", ".", -1)) \
        .withColumn("domain", F.substring_index("host", ".", -2))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("host_sum")[i]) for i in range(n)])
                                          .alias("domain_sum"))
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.col("host_sum")[i]) for i in range(n)])
                                           .alias("suffix_sum"))
    levels = materialize(spark, salted_join(salted_join(hosts, suffixes, ["suffix"], "inner", ["host"]),
                                            domains, ["domain"], "inner", ["host"])
                         .select("host", "host_sum", "domain_sum", "suffix_sum"), "hosts")
    declared = materialize(spark, _sums(rows, "declared", n, "declared_sum"), "declared")
    whole = declared.agg(*[F.sum(F.col("declared_sum")[i]).alias(f"s{i}") for i in range(n)],
                         F.count("*").alias("k")).first()  # one number per language
    total = F.array(*[F.lit(float(whole[f"s{i}"] or 0)) for i in range(n)])
    joined = salted_join(salted_join(rows, levels, ["host"], "inner", ["_id"]),
                         declared, ["declared"], "inner", ["_id"])
    post = F.col("post")
    above = _share(_plus(total, post, -1.0), flat)
    for level in ("suffix_sum", "domain_sum", "host_sum"):
        joined = joined.withColumn("prior", _share(_plus(F.col(level), post, -1.0), above))
        above = F.col("prior")
    # P(declared | language) without the page; a declaration seen nowhere else says nothing.
    said = F.zip_with(_plus(F.col("declared_sum"), post, -1.0), _plus(total, post, -1.0),
                      lambda d, t: (F.greatest(d, F.lit(0.0)) + 1.0 / max(1, whole["k"] or 1))
                      / (F.greatest(t, F.lit(0.0)) + 1.0))
    fused = F.zip_with(F.zip_with(F.col("ll"), F.col("prior"), lambda a, p: a + F.log(p)), said,
                       lambda a, p: a + F.log(p))
    names = F.array(*[F.lit(x) for x in langs])

    def best(v: Column) -> Column:
        return F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    out = joined.withColumn("fused", _softmax(fused))
    return out.select(F.col("_id").alias(id_col), "host", "suffix", "declared",
                      best(F.col("post")).alias("text_lang"), best(F.col("fused")).alias("lang"),
                      F.array_max("fused").alias("prob"))
