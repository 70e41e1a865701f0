"""Corpus queries over the ``documents`` table.

Binding: a document is a file with dir = ``source/lang`` and name = ``doc_id``
(path ``source/lang/doc_id``); it is tiled by the generic text pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import index as IX
from ..operators.spans import longest_token, process_spans
from ..operators.tokens import classify, is_ident, tokenize
from ..sources.catalog import file_table, lookup_source, packages
from ..sources.sinks import block_lines
from ..sources.tables import table
from .registry import query, sql_str
from .sqlparts import byte_fold_sql, tokens_cte

RX = rules.TEXT_TOKEN_RX
KEEP = ["source", "lang"]


def doc_tokens(spark, sf_dir, offsets: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenize(docs, "doc_id", "text", RX, keep=KEEP, offsets=offsets)


def idents(spark, sf_dir, offsets: bool = True) -> DataFrame:
    return doc_tokens(spark, sf_dir, offsets).filter(is_ident(F.col("tok"))).withColumnRenamed(
        "tok", "name")


def fname_col() -> F.Column:
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


TOK = tokens_cte("tk", "documents", "doc_id", "text", RX, KEEP)
IDENT_SQL = r"regexp_matches(tok, '^[\p{L}_]')"
KW_SQL = ", ".join(sql_str(k) for k in rules.GO_KEYWORDS)
CLS_SQL = rf"""CASE WHEN regexp_full_match(tok, '[ \t\r\n\f]+') THEN NULL
     WHEN tok IN ({KW_SQL}) THEN 'Keyword'
     WHEN regexp_matches(tok, '^[\p{{L}}_]') THEN 'Var'
     WHEN regexp_matches(tok, '^[0-9]') THEN 'Number'
     WHEN starts_with(tok, '"') AND strlen(tok) > 1 THEN 'String'
     WHEN regexp_full_match(tok, '[.,;:]') THEN 'Separator'
     WHEN regexp_full_match(tok, '[-+*/%&|^<>=!~]') THEN 'Operator'
     ELSE 'Token' END"""
LIT_SQL = r"""CASE WHEN starts_with(tok, '"') AND strlen(tok) > 1 THEN 'string'
     WHEN regexp_full_match(tok, '[0-9]+') THEN 'int'
     WHEN regexp_full_match(tok, '[0-9]+\.[0-9]+') THEN 'float64' END"""
FNAME_SQL = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR)"


# ------------------------------------------------------------------ flagship
def flagship(spark, sf_dir) -> DataFrame:
    """Tokens -> first occurrence per (source, name) is the definition, the
    rest references -> references per exported symbol, top 20."""
    occ = idents(spark, sf_dir).filter(T.is_exported(F.col("name")))
    path = F.concat_ws(".", "source", "name")
    idx = IX.symbol_index(occ, path, fname_col(), F.col("beg"), ["doc_id", "i"], "doc_id")
    return idx.orderBy(F.desc("n_refs"), "path").limit(20)


# -------------------------------------------------------------------- tokens
@query("tokens", sql=f"""
WITH {TOK}
SELECT t.doc_id, CAST(count(*) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN {IDENT_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS n_words,
       CAST(sum(t.beg) AS BIGINT) AS sum_beg, CAST(max(t."end") AS BIGINT) AS n_bytes,
       max(t."end") = max(strlen(d.text)) AS tiled
FROM tk t JOIN documents d ON d.doc_id = t.doc_id
GROUP BY t.doc_id
""")
def tokens_q(spark, sf_dir):
    """X1 + W1: per document, token count, word count, offsets and tiling check."""
    docs = table(spark, sf_dir, "documents").withColumn("_size", F.octet_length("text"))
    t = tokenize(docs, "doc_id", "text", RX, keep=["_size"])
    per = t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(is_ident(F.col("tok")).cast("bigint")).alias("n_words"),
        F.sum("beg").alias("sum_beg"), F.max("end").alias("n_bytes"), F.max("_size").alias("_size"))
    return per.select(
        "doc_id", "n_tokens", "n_words", "sum_beg", "n_bytes",
        (F.col("n_bytes") == F.col("_size")).alias("tiled"))


# ------------------------------------------------------------ class_histogram
@query("class_histogram", sql=f"""
WITH {TOK}
SELECT {CLS_SQL} AS cls, {LIT_SQL} AS lit_type, CAST(count(*) AS BIGINT) AS n_tokens,
       CAST(sum(strlen(tok)) AS BIGINT) AS n_bytes
FROM tk GROUP BY ALL
""")
def class_histogram(spark, sf_dir):
    """X2 + F10: tokens and bytes per highlight class and literal type."""
    t = classify(doc_tokens(spark, sf_dir, offsets=False))
    return t.groupBy("cls", "lit_type").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(F.octet_length("tok")).alias("n_bytes"))


# ------------------------------------------------------------------- fontify
@query("fontify", sql=f"""
WITH {TOK}, c AS (SELECT doc_id, {CLS_SQL} AS cls, beg, "end" FROM tk)
SELECT doc_id, cls, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(beg) AS BIGINT) AS sum_beg,
       CAST(sum("end") AS BIGINT) AS sum_end
FROM c WHERE cls IS NOT NULL GROUP BY doc_id, cls
""")
def fontify(spark, sf_dir):
    """All highlight markers of a file, per class: spans, sum of begins and ends."""
    t = classify(doc_tokens(spark, sf_dir)).filter(F.col("cls").isNotNull())
    return t.groupBy("doc_id", "cls").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum("beg").alias("sum_beg"),
        F.sum("end").alias("sum_end"))


# ------------------------------------------------------------ exported_names
@query("exported_names", sql=f"""
WITH {TOK}
SELECT tok AS name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs
FROM tk WHERE regexp_matches(tok, '^[A-Z]') GROUP BY tok
""")
def exported_names(spark, sf_dir):
    """Distinct exported names with occurrence and document counts."""
    occ = idents(spark, sf_dir, offsets=False).filter(T.is_exported(F.col("name")))
    return occ.groupBy("name").agg(F.count(F.lit(1)).alias("n"),
                                   F.countDistinct("doc_id").alias("n_docs"))


# ----------------------------------------------------------- normalize_spans
@query("normalize_spans", sql="""
WITH s AS (
  SELECT doc_id, strlen(text) AS n, (doc_id * 37) % 1500 - 100 AS beg FROM documents),
s2 AS (SELECT doc_id, n, beg, beg + (doc_id % 4) * 200 AS "end" FROM s),
c AS (SELECT *, least(greatest(beg, 0), n) AS cb, least(greatest("end", 0), n) AS ce FROM s2)
SELECT doc_id, CAST(beg AS BIGINT) AS beg, CAST("end" AS BIGINT) AS "end",
       (beg BETWEEN 0 AND n) AND ("end" BETWEEN 0 AND n) AS valid,
       CAST(CASE WHEN cb = ce AND cb <> 0 THEN cb - 1 ELSE cb END AS BIGINT) AS cbeg,
       CAST(ce AS BIGINT) AS cend
FROM c
""")
def normalize_spans(spark, sf_dir):
    """P5 + F11: validity flag and clamped span of a derived span per document."""
    d = table(spark, sf_dir, "documents")
    beg = (F.col("doc_id") * 37) % 1500 - 100
    end = beg + (F.col("doc_id") % 4) * 200
    n = F.octet_length("text").cast("bigint")
    s = d.select("doc_id", beg.cast("bigint").alias("beg"), end.cast("bigint").alias("end"),
                 n.alias("n"))
    c = T.clamp_span(F.col("beg"), F.col("end"), F.col("n"))
    return s.select("doc_id", "beg", "end",
                    T.span_valid(F.col("beg"), F.col("end"), F.col("n")).alias("valid"),
                    c.beg.cast("bigint").alias("cbeg"), c.end.cast("bigint").alias("cend"))


# -------------------------------------------------------------- symbol_index
@query("symbol_index", sql=f"""
WITH {TOK},
o AS (SELECT source || '.' || tok AS path, {FNAME_SQL} AS fname, doc_id, i, beg
      FROM tk WHERE {IDENT_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id, i) AS rn FROM o),
a AS (SELECT path, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM o GROUP BY path)
SELECT a.path, r.fname || ':' || CAST(r.beg AS VARCHAR) AS def_loc,
       CAST(a.n - 1 AS BIGINT) AS n_refs, CAST(a.n_docs AS BIGINT) AS n_docs
FROM a JOIN r ON r.path = a.path AND r.rn = 1
""")
def symbol_index(spark, sf_dir):
    """A1 + F14: per symbol ``source.name``: definition location, references, documents."""
    occ = idents(spark, sf_dir)
    path = F.concat_ws(".", "source", "name")
    return IX.symbol_index(occ, path, fname_col(), F.col("beg"), ["doc_id", "i"], "doc_id")


# ---------------------------------------------------------- symbol_locations
@query("symbol_locations", sql=f"""
WITH {TOK},
o AS (SELECT source || '.' || tok AS path, {FNAME_SQL} AS fname, doc_id, i, beg
      FROM tk WHERE {IDENT_SQL} AND regexp_matches(tok, '^[A-Z]'))
SELECT path, fname, beg AS pos,
       CASE WHEN row_number() OVER (PARTITION BY path ORDER BY doc_id, i) = 1 THEN 'def' ELSE 'ref' END AS role
FROM o
""")
def symbol_locations(spark, sf_dir):
    """A1 / A2: every location of every exported symbol, the first one its definition."""
    occ = idents(spark, sf_dir).filter(T.is_exported(F.col("name"))).withColumn(
        "path", F.concat_ws(".", "source", "name")).withColumn("fname", fname_col())
    return IX.mark_definitions(occ, ["path"], ["doc_id", "i"]).select(
        "path", "fname", F.col("beg").alias("pos"), "role")


# ------------------------------------------------------------- package_files
@query("package_files", sql="""
SELECT source || '/' || lang AS dir, lang AS package, CAST(doc_id AS VARCHAR) AS name,
       CAST(strlen(text) AS BIGINT) AS n_bytes
FROM documents
""")
def package_files(spark, sf_dir):
    """S3: the files of every package, one row each."""
    f = file_table(table(spark, sf_dir, "documents"))
    return f.select("dir", T.path_file(F.col("dir")).alias("package"), "name",
                    F.col("size").cast("bigint").alias("n_bytes"))


# -------------------------------------------------------------------- usages
@query("usages", sql=f"""
WITH {TOK},
o AS (SELECT source, tok AS name, {FNAME_SQL} AS fname, doc_id, i FROM tk WHERE {IDENT_SQL}),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source, name ORDER BY doc_id, i) = 1
                     THEN 'def' ELSE 'ref' END AS kind FROM o)
SELECT name, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT fname) AS BIGINT) AS n_files,
       min(fname) AS first_file
FROM r GROUP BY name, kind
""")
def usages(spark, sf_dir):
    """A2 + L2: usage rows (def = first occurrence of the name in its source,
    ref = the others) counted per name and kind."""
    occ = idents(spark, sf_dir, offsets=False)
    return IX.usage_counts(occ, ["source", "name"], "name", ["lang", "doc_id"], fname_col(), ["doc_id", "i"])


# -------------------------------------------------------------- intern_names
@query("intern_names", sql=f"""
WITH {TOK},
f AS (SELECT tok AS name, min(struct_pack(d := doc_id, i := i)) AS fs FROM tk
      WHERE {IDENT_SQL} GROUP BY tok)
SELECT name, CAST(row_number() OVER (ORDER BY fs.d, fs.i) AS BIGINT) AS name_no,
       fs.d AS first_doc_id, fs.i AS first_i
FROM f
""")
def intern_names(spark, sf_dir):
    """Every identifier gets a dense number from 1 in first-seen order."""
    occ = idents(spark, sf_dir, offsets=False)
    return IX.intern(occ, "name", ["doc_id", "i"], col="name_no").select(
        "name", "name_no", "first_doc_id", "first_i")


# --------------------------------------------------------------- name_bucket
@query("name_bucket", sql=f"""
WITH {TOK}, n AS (SELECT DISTINCT tok AS name FROM tk WHERE {IDENT_SQL})
SELECT name, CAST({byte_fold_sql("name", rules.NAME_BUCKETS)} AS BIGINT) AS bucket FROM n
""")
def name_bucket(spark, sf_dir):
    """I4: bucket of every distinct identifier in the 65,536-slot name table."""
    names = idents(spark, sf_dir, offsets=False).select("name").distinct()
    return names.select("name", IX.name_bucket(F.col("name")).alias("bucket"))


# ------------------------------------------------------------------ file_env
@query("file_env", sql=f"""
WITH {TOK},
o AS (SELECT doc_id, tok AS name, i, beg,
             row_number() OVER (PARTITION BY doc_id, tok ORDER BY i) AS rn
      FROM tk WHERE {IDENT_SQL})
SELECT doc_id, name, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 2 ELSE 1 END AS tier,
       i AS first_i, beg AS first_beg
FROM o WHERE rn = 1
""")
def file_env(spark, sf_dir):
    """A5: first declaration of every name per document, tier 1 unexported / 2 exported."""
    occ = idents(spark, sf_dir)
    return IX.file_env(occ, "doc_id", "name", ["i"], ["beg"])


# --------------------------------------------------------------- quote_ascii
_ESC_SQL = r"""CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\'
  WHEN unicode(c) = 7 THEN '\a' WHEN unicode(c) = 8 THEN '\b' WHEN unicode(c) = 12 THEN '\f'
  WHEN unicode(c) = 10 THEN '\n' WHEN unicode(c) = 13 THEN '\r' WHEN unicode(c) = 9 THEN '\t'
  WHEN unicode(c) = 11 THEN '\v'
  WHEN unicode(c) < 32 OR unicode(c) = 127 THEN '\x' || lpad(lower(hex(unicode(c))), 2, '0')
  WHEN unicode(c) < 128 THEN c
  WHEN unicode(c) < 65536 THEN '\u' || lpad(lower(hex(unicode(c))), 4, '0')
  ELSE '\U' || lpad(lower(hex(unicode(c))), 8, '0') END"""


@query("quote_ascii", sql=f"""
WITH q AS (
  SELECT doc_id, '"' || array_to_string(list_transform(
           regexp_extract_all(text, '(?s).'), lambda c: {_ESC_SQL}), '') || '"' AS quoted
  FROM documents)
SELECT doc_id, CAST(strlen(quoted) AS BIGINT) AS q_len, md5(quoted) AS q_md5 FROM q
""")
def quote_ascii(spark, sf_dir):
    """every whole document rendered as a quoted ASCII string (length, md5)."""
    d = table(spark, sf_dir, "documents")
    q = T.quote_ascii(F.col("text"))
    return d.select("doc_id", q.alias("_q")).select(
        "doc_id", F.octet_length("_q").cast("bigint").alias("q_len"), F.md5("_q").alias("q_md5"))


# ------------------------------------------------------------------ packages
@query("packages", sql=f"""
SELECT source || '/' || lang AS dir, CAST(count(*) AS BIGINT) AS n_files,
       min(CAST(doc_id AS VARCHAR)) AS first_name, max(CAST(doc_id AS VARCHAR)) AS last_name,
       CAST(sum(strlen(text)) AS BIGINT) AS n_bytes
FROM documents GROUP BY ALL
""")
def packages_q(spark, sf_dir):
    """S3: one package per directory, with file count, name range and bytes."""
    files = file_table(table(spark, sf_dir, "documents"))
    return packages(files)


# ------------------------------------------------------------- lookup_source
@query("lookup_source", sql=f"""
WITH f AS (SELECT doc_id, source || '/' || lang AS dir, CAST(doc_id AS VARCHAR) AS name FROM documents),
req AS (
  SELECT 1 AS kind, doc_id, dir || '/' || name AS path FROM f
  UNION ALL SELECT 2, doc_id, dir || '/' || CAST(doc_id + 1000000000 AS VARCHAR) FROM f
  UNION ALL SELECT 3, doc_id, 'x' || dir || '/' || name FROM f),
sp AS (SELECT kind, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
              regexp_extract(path, '([^/]*)$', 1) AS name FROM req),
pk AS (SELECT DISTINCT dir FROM f)
SELECT CAST(sp.kind AS INTEGER) AS kind, sp.doc_id, sp.path,
       CASE WHEN pk.dir IS NULL THEN 'no_package' WHEN f.name IS NULL THEN 'no_source'
            ELSE 'ok' END AS status,
       CASE WHEN pk.dir IS NULL THEN 'Package [' || sp.dir || '] not found' || chr(10)
            WHEN f.name IS NULL THEN 'Src [' || sp.name || '] not found in ' || sp.dir || chr(10)
       END AS msg
FROM sp LEFT JOIN pk ON pk.dir = sp.dir LEFT JOIN f ON f.dir = sp.dir AND f.name = sp.name
""")
def lookup_source_q(spark, sf_dir):
    """Three requests per document (present, missing file, missing package)
    resolved by two left joins to the package and file tables."""
    files = file_table(table(spark, sf_dir, "documents"))
    f = files.select("doc_id", "path")
    r = lambda k, p: F.struct(F.lit(k).alias("kind"), p.alias("path"))
    req = f.select("doc_id", F.explode(F.array(
        r(1, F.col("path")),
        r(2, F.concat(T.path_dir(F.col("path")), F.lit("/"),
                      (F.col("doc_id") + 1000000000).cast("string"))),
        r(3, F.concat(F.lit("x"), F.col("path"))))).alias("_r")).select(
        F.col("_r.kind").alias("kind"), "doc_id", F.col("_r.path").alias("path"))
    out = lookup_source(req, files)
    return out.select("kind", "doc_id", "path", "status", "msg")


# ------------------------------------------------------------- corpus_counts
@query("corpus_counts", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT source) AS BIGINT) AS n_sources,
       CAST(count(DISTINCT source || '/' || lang) AS BIGINT) AS n_dirs,
       CAST(sum(strlen(text)) AS BIGINT) AS n_bytes,
       CAST(count(DISTINCT source || '/' || lang) AS VARCHAR) || ' dirs found' AS msg
FROM documents
""")
def corpus_counts(spark, sf_dir):
    """A4: documents, sources, directories and bytes of the corpus."""
    d = table(spark, sf_dir, "documents")
    dirs = F.countDistinct(F.concat_ws("/", "source", "lang"))
    return d.agg(F.count(F.lit(1)).alias("n_docs"),
                 F.countDistinct("source").alias("n_sources"),
                 dirs.alias("n_dirs"),
                 F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes")).select(
        "n_docs", "n_sources", "n_dirs", "n_bytes",
        F.format_string(rules.MSG_DIRS_FOUND, F.col("n_dirs")).alias("msg"))


# ------------------------------------------------------------- render_blocks
@query("render_blocks", sql=r"""
WITH f AS (SELECT source, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents),
q AS (SELECT source, path, '  "' || replace(replace(path, '\', '\\'), '"', '\"') || '"' AS line FROM f),
n AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY path) AS BIGINT) AS line_no, line FROM q),
c AS (SELECT source, count(*) AS n FROM f GROUP BY source)
SELECT source, line_no, line FROM n
UNION ALL SELECT source, CAST(0 AS BIGINT), 'FILES "non-system"' FROM c
UNION ALL SELECT source, CAST(n + 1 AS BIGINT), 'FILES-END' FROM c
UNION ALL SELECT source, CAST(n + 2 AS BIGINT), '' FROM c
""")
def render_blocks(spark, sf_dir):
    """S5d: one FILES block per source as numbered lines (names sorted, F5 quoting)."""
    files = file_table(table(spark, sf_dir, "documents"))
    return block_lines(files, "source", "path", "FILES", [F.lit('"non-system"')],
                       lambda c: F.concat(F.lit("  "), T.quote_ascii(c)))


# ------------------------------------------------------------------ span_udtf
@query("span_udtf", sql=f"""
WITH {TOK},
r AS (SELECT doc_id, i, tok, CAST(strlen(tok) AS BIGINT) AS n_bytes,
             row_number() OVER (PARTITION BY doc_id ORDER BY strlen(tok) DESC, i) AS rn FROM tk)
SELECT doc_id, i, tok, n_bytes FROM r WHERE rn = 1
""")
def span_udtf(spark, sf_dir):
    """V1: a user span processor (pandas, one document per call) -- the
    longest token of each document."""
    t = doc_tokens(spark, sf_dir).select("doc_id", "i", "tok")
    return process_spans(t, "doc_id", longest_token,
                         "doc_id bigint, i bigint, tok string, n_bytes bigint")
