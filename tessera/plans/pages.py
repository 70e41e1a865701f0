"""Queries over the ``pages`` table.

Bindings:
* path of a page = host plus path segments of its URL (no scheme, query,
  fragment); directories are the proper prefixes of that list.
* page text is tiled by the HTML pattern (comments, tags, words, other runs).
  Container tags open scopes; a word starting A-Z declares ``lower(word)`` in
  the innermost container (top level = file tier, visible in the whole page);
  kind CONST when the word is all capitals, TYPE otherwise; a word starting
  with a lower-case letter is a reference.  The builtin tier is the 30 most
  frequent reference words of the whole table (ties by word).
* cursors (completion, visible declarations): one in every reference word, after
  its first ``i modulo 5`` characters (``i``: the word's token number), at most at
  its end; the prefix to complete is what stands before the cursor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import index as IX
from ..operators.choices import choices_at
from ..operators.resolve import keyed_by_prefix, resolve_refs, visible_at
from ..operators.scopes import annotate_scopes, inside_count, scopes
from ..operators.spans import Nesting, process_events, visit_events
from ..sources.catalog import dir_tree, url_parts
from ..sources.sinks import errors_lines
from ..sources.tables import table
from ..session import ensure_checkpoint_dir, stored
from .registry import query, sql_str
from .documents import _ESC_SQL
from .sqlparts import byte_fold_sql, tokens_cte

RX = rules.HTML_TOKEN_RX
CONTAINERS = rules.CONTAINER_TAGS

# ------------------------------------------------------------- Spark helpers
def TAG():
    return F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))


def IS_OPEN():
    return F.col("tok").rlike("^<[A-Za-z]") & TAG().isin(CONTAINERS) & ~F.col("tok").rlike("/>$")


def IS_CLOSE():
    return F.col("tok").rlike("^</[A-Za-z]") & TAG().isin(CONTAINERS)


def IS_DECL():
    return F.col("tok").rlike("^[A-Z]")


def IS_REF():
    return F.col("tok").rlike(r"^\p{Ll}")


def DECL_KIND():
    return F.when(F.col("tok").rlike("^[A-Z][A-Z0-9_]+$"), F.lit("CONST")).otherwise(F.lit("TYPE"))




def page_tokens(spark, sf_dir, offsets: bool = True) -> DataFrame:
    from ..operators.tokens import tokenize
    return tokenize(table(spark, sf_dir, "pages"), "page_id", "html", RX, offsets=offsets)


def annotate_html(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Scopes of container tags; only tags and words are kept after the depth
    sum (the page jobs read nothing else)."""
    return annotate_scopes(tokens, key, IS_OPEN(), IS_CLOSE(), TAG(),
                           keep=F.col("tok").rlike(r"^[\p{L}_]"))


def annotated(spark, sf_dir) -> DataFrame:
    return annotate_html(page_tokens(spark, sf_dir))


def page_items(spark, sf_dir) -> DataFrame:
    return html_items(annotated(spark, sf_dir))


def html_items(annotated_tokens: DataFrame, with_unbalanced: bool = False) -> DataFrame:
    """Declarations and references of every page (one row per word token).
    ``with_unbalanced``: container tags without a partner come along as
    pass-through rows (``is_pass``) for the balance diagnostics."""
    unb = F.col("kind").isNotNull() & ~F.col("matched")
    keep = IS_DECL() | IS_REF() | unb if with_unbalanced else IS_DECL() | IS_REF()
    a = annotated_tokens.filter(keep)
    name = F.when(IS_DECL(), F.lower("tok")).when(IS_REF(), F.col("tok"))
    extra = [unb.alias("is_pass")] if with_unbalanced else []
    return a.select("page_id", "i", "tok", name.alias("name"), "beg", "end", "depth",
                    "scope_i", IS_DECL().alias("is_decl"), IS_REF().alias("is_ref"),
                    (IS_DECL() & (F.col("depth") > 0)).alias("local"),
                    F.col("scope_end").alias("vis_end"),
                    F.when(IS_DECL(), DECL_KIND()).alias("kind"), *extra)


def page_builtins(spark, sf_dir) -> DataFrame:
    """The 30 most frequent reference words (a top-k: bounded by construction)."""
    p = page_tokens(spark, sf_dir, offsets=False).filter(IS_REF())
    top = (p.groupBy(F.col("tok").alias("name")).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), "name").limit(rules.PAGE_BUILTIN_TOP))
    return top.select("name", F.lit("TYPE").alias("kind"))


def url_path(url):
    no_scheme = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_extract(no_scheme, "^([^?#]*)", 1)


# ------------------------------------------------------------- SQL helpers
TOK = tokens_cte("tk", "pages", "page_id", "html", RX)
_CONT = ", ".join(sql_str(t) for t in CONTAINERS)
ANN_CTE = f"""{TOK},
k AS (
  SELECT page_id, i, tok, beg, "end",
         lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tg
  FROM tk),
k2 AS (
  SELECT *, CASE WHEN regexp_matches(tok, '^<[A-Za-z]') AND tg IN ({_CONT})
                      AND NOT regexp_matches(tok, '/>$') THEN 'open'
                 WHEN regexp_matches(tok, '^</[A-Za-z]') AND tg IN ({_CONT}) THEN 'close' END AS kind
  FROM k),
k3 AS (
  SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END)
              OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d
  FROM k2),
ann AS MATERIALIZED (
  SELECT page_id, i, tok, beg, "end", kind, CASE WHEN kind IS NOT NULL THEN tg END AS tag,
         CAST(CASE WHEN kind = 'close' THEN d + 1 ELSE d END AS BIGINT) AS level,
         CAST(CASE WHEN kind IS NOT NULL THEN (CASE WHEN kind = 'close' THEN d + 1 ELSE d END) - 1
                   ELSE d END AS BIGINT) AS depth
  FROM k3),
tagev AS (SELECT * FROM ann WHERE kind IS NOT NULL),
opens AS (SELECT * FROM tagev WHERE kind = 'open'),
closes AS (SELECT * FROM tagev WHERE kind = 'close'),
nxt AS (  -- first tag event after each open at the same level
  SELECT page_id, i, ni FROM (SELECT page_id, i, kind, lead(i) OVER (
      PARTITION BY page_id, level ORDER BY i) AS ni FROM tagev)
  WHERE kind = 'open' AND ni IS NOT NULL),
partner AS (
  SELECT n.page_id, n.i, c.i AS end_i, c.beg AS end_beg, c."end" AS end_end
  FROM nxt n JOIN opens o USING (page_id, i)
  JOIN closes c ON c.page_id = n.page_id AND c.i = n.ni AND c.tag = o.tag),
-- innermost enclosing open of any token: last open at level = token depth
encl AS (
  SELECT page_id, i, scope_i FROM (
    SELECT page_id, i, lvl, asks, max(CASE WHEN NOT asks THEN i END) OVER (
      PARTITION BY page_id, lvl ORDER BY i, asks DESC ROWS UNBOUNDED PRECEDING) AS scope_i
    FROM (SELECT page_id, i, depth AS lvl, true AS asks FROM ann
          UNION ALL SELECT page_id, i, level, false FROM opens))
  WHERE asks AND lvl > 0 AND scope_i IS NOT NULL),
full_ann AS MATERIALIZED (  -- a scope ends at its partner close (none: end of file)
  SELECT a.*, e.scope_i, p.end_beg AS scope_end FROM ann a
  LEFT JOIN encl e USING (page_id, i)
  LEFT JOIN partner p ON p.page_id = a.page_id AND p.i = e.scope_i)"""

ITEMS_CTE = f"""{ANN_CTE},
items AS (
  SELECT page_id, i, tok, CASE WHEN regexp_matches(tok, '^[A-Z]') THEN lower(tok) ELSE tok END AS name,
         beg, "end", depth, scope_i, scope_end AS vis_end,
         regexp_matches(tok, '^[A-Z]') AS is_decl,
         regexp_matches(tok, '^\\p{{Ll}}') AS is_ref,
         CASE WHEN regexp_matches(tok, '^[A-Z]')
              THEN CASE WHEN regexp_full_match(tok, '[A-Z][A-Z0-9_]+') THEN 'CONST' ELSE 'TYPE' END
         END AS kind
  FROM full_ann WHERE regexp_matches(tok, '^[A-Z]') OR regexp_matches(tok, '^\\p{{Ll}}')),
decls AS (SELECT * FROM items WHERE is_decl),
refs AS (SELECT * FROM items WHERE is_ref),
builtins AS (
  SELECT name, 'TYPE' AS kind FROM (SELECT tok AS name, count(*) AS n FROM tk
    WHERE regexp_matches(tok, '^\\p{{Ll}}') GROUP BY tok ORDER BY n DESC, name LIMIT {rules.PAGE_BUILTIN_TOP})),
loc AS (  -- innermost visible local declaration: largest begin among the visible ones
  SELECT r.page_id, r.i, arg_max(d.i, d.beg) AS decl_i, arg_max(d.kind, d.beg) AS decl_kind
  FROM refs r JOIN decls d ON d.page_id = r.page_id AND d.name = r.name AND d.depth > 0
   AND d.beg < r.beg AND (d.vis_end IS NULL OR r.beg < d.vis_end) GROUP BY ALL),
fil AS (
  SELECT page_id, name, arg_min(i, i) AS decl_i, arg_min(kind, i) AS decl_kind
  FROM decls WHERE depth = 0 GROUP BY ALL),
dn AS (SELECT DISTINCT page_id, name FROM decls),
res AS (
  SELECT r.page_id, r.i, r.name, r.beg, r."end",
         CASE WHEN l.decl_i IS NOT NULL THEN 0 WHEN f.decl_i IS NOT NULL THEN 2
              WHEN b.name IS NOT NULL THEN 3 END AS tier,
         coalesce(l.decl_i, f.decl_i) AS decl_i,
         coalesce(l.decl_kind, f.decl_kind, b.kind) AS decl_kind,
         dn.name IS NOT NULL AS declared
  FROM refs r LEFT JOIN loc l USING (page_id, i)
  LEFT JOIN fil f ON f.page_id = r.page_id AND f.name = r.name
  LEFT JOIN builtins b ON b.name = r.name
  LEFT JOIN dn ON dn.page_id = r.page_id AND dn.name = r.name)"""

URL_SQL = "regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^?#]*)', 1)"
PARTS_SQL = f"list_filter(string_split({URL_SQL}, '/'), lambda s: s <> '')"


# ================================================================= paths
FOLD_SQL = ("list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN (CASE WHEN len(acc) > 0 "
            "AND acc[-1] <> '..' THEN acc[1:-2] ELSE list_append(acc, s) END) "
            "ELSE list_append(acc, s) END, []::VARCHAR[])")


def _clean_sql(p: str) -> str:
    """Lexical path cleaning in SQL: drop empty and '.' segments, fold '..',
    drop leading '..' of a rooted path, '.' for nothing."""
    segs = f"list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.')"
    folded = FOLD_SQL.format(segs=segs)
    rooted = f"starts_with({p}, '/')"
    body = (f"array_to_string(CASE WHEN {rooted} THEN list_filter({folded}, lambda s: s <> '..') "
            f"ELSE {folded} END, '/')")
    out = f"(CASE WHEN {rooted} THEN '/' ELSE '' END) || {body}"
    return f"(CASE WHEN {out} = '' THEN '.' ELSE {out} END)"


@query("path_parts", sql=f"""
WITH p AS (SELECT page_id, {URL_SQL} AS path FROM pages),
q AS (SELECT *, regexp_replace(path, '/+$', '') AS t,
             regexp_extract(path, '^(.*/)?[^/]*$', 1) AS dpart,
             list_filter(string_split(path, '/'), lambda s: s <> '' AND s <> '.') AS cparts FROM p)
SELECT page_id, path, {_clean_sql("dpart")} AS dir,
       CASE WHEN path = '' THEN '.' WHEN t = '' THEN '/' ELSE regexp_extract(t, '([^/]*)$', 1) END AS base,
       {_clean_sql("path")} AS clean,
       CAST(len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS INTEGER) AS n_parts
FROM q
""")
def path_parts(spark, sf_dir):
    """F8: directory, base and cleaned form of every page path."""
    p = table(spark, sf_dir, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return p.select("page_id", "path", T.path_dir(F.col("path")).alias("dir"),
                    T.path_base(F.col("path")).alias("base"),
                    T.path_clean(F.col("path")).alias("clean"),
                    F.size(url_parts(F.col("path"))).alias("n_parts"))


@query("dir_tree", sql=f"""
WITH p AS (SELECT {PARTS_SQL} AS parts FROM pages),
x AS (SELECT parts[1:k] AS pre FROM p, range(1, len(parts)) r(k) WHERE len(parts) >= 2)
SELECT DISTINCT array_to_string(pre, '/') AS dir,
       CASE WHEN len(pre) > 1 THEN array_to_string(pre[1:len(pre)-1], '/') END AS parent,
       pre[len(pre)] AS name, CAST(len(pre) AS INTEGER) AS depth
FROM x
""")
def dir_tree_q(spark, sf_dir):
    """The directory tree of all page paths as an adjacency list."""
    p = table(spark, sf_dir, "pages").select(url_parts(F.col("url")).alias("parts"))
    return dir_tree(p)


@query("intern_paths", sql=f"""
WITH p AS (SELECT page_id, {PARTS_SQL} AS parts FROM pages),
x AS (SELECT page_id, k, parts[1:k] AS pre FROM p, range(1, len(parts) + 1) r(k)),
f AS (SELECT pre, min(struct_pack(a := page_id, b := k)) AS fs FROM x GROUP BY pre)
SELECT array_to_string(pre, '/') AS path,
       CAST(row_number() OVER (ORDER BY fs.a, fs.b) - 1 AS BIGINT) AS path_no,
       array_to_string(pre, '.') AS repr, CAST(len(pre) AS INTEGER) AS depth,
       CAST(list_reduce(list_transform(pre, lambda e: {byte_fold_sql("e", rules.PATH_BUCKETS)}),
                        lambda a, h: (a + h) % {rules.PATH_BUCKETS}) AS BIGINT) AS bucket
FROM f
""")
def intern_paths(spark, sf_dir):
    """I2 + F9 + I4: every path prefix numbered from 0 in first-seen order,
    with its dotted form and its bucket in the 1,024-slot path table."""
    p = table(spark, sf_dir, "pages").select("page_id", url_parts(F.col("url")).alias("parts"))
    x = p.filter(F.size("parts") > 0).select("page_id", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("parts")), lambda k: F.slice(F.col("parts"), 1, k)))
        .alias("_k", "pre"))
    x = x.select("page_id", (F.col("_k") + 1).alias("k"), "pre",
                 F.array_join("pre", "/").alias("path"))
    n = IX.intern(x, "path", ["page_id", "k"], col="path_no", start=0)
    parts = F.split("path", "/")
    return n.select("path", "path_no", T.path_repr(parts).alias("repr"),
                    F.size(parts).alias("depth"), IX.path_bucket(parts).alias("bucket"))


@query("file_mode", sql=f"""
WITH p AS (SELECT page_id, {PARTS_SQL} AS parts FROM pages)
SELECT page_id, parts[len(parts)] AS name,
       CASE WHEN ends_with(parts[len(parts)], '.html') THEN 'SET-FILE-MODE' ELSE 'DROP-FILE-MODE' END AS mode
FROM p
""")
def file_mode(spark, sf_dir):
    """The last path element of each page decides its file mode (.html sets)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.element_at(url_parts(F.col("url")), -1)
                                             .alias("name"))
    mode = F.when(F.col("name").endswith(".html"), F.lit(rules.SET_FILE_MODE)).otherwise(
        F.lit(rules.DROP_FILE_MODE))
    return p.select("page_id", "name", mode.alias("mode"))


FIND_PREFIX, FIND_MAX = "7", 20


@query("find_files", sql=f"""
WITH p AS (SELECT page_id, {PARTS_SQL} AS parts FROM pages)
SELECT page_id, parts[len(parts)] AS name FROM p
WHERE starts_with(parts[len(parts)], '{FIND_PREFIX}')
ORDER BY name, page_id LIMIT {FIND_MAX}
""")
def find_files(spark, sf_dir):
    """P2 + L1: file names with a prefix, the first 20 by name (the limit is the
    command's ``max`` argument)."""
    p = table(spark, sf_dir, "pages").select("page_id", F.element_at(url_parts(F.col("url")), -1)
                                             .alias("name"))
    return p.filter(F.col("name").startswith(FIND_PREFIX)).orderBy("name", "page_id").limit(FIND_MAX)


@query("import_join", sql=f"""
WITH p AS (SELECT page_id, {URL_SQL} AS path, {PARTS_SQL} AS parts FROM pages),
pk AS (SELECT DISTINCT parts[2] AS pkg FROM p WHERE len(parts) >= 2),
s AS (SELECT page_id, '"' || path || '"' AS spec, path FROM p),
u AS (SELECT page_id, spec,
             CASE WHEN regexp_full_match(spec, '"[^"\\\\]*"') THEN path END AS value FROM s),
b AS (SELECT page_id, value,
             CASE WHEN value IS NULL THEN NULL WHEN value = '' THEN '.'
                  WHEN regexp_replace(value, '/+$', '') = '' THEN '/'
                  ELSE regexp_extract(regexp_replace(value, '/+$', ''), '([^/]*)$', 1) END AS pkg FROM u)
SELECT b.page_id, b.pkg, pk.pkg IS NOT NULL AS matched,
       CASE WHEN b.value IS NULL THEN 'invalid path syntax' END AS error
FROM b LEFT JOIN pk ON pk.pkg = b.pkg
""")
def import_join(spark, sf_dir):
    """J8 + F7: each page path as an import literal -> package name (alias-free:
    last element) joined to the distinct first path elements."""
    p = table(spark, sf_dir, "pages").select("page_id", url_path(F.col("url")).alias("path"),
                                             url_parts(F.col("url")).alias("parts"))
    pk = p.filter(F.size("parts") >= 2).select(F.element_at("parts", 2).alias("pkg")).distinct()
    spec = F.concat(F.lit('"'), F.col("path"), F.lit('"'))
    u = p.select("page_id", T.unquote(spec).alias("value"))
    b = u.select("page_id", "value", F.when(F.col("value").isNotNull(),
                                             T.path_base(F.col("value"))).alias("pkg"))
    j = b.join(pk.withColumn("_m", F.lit(True)), "pkg", "left")
    return j.select("page_id", "pkg", F.col("_m").isNotNull().alias("matched"),
                    F.when(F.col("value").isNull(), F.lit(rules.MSG_INVALID_PATH)).alias("error"))


# ================================================================= scopes
@query("scopes", sql=f"""
WITH {ANN_CTE}
SELECT o.page_id, o.i AS scope_i, p.end_i, o.level AS depth, o.tag, o.beg, p.end_end AS "end",
       e.scope_i AS parent_i
FROM opens o LEFT JOIN partner p USING (page_id, i) LEFT JOIN encl e USING (page_id, i)
""")
def scopes_q(spark, sf_dir):
    """Every container scope with level, partner close, byte span and parent."""
    return scopes(annotated(spark, sf_dir), "page_id")


@query("context_flag", sql=f"""
WITH {ANN_CTE},
nv AS (SELECT page_id, i, sum(CASE WHEN kind = 'open' AND tag = 'nav' THEN 1
                                    WHEN kind = 'close' AND tag = 'nav' THEN -1 ELSE 0 END)
         OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
       FROM ann)
SELECT o.page_id, o.i, po.tag AS parent_tag, coalesce(nv.n, 0) > 0 AS in_nav
FROM opens o LEFT JOIN encl e USING (page_id, i)
LEFT JOIN opens po ON po.page_id = o.page_id AND po.i = e.scope_i
JOIN nv ON nv.page_id = o.page_id AND nv.i = o.i
WHERE o.tag = 'a'
""")
def context_flag(spark, sf_dir):
    """For each link scope, the nearest enclosing container and whether it
    lies inside a nav."""
    a = annotated(spark, sf_dir)
    is_nav = F.col("tag") == "nav"
    a = inside_count(a, "page_id", (F.col("kind") == "open") & is_nav,
                     (F.col("kind") == "close") & is_nav, "_nav")
    return a.filter((F.col("kind") == "open") & (F.col("tag") == "a")).select(
        "page_id", "i", F.col("scope_tag").alias("parent_tag"), (F.col("_nav") > 0).alias("in_nav"))


@query("decls", sql=f"""
WITH {ITEMS_CTE}
SELECT page_id, i, name, kind, depth, scope_i, beg, vis_end FROM decls
""")
def decls_q(spark, sf_dir):
    """Every declaration with its scope, depth and end of visibility."""
    it = page_items(spark, sf_dir).filter("is_decl")
    return it.select("page_id", "i", "name", "kind", "depth", "scope_i", "beg", "vis_end")


@query("resolve_refs", sql=f"""
WITH {ITEMS_CTE}
SELECT page_id, i, name, tier, decl_i FROM res
""")
def resolve_refs_q(spark, sf_dir):
    """Each reference to its innermost visible declaration (local sweep),
    else the file tier, else the builtin tier."""
    r = resolve_refs(page_items(spark, sf_dir), "page_id", page_builtins(spark, sf_dir))
    return r.select("page_id", "i", "name", "tier", "decl_i")


def _type_diagnostics(spark, sf_dir, with_unbalanced: bool = False) -> DataFrame:
    """Type rules over the resolved references; with ``with_unbalanced`` the
    unmatched container tags of the same single pass are reported too."""
    it = html_items(annotated(spark, sf_dir), with_unbalanced)
    r = resolve_refs(it, "page_id", page_builtins(spark, sf_dir), carry=["end"])
    passed = F.col("passed") if with_unbalanced else F.lit(False)
    undefined = ~passed & (~F.col("declared")) & F.col("tier").isNull()
    not_type = F.col("tier").isin(0, 2) & (F.col("decl_kind") == "CONST")
    msg = (F.when(passed, F.lit(rules.MSG_UNBALANCED))
           .when(undefined, F.format_string(rules.MSG_TYPE_UNDEFINED, F.col("name")))
           .when(not_type, F.lit(rules.MSG_TYPE_IDENT_REQUIRED)))
    return r.withColumn("msg", msg).filter(F.col("msg").isNotNull()).select(
        "page_id", "i", "name", "beg", "end", "msg")


@query("undefined_types", sql=f"""
WITH {ITEMS_CTE}
SELECT page_id, i, name, beg, "end",
       CASE WHEN NOT declared AND tier IS NULL THEN 'type `' || name || ''' undefined'
            ELSE 'type ident required' END AS msg
FROM res
WHERE (NOT declared AND tier IS NULL) OR (tier IN (0, 2) AND decl_kind = 'CONST')
""")
def undefined_types(spark, sf_dir):
    """J4 + J9: references without any declaration in the page or the builtin
    tier ("type `x' undefined"), and references resolved to a constant
    ("type ident required")."""
    return _type_diagnostics(spark, sf_dir)


CURSOR_SQL = """
cur AS (SELECT page_id, i, tok, beg + strlen(substr(tok, 1, i % 5)) AS pos, substr(tok, 1, i % 5) AS pref
        FROM refs)"""


def cursor_prefix():
    """The part of a reference word before its cursor (may be empty)."""
    return F.substring(F.col("tok"), F.lit(1), (F.col("i") % 5).cast("int"))


@query("visible_decls", sql=f"""
WITH {ITEMS_CTE}, {CURSOR_SQL},
vis AS (
  SELECT c.page_id, c.i, count(d.i) AS n_local, arg_max(d.i, d.beg) AS newest_i,
         arg_max(d.name, d.beg) AS newest_name
  FROM cur c LEFT JOIN decls d ON d.page_id = c.page_id AND d.depth > 0 AND d.beg < c.pos
       AND (d.vis_end IS NULL OR c.pos < d.vis_end) GROUP BY ALL),
nf AS (SELECT page_id, count(*) AS n_file FROM decls WHERE depth = 0 GROUP BY page_id)
SELECT c.page_id, c.i, CAST(c.pos AS BIGINT) AS pos, CAST(v.n_local AS BIGINT) AS n_local,
       CAST(coalesce(nf.n_file, 0) AS BIGINT) AS n_file, v.newest_i, v.newest_name
FROM cur c JOIN vis v USING (page_id, i) LEFT JOIN nf ON nf.page_id = c.page_id
""")
def visible_decls(spark, sf_dir):
    """At each cursor, the number of visible local declarations, of file
    level ones, and the newest visible local one (a sweep per page)."""
    it = page_items(spark, sf_dir)
    items = (it.withColumn("is_cursor", F.col("is_ref"))
             .withColumn("pos", F.col("beg") + F.octet_length(cursor_prefix())))
    v = visible_at(items, "page_id")
    return v.select("page_id", "i", F.col("pos").cast("bigint").alias("pos"),
                    F.col("n_visible").alias("n_local"), "n_file",
                    F.col("innermost.i").alias("newest_i"),
                    F.col("innermost.name").alias("newest_name"))


@query("complete", sql=f"""
WITH {ITEMS_CTE}, {CURSOR_SQL},
lm AS (
  SELECT c.page_id, c.i, count(d.i) AS n FROM cur c LEFT JOIN decls d
    ON d.page_id = c.page_id AND d.depth > 0 AND starts_with(d.name, c.pref) AND d.beg < c.pos
   AND (d.vis_end IS NULL OR c.pos < d.vis_end) GROUP BY ALL),
fm AS (
  SELECT c.page_id, c.i, count(d.i) AS n FROM cur c LEFT JOIN decls d
    ON d.page_id = c.page_id AND d.depth = 0 AND starts_with(d.name, c.pref) GROUP BY ALL),
bm AS (
  SELECT c.page_id, c.i, count(b.name) AS n FROM cur c LEFT JOIN builtins b
    ON starts_with(b.name, c.pref) GROUP BY ALL)
SELECT c.page_id, c.i, c.tok AS word, c.pref, CAST(lm.n AS BIGINT) AS n_local,
       CAST(fm.n AS BIGINT) AS n_file, CAST(bm.n AS BIGINT) AS n_builtin,
       CAST(lm.n + fm.n + bm.n AS BIGINT) AS n_choices
FROM cur c JOIN lm USING (page_id, i) JOIN fm USING (page_id, i) JOIN bm USING (page_id, i)
""")
def complete(spark, sf_dir):
    """Completion choices at each cursor -- visible declarations whose
    name starts with the text before the cursor (any length), counted per tier.
    The sweep is keyed by (page, prefix), so matching stays an equality: a
    declaration joins the sweeps of those of its prefixes whose length some
    cursor of the page has."""
    it = page_items(spark, sf_dir)
    items = keyed_by_prefix(
        it.withColumn("is_cursor", F.col("is_ref"))
        .withColumn("pref", F.when(F.col("is_ref"), cursor_prefix()))
        .withColumn("pos", F.col("beg") + F.octet_length("pref")), "page_id")
    v = visible_at(items, "page_id", ["pkey"])
    b = page_builtins(spark, sf_dir).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k)))
        .alias("pkey")).groupBy("pkey").agg(F.count(F.lit(1)).alias("n_builtin"))
    v = v.join(F.broadcast(b), "pkey", "left")
    nb = F.coalesce(F.col("n_builtin"), F.lit(0)).cast("bigint")
    return v.select("page_id", "i", F.col("tok").alias("word"), F.col("pkey").alias("pref"),
                    F.col("n_visible").alias("n_local"), "n_file", nb.alias("n_builtin"),
                    (F.col("n_visible") + F.col("n_file") + nb).alias("n_choices"))


@query("diagnostics_by_doc", sql=f"""
WITH {ITEMS_CTE},
tdiag AS (
  SELECT page_id, beg, CASE WHEN NOT declared AND tier IS NULL THEN 'u' ELSE 'n' END AS k FROM res
  WHERE (NOT declared AND tier IS NULL) OR (tier IN (0, 2) AND decl_kind = 'CONST')),
matched_opens AS (SELECT page_id, i FROM partner),
matched_closes AS (SELECT page_id, end_i AS i FROM partner),
unb AS (
  SELECT t.page_id, t.beg, 'b' AS k FROM tagev t
  LEFT JOIN matched_opens mo ON mo.page_id = t.page_id AND mo.i = t.i
  LEFT JOIN matched_closes mc ON mc.page_id = t.page_id AND mc.i = t.i
  WHERE mo.i IS NULL AND mc.i IS NULL),
alld AS (SELECT * FROM tdiag UNION ALL SELECT * FROM unb)
SELECT page_id, CAST(count(*) AS BIGINT) AS n_diag,
       CAST(sum(CASE WHEN k = 'u' THEN 1 ELSE 0 END) AS BIGINT) AS n_undefined,
       CAST(sum(CASE WHEN k = 'n' THEN 1 ELSE 0 END) AS BIGINT) AS n_not_type,
       CAST(sum(CASE WHEN k = 'b' THEN 1 ELSE 0 END) AS BIGINT) AS n_unbalanced,
       CAST(sum(beg) AS BIGINT) AS sum_beg
FROM alld GROUP BY page_id
""")
def diagnostics_by_doc(spark, sf_dir):
    """A3 + X5: per page, all diagnostics counted by rule (undefined type,
    constant used as type, container tag without partner)."""
    # one pass: resolution and tag balance come out of the same sweep
    d = _type_diagnostics(spark, sf_dir, with_unbalanced=True).select(
        "page_id", "beg", F.when(F.col("msg") == rules.MSG_TYPE_IDENT_REQUIRED, F.lit("n"))
        .when(F.col("msg") == rules.MSG_UNBALANCED, F.lit("b"))
        .otherwise(F.lit("u")).alias("k"))
    cnt = lambda k: F.sum(F.when(F.col("k") == k, 1).otherwise(0)).cast("bigint")
    return d.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_diag"), cnt("u").alias("n_undefined"),
        cnt("n").alias("n_not_type"), cnt("b").alias("n_unbalanced"),
        F.sum("beg").cast("bigint").alias("sum_beg"))


RENDER_ERRORS_SQL = f"""
WITH {ITEMS_CTE},
tdiag AS (
  SELECT page_id, beg, "end",
         CASE WHEN NOT declared AND tier IS NULL THEN 'type `' || name || ''' undefined'
              ELSE 'type ident required' END AS msg FROM res
  WHERE (NOT declared AND tier IS NULL) OR (tier IN (0, 2) AND decl_kind = 'CONST')),
unb AS (
  SELECT t.page_id, t.beg, t."end", 'invalid expression node' AS msg FROM tagev t
  LEFT JOIN partner mo ON mo.page_id = t.page_id AND mo.i = t.i
  LEFT JOIN partner mc ON mc.page_id = t.page_id AND mc.end_i = t.i
  WHERE mo.i IS NULL AND mc.i IS NULL),
alld AS (SELECT * FROM tdiag UNION ALL SELECT * FROM unb),
rows_ AS (
  SELECT page_id, beg, "end", '  ERROR ' || CAST(beg AS VARCHAR) || ' ' || CAST("end" AS VARCHAR) || ' "'
           || array_to_string(list_transform(regexp_extract_all(msg, '(?s).'), lambda c: {_ESC_SQL}), '')
           || '"' AS line FROM alld),
num AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY beg, "end", line) AS BIGINT)
               AS line_no, line FROM rows_),
cnt AS (SELECT page_id, count(*) AS n FROM rows_ GROUP BY page_id),
hdr AS (SELECT p.page_id, coalesce(c.n, 0) AS n, {URL_SQL} AS path
        FROM pages p LEFT JOIN cnt c ON p.page_id = c.page_id),
q AS (SELECT page_id, n, '"' || array_to_string(list_transform(regexp_extract_all(path, '(?s).'),
                                    lambda c: {_ESC_SQL}), '') || '"' AS qp FROM hdr)
SELECT page_id, line_no, line FROM num
UNION ALL SELECT page_id, CAST(0 AS BIGINT), 'ERRORS ' || qp || ' 0' FROM q
UNION ALL SELECT page_id, CAST(n + 1 AS BIGINT), 'ERRORS-END' FROM q
UNION ALL SELECT page_id, CAST(n + 2 AS BIGINT), '' FROM q
"""


@query("render_errors", sql=RENDER_ERRORS_SQL)
def render_errors(spark, sf_dir):
    """S5a + X5 + F5: one ERRORS block per page (header and end alone for a page
    without diagnostics), rows sorted by span, messages quoted to ASCII."""
    d = _type_diagnostics(spark, sf_dir, with_unbalanced=True).select(
        "page_id", "beg", "end", "msg").withColumn("lvl", F.lit(rules.LVL_ERROR))
    paths = table(spark, sf_dir, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return errors_lines(d, "page_id", fname="path", groups=paths)


CHOICE_SQL = """
ccur AS (SELECT page_id, i, beg + strlen(substr(tok, 1, 1 + i % 4)) AS pos, substr(tok, 1, 1 + i % 4) AS pref FROM refs),
cand AS (
  SELECT c.page_id, c.i, c.pref, d.name, d.kind, CASE WHEN d.depth > 0 THEN 0 ELSE 2 END AS tier, d.i AS decl_i, d.beg, d."end"
  FROM ccur c JOIN decls d ON d.page_id = c.page_id AND starts_with(d.name, c.pref)
   AND (d.depth = 0 OR d.beg < c.pos AND (d.vis_end IS NULL OR c.pos < d.vis_end))
  UNION ALL
  SELECT c.page_id, c.i, c.pref, b.name, b.kind, 3, NULL, NULL, NULL FROM ccur c JOIN builtins b ON starts_with(b.name, c.pref))"""


def _choices(spark, sf_dir, shadowed: bool) -> DataFrame:
    ensure_checkpoint_dir(spark)
    a = stored(annotated(spark, sf_dir), "tokens")
    it = html_items(a)
    pref = F.substring(F.col("tok"), F.lit(1), (1 + F.col("i") % 4).cast("int"))
    cursors = it.filter("is_ref").select("page_id", F.col("i").alias("cursor"), pref.alias("pref"),
                                         (F.col("beg") + F.octet_length(pref)).alias("pos"), "scope_i")
    scopes_ = a.filter("kind = 'open'").select("page_id", F.col("i").alias("scope_i"), F.col("scope_i").alias("parent_i"))
    return choices_at(it.filter("is_decl"), cursors, scopes_, "page_id", page_builtins(spark, sf_dir), shadowed).select(
        "page_id", F.col("cursor").alias("i"), "pref", F.col("name").alias("choice"), "kind", "tier", "decl_i", "beg", "end")


@query("choices", sql=f"""
WITH {ITEMS_CTE}, {CHOICE_SQL}
SELECT page_id, i, pref, name AS choice, kind, tier, decl_i, beg, "end" FROM cand
""")
def choices(spark, sf_dir):
    """W4 + J10: every choice at every cursor (after 1 to 4 characters of each reference word), with
    kind, tier and span; shadowed ones too."""
    return _choices(spark, sf_dir, True)


@query("choices_unshadowed", sql=f"""
WITH {ITEMS_CTE}, {CHOICE_SQL}
SELECT page_id, i, pref, name AS choice, kind, tier, decl_i, beg, "end" FROM cand
QUALIFY row_number() OVER (PARTITION BY page_id, i, name ORDER BY tier, beg DESC) = 1
""")
def choices_unshadowed(spark, sf_dir):
    """W4 + J10: the choices without those that a nearer declaration of the name hides."""
    return _choices(spark, sf_dir, False)


@query("visit_nesting", sql=f"""
WITH {ANN_CTE},
ev AS (SELECT p.page_id, o.tag AS cls, unnest([{{'at': p.i, 'd': 1}}, {{'at': p.end_i, 'd': -1}}]) AS e
       FROM partner p JOIN opens o USING (page_id, i)),
r AS (SELECT page_id, cls, e.d AS d, sum(e.d) OVER (PARTITION BY page_id, cls ORDER BY e."at") AS depth FROM ev)
SELECT page_id, cls, count(*) FILTER (d = 1)::BIGINT AS n, max(depth)::BIGINT AS deepest FROM r GROUP BY page_id, cls
""")
def visit_nesting(spark, sf_dir):
    """V1: a processor that is called before and after every container of a page, in order, counts
    the containers of each tag and how deep they lie in one another."""
    a = annotated(spark, sf_dir).filter("kind = 'open' AND partner_beg IS NOT NULL")
    spans = a.select("page_id", F.col("tag").alias("cls"), "beg", F.col("partner_end").alias("end"))
    return process_events(visit_events(spans, "page_id"), "page_id", Nesting, "cls string, n long, deepest long")
