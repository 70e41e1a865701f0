"""The editor protocol over the ``pages`` table.

Binding: every page is a file (path = URL host and path, dir / name split at
the last slash, text = html).  Each page issues three commands, numbered
``page_id * 3 + k``: ``file-in-project "<path>"``, ``find-files "<first
character of its name>" system 3`` and ``load-project``.  The result is the
protocol's output lines ``(seq, line_no, line)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from ..streaming.session import process_commands
from .documents import _ESC_SQL
from .pages import URL_SQL, _clean_sql, url_path
from .registry import query

FIND_MAX = 3
# F5 quoting of a SQL expression (the oracle's own form of quote_ascii)
Q = ("'\"' || array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), "
     "lambda c: " + "{esc}" + "), '') || '\"'")


def page_corpus(pages):
    path = url_path(F.col("url"))
    return pages.select(path.alias("path"), T.path_dir(path).alias("dir"),
                        T.path_file(path).alias("name"), F.col("html").alias("text"))


def page_commands(pages):
    path = url_path(F.col("url"))
    first = F.substring(T.path_file(path), 1, 1)
    cmd = lambda k, line: F.struct((F.col("page_id") * 3 + k).alias("seq"), line.alias("line"))
    return pages.select(F.explode(F.array(
        cmd(0, F.concat(F.lit('file-in-project "'), path, F.lit('"'))),
        cmd(1, F.concat(F.lit('find-files "'), first, F.lit(f'" system {FIND_MAX}'))),
        cmd(2, F.lit("load-project")))).alias("_c")).select("_c.seq", "_c.line")


Q = Q.replace("{esc}", _ESC_SQL.replace("{", "{{").replace("}", "}}"))


@query("command_session", sql=f"""
WITH f AS (
  SELECT page_id, {URL_SQL} AS path FROM pages),
files AS (
  SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name,
         {_clean_sql("regexp_extract(path, '^(.*/)?[^/]*$', 1)")} AS d
  FROM f),
dp AS (SELECT DISTINCT list_filter(string_split(d, '/'), lambda x: x <> '') AS parts FROM files),
nd AS (SELECT count(DISTINCT array_to_string(parts[1:k], '/')) AS n FROM dp, range(1, len(parts) + 1) r(k)),
mode AS (
  SELECT page_id * 3 AS seq,
         CASE WHEN ends_with(path, '.go') THEN 'SET-FILE-MODE' ELSE 'DROP-FILE-MODE' END AS m, path
  FROM files),
ff AS (SELECT page_id * 3 + 1 AS seq, substr(name, 1, 1) AS pfx FROM files),
hits AS (
  SELECT ff.seq, fl.path, row_number() OVER (PARTITION BY ff.seq ORDER BY fl.path) AS r
  FROM ff JOIN files fl ON starts_with(fl.name, ff.pfx)),
kept AS (SELECT * FROM hits WHERE r <= {FIND_MAX}),
cnt AS (SELECT ff.seq, count(k.path) AS n FROM ff LEFT JOIN kept k ON k.seq = ff.seq GROUP BY ff.seq)
SELECT CAST(seq AS BIGINT) AS seq, CAST(0 AS BIGINT) AS line_no, m || ' ' || {Q.format(x="path")} AS line FROM mode
UNION ALL SELECT CAST(seq AS BIGINT), CAST(1 AS BIGINT), m || '-END' FROM mode
UNION ALL SELECT CAST(seq AS BIGINT), CAST(2 AS BIGINT), '' FROM mode
UNION ALL SELECT CAST(seq AS BIGINT), CAST(0 AS BIGINT), 'FILES "system"' FROM cnt
UNION ALL SELECT CAST(seq AS BIGINT), CAST(r AS BIGINT), '  ' || {Q.format(x="path")} FROM kept
UNION ALL SELECT CAST(seq AS BIGINT), CAST(n + 1 AS BIGINT), 'FILES-END' FROM cnt
UNION ALL SELECT CAST(seq AS BIGINT), CAST(n + 2 AS BIGINT), '' FROM cnt
UNION ALL SELECT CAST(page_id * 3 + 2 AS BIGINT), CAST(0 AS BIGINT), 'MESSAGE "' || CAST(nd.n AS VARCHAR) || ' dirs found"' FROM files, nd
UNION ALL SELECT CAST(page_id * 3 + 2 AS BIGINT), CAST(1 AS BIGINT), 'MESSAGE-END' FROM files
UNION ALL SELECT CAST(page_id * 3 + 2 AS BIGINT), CAST(2 AS BIGINT), '' FROM files
""")
def command_session(spark, sf_dir):
    """S4 + T4 end to end: page-derived commands through the protocol
    processor (file modes, find-files with prefix and cap, load-project)."""
    pages = table(spark, sf_dir, "pages")
    return process_commands(page_commands(pages), page_corpus(pages))
