"""Edit-log queries over the ``conversations`` table.

Binding: key ``conv_id``, order ``turn``; a user turn inserts its text at 0,
an assistant turn appends it, a system turn replaces the whole text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_checkpoint_dir
from ..sources.tables import table
from ..streaming import derived as D
from ..streaming import pieces as PC
from ..streaming.edits import conversation_edits, dirty_recompute, fold_edits
from .registry import query

SPLICE_TEXT = "<>"
DIRTY_FROM = 3


@query("splice", sql=f"""
WITH s AS (
  SELECT conv_id, turn, hex(encode(text)) AS h, strlen(text) AS n,
         (conv_id * 7) % (strlen(text) + 1) AS beg FROM conversations),
r AS (
  SELECT conv_id, turn, substr(h, 1, 2 * beg) || hex(encode('{SPLICE_TEXT}'))
           || substr(h, 2 * least(beg + turn, n) + 1) AS rh FROM s)
SELECT conv_id, turn, CAST(strlen(rh) / 2 AS BIGINT) AS n_bytes, md5(unhex(rh)) AS bin_md5,
       try(decode(unhex(rh))) IS NOT NULL AS valid_utf8
FROM r
""")
def splice_q(spark, sf_dir):
    """byte splice of '<>' into every turn; may cut a code point, so the
    result stays BINARY and carries a validity flag."""
    c = table(spark, sf_dir, "conversations")
    n = F.octet_length("text").cast("bigint")
    beg = (F.col("conv_id") * 7) % (n + 1)
    end = F.least(beg + F.col("turn"), n)
    out = T.splice(F.encode("text", "UTF-8"), beg, end, F.encode(F.lit(SPLICE_TEXT), "UTF-8"))
    r = c.select("conv_id", "turn", out.alias("_b"))
    return r.select("conv_id", "turn", F.octet_length("_b").cast("bigint").alias("n_bytes"),
                    F.md5("_b").alias("bin_md5"),
                    F.is_valid_utf8(F.col("_b").cast("string")).alias("valid_utf8"))


FINAL_CTE = """
c AS (SELECT conv_id, turn, role, text,
             max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS ls
      FROM conversations {where}),
a AS (
  SELECT conv_id, count(*) AS n_edits,
         coalesce(string_agg(CASE WHEN role = 'user' AND turn > coalesce(ls, -1) THEN text END, ''
                             ORDER BY turn DESC), '')
         || coalesce(max(CASE WHEN turn = ls THEN text END), '')
         || coalesce(string_agg(CASE WHEN role = 'assistant' AND turn > coalesce(ls, -1) THEN text END, ''
                                ORDER BY turn), '') AS final
  FROM c GROUP BY conv_id)"""


@query("apply_edits", sql=f"""
WITH {FINAL_CTE.format(where="")}
SELECT conv_id, CAST(n_edits AS BIGINT) AS n_edits, CAST(strlen(final) AS BIGINT) AS n_bytes,
       md5(final) AS text_md5
FROM a
""")
def apply_edits_q(spark, sf_dir):
    """Fold every conversation's edit log into its current text."""
    e = conversation_edits(table(spark, sf_dir, "conversations"))
    f = fold_edits(e, "conv_id")
    return f.select("conv_id", "n_edits", F.octet_length("bin").cast("bigint").alias("n_bytes"),
                    F.md5("bin").alias("text_md5"))


@query("dirty_recompute", sql=f"""
WITH {FINAL_CTE.format(where=f"WHERE turn < {DIRTY_FROM}")},
old AS (SELECT conv_id, strlen(final) AS old_len FROM a),
n AS (SELECT conv_id, max(turn) >= {DIRTY_FROM} AS dirty FROM conversations GROUP BY conv_id),
full_c AS (SELECT conv_id, turn, role, text,
                  max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS ls
           FROM conversations),
full_a AS (
  SELECT conv_id,
         coalesce(string_agg(CASE WHEN role = 'user' AND turn > coalesce(ls, -1) THEN text END, ''
                             ORDER BY turn DESC), '')
         || coalesce(max(CASE WHEN turn = ls THEN text END), '')
         || coalesce(string_agg(CASE WHEN role = 'assistant' AND turn > coalesce(ls, -1) THEN text END, ''
                                ORDER BY turn), '') AS final
  FROM full_c GROUP BY conv_id)
SELECT n.conv_id, CAST(old.old_len AS BIGINT) AS old_len, CAST(strlen(full_a.final) AS BIGINT) AS new_len,
       n.dirty
FROM n JOIN old USING (conv_id) JOIN full_a USING (conv_id)
""")
def dirty_recompute_q(spark, sf_dir):
    """State from turns < 3, then a batch of turns >= 3 recomputes only the
    conversations it touches."""
    e = conversation_edits(table(spark, sf_dir, "conversations"))
    state = fold_edits(e.filter(F.col("seq") < DIRTY_FROM), "conv_id").select("conv_id", "bin")
    new = dirty_recompute(state, e.filter(F.col("seq") >= DIRTY_FROM), "conv_id")
    old = state.select("conv_id", F.octet_length("bin").cast("bigint").alias("old_len"))
    return new.join(old, "conv_id").select(
        "conv_id", "old_len", F.octet_length("bin").cast("bigint").alias("new_len"), "dirty")


#: Conversations as files of packages (id modulo 40) that grow turn by turn; three batches.
BATCH_OF = "CASE WHEN turn < 2 THEN 0 WHEN turn < 4 THEN 1 ELSE 2 END"
WORDS_SQL = f"""
t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id::VARCHAR AS key, (conv_id % 40)::VARCHAR AS pkg, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM t),
f AS (SELECT key, pkg, lower(w) AS name, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS n_decl,
             count(*) FILTER (regexp_matches(w, '^[a-z]')) AS n_ref FROM w GROUP BY ALL),
i AS (SELECT pkg, name, sum(n_decl) AS n_decl, sum(n_ref) AS n_ref, count(*) AS n_files FROM f GROUP BY pkg, name)"""


def _word_occurrences(texts):
    words = F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0)))
    return texts.select("key", words.alias("w")).select("key", F.lower("w").alias("name"),
                                                        F.col("w").rlike("^[A-Z]").alias("is_decl"))


def _derived(spark, sf_dir):
    """(folder, batches) of the state after all batches."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/derived-{uuid.uuid4().hex}"
    conv = table(spark, sf_dir, "conversations").withColumn("_b", F.expr(BATCH_OF))
    for b in range(3):
        grown = conv.filter(F.col("_b") <= b).groupBy("conv_id").agg(
            F.max("_b").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(  # one conversation
                F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
        batch = grown.filter(F.col("last") == b).select(F.col("conv_id").cast("string").alias("key"), (
            F.col("conv_id") % 40).cast("string").alias("pkg"), "text")
        D.apply_batch(spark, path, b, batch, list(range(b)), _word_occurrences)
    return path, [0, 1, 2]


@query("derived_symbols", sql=f"""
WITH {WORDS_SQL}
SELECT pkg, name, n_decl::BIGINT AS n_decl, n_ref::BIGINT AS n_ref, n_files::BIGINT AS n_files FROM i
""")
def derived_symbols(spark, sf_dir):
    """The symbol index after three batches of changed files, kept by signed deltas."""
    return D.symbol_state(spark, *_derived(spark, sf_dir))


@query("derived_diagnostics", sql=f"""
WITH {WORDS_SQL}
SELECT f.key, f.name, f.n_ref::BIGINT AS n FROM f JOIN i USING (pkg, name) WHERE f.n_ref > 0 AND i.n_decl = 0
""")
def derived_diagnostics(spark, sf_dir):
    """Undefined names per file after three batches; only files that depend on a change are
    diagnosed again."""
    return D.diagnostics_state(spark, *_derived(spark, sf_dir))


@query("hot_edits", sql="""
WITH RECURSIVE e AS (
  SELECT conv_id % 8 AS doc, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS k,
         (conv_id * 31 + turn * 7) % 3000 AS b, (conv_id * 31 + turn * 7) % 3000 + turn % 5 * 30 AS e,
         hex(encode(coalesce(text, ''))) AS h FROM conversations),
r AS (
  SELECT doc, 0::BIGINT AS k, '' AS h FROM (SELECT DISTINCT doc FROM e)
  UNION ALL
  SELECT r.doc, e.k, substr(r.h, 1, 2 * e.b) || e.h || substr(r.h, 2 * e.e + 1) FROM r JOIN e ON e.doc = r.doc AND e.k = r.k + 1)
SELECT doc::BIGINT AS doc, (strlen(h) // 2)::BIGINT AS n_bytes, md5(h) AS digest, k::BIGINT AS n_edits
FROM r QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k DESC) = 1
""")
def hot_edits(spark, sf_dir):
    """All conversations as edits of eight documents, composed in a tree of scripts."""
    conv = table(spark, sf_dir, "conversations")
    at = (F.col("conv_id") * 31 + F.col("turn") * 7) % 3000
    edits = conv.select((F.col("conv_id") % 8).alias("doc"), (F.col("conv_id") * 1000000 + F.col("turn")).alias("seq"),
                        at.alias("beg"), (at + F.col("turn") % 5 * 30).alias("end"), F.col("text").alias("new_text"))
    return PC.fold_many(edits, "doc", chunk=256).select(
        F.col("doc").cast("long").alias("doc"), F.octet_length("bin").cast("long").alias("n_bytes"),
        F.md5(F.hex("bin")).alias("digest"), "n_edits")
