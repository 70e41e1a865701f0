"""Tile text into tokens with byte offsets, and classify them.

Layout: the input is hash-partitioned by the document key once (the raw text
is the cheapest thing to move), the regex split and ``posexplode`` run inside
that partitioning, and the offset window -- and every later per-document
window (scopes, declarations, the resolution sweep) -- reuses it without
another exchange.  A corpus stored bucketed by the key skips even that shuffle
(pass ``prepartitioned=True``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def tokenize(df: DataFrame, key: str | list[str], text: str, rx: str,
             keep: list[str] | None = None, prepartitioned: bool = False,
             offsets: bool = True, parts: int | None = None) -> DataFrame:
    """X1 + W1: ``(key, *keep, i, tok, beg, end)``; tokens tile the text when the
    pattern can match every character; offsets are UTF-8 bytes, half open.

    ``offsets=False`` skips the byte offsets (``beg``/``end`` are null) and
    their window, for consumers that only count or group tokens;
    ``prepartitioned=True`` skips the shuffle by key; ``parts``: partitions, if not the session's."""
    keys = [key] if isinstance(key, str) else list(key)
    keep = keep or []
    # A stated number of partitions: texts grow some sixtyfold as tokens, so they must not
    # be coalesced by the size they have before.
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df if prepartitioned else df.repartition(n, *keys)
    if not offsets:
        t = src.select(*keys, *keep, F.posexplode(
            F.regexp_extract_all(F.col(text), F.lit(rx), 0)).alias("_pos", "tok"))
        return t.select(*keys, *keep, F.col("_pos").cast("bigint").alias("i"), "tok",
                        F.lit(None).cast("bigint").alias("beg"),
                        F.lit(None).cast("bigint").alias("end"))
    exploded = src.select(*keys, *keep, F.posexplode(
        F.regexp_extract_all(F.col(text), F.lit(rx), 0)).alias("_pos", "tok"))
    # ``i`` is final (BIGINT) before the first window, so every later window
    # ordered by (key, i) finds the rows already sorted and adds no sort.
    exploded = exploded.withColumn("i", F.col("_pos").cast("bigint")).drop("_pos")
    w = (Window.partitionBy(*keys).orderBy("i")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.octet_length("tok")
    return (exploded.withColumn("end", F.sum(size).over(w).cast("bigint"))
            .withColumn("beg", F.col("end") - size)
            .select(*keys, *keep, "i", "tok", "beg", "end"))


IDENT_RX = r"^[\p{L}_]"


def is_ident(tok: Column) -> Column:
    return tok.rlike(IDENT_RX)


def is_space(tok: Column) -> Column:
    return tok.rlike(r"^[ \t\r\n\f]+$")


def text_class(tok: Column) -> Column:
    """X2 for generic text: highlight class of a token (null = no marker).

    Tokens come from the tiling pattern, so the first character decides the
    class; only that character is tested (one short regex for letters)."""
    c = F.substring(tok, 1, 1)
    return (F.when(c.isin(" ", "\t", "\r", "\n", "\f"), F.lit(None).cast("string"))
            .when(tok.isin(rules.GO_KEYWORDS), F.lit(rules.CLS_KEYWORD))
            .when((c >= "0") & (c <= "9"), F.lit(rules.CLS_NUMBER))
            .when((c == '"') & (F.length(tok) > 1), F.lit(rules.CLS_STRING))
            .when(c.isin(".", ",", ";", ":"), F.lit(rules.CLS_SEPARATOR))
            .when(c.isin(*list("-+*/%&|^<>=!~")), F.lit(rules.CLS_OPERATOR))
            .when(c.rlike(r"^[\p{L}_]"), F.lit(rules.CLS_VAR))
            .otherwise(F.lit(rules.CLS_TOKEN)))


def classify(tokens: DataFrame, rule=text_class) -> DataFrame:
    """Adds ``cls`` (rule over the token text) and ``lit_type`` (F10, only
    evaluated on tokens that can be literals)."""
    c = F.substring("tok", 1, 1)
    maybe_lit = c.isin('"', "'", "`", ".") | ((c >= "0") & (c <= "9"))
    return tokens.withColumn("cls", rule(F.col("tok"))).withColumn(
        "lit_type", F.when(maybe_lit, T.literal_type(F.col("tok"))))


def spans(tokens: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """Highlight spans: classified tokens with a class (P5 validity kept)."""
    out = tokens.filter(F.col("cls").isNotNull())
    if size is not None:
        out = out.filter(T.span_valid(F.col("beg"), F.col("end"), size))
    return out.select(key, "i", "cls", "beg", "end", "tok")
