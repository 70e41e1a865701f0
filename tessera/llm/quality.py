"""Quality rules with risk-controlled thresholds.

Every document has a few rates (symbols, capitals, repeated words, repeated lines).  A
rule rejects a document whose rate is above a cutoff, and cutoffs are chosen per stratum
on labelled documents so that good ones are rarely lost: with n good documents of which
k lie above a cutoff, the exact binomial tail P(Bin(n, risk) <= k) is the p-value of
"the cutoff loses more than ``risk`` of the good documents".  Candidate cutoffs are
tested from the loosest on and the first that does not reject this ends the sequence
(fixed-sequence testing needs no further correction); rules times strata are corrected
by Bonferroni.  With probability 1 - ``delta`` no rule in any stratum loses more than
its share ``risk / rules`` of the good documents, so no stratum loses more than ``risk``.
Of the cutoffs that passed, the loosest that catches most bad labels is taken.  A stratum
with too few good documents for any cutoff to pass rejects by the base rules alone.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_WHITE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]

#: Rate of each rule, and its candidate cutoffs from the loosest on.
RATES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_upper", "word_chars"),
         "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines")}
CUTOFFS = [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]


def stats(data: bytes) -> tuple[int, ...]:
    """The counts named by STATS, of a whole UTF-8 text.

    Words are runs of other than ASCII white space; n_repeat_words counts the words inside
    5-word windows that occur twice or more; n_dup_lines the lines with a word that equal
    an earlier line; n_lines all lines with a word."""
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        def windows():
            return zip(*(words[i:] for i in range(WINDOW)))
        if len(set(windows())) < n - WINDOW + 1:
            seen = Counter(windows())
            upto = 0  # words before it are counted
            for i, w in enumerate(windows()):
                if seen[w] > 1:
                    repeated += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return (n, len(data.translate(None, _WHITE + _CONTINUATION)),
            len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
            len(data) - len(data.translate(None, _UPPER)), len(lines))


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the STATS columns of every row (null text: no words)."""
    return map_texts(docs, keep, text_col, stats, ", ".join(f"{c} long" for c in STATS),
                     [pa.int64()] * len(STATS))


#: 128 bits that tell texts apart.
COPY = ["_copy0", "_copy1"]


def _with_copies(slim: DataFrame) -> DataFrame:
    return slim.withColumns({c: F.xxhash64(F.lit(i), F.coalesce(F.col("_t").cast("string"), F.lit("")))
                             for i, c in enumerate(COPY)})


def rate(rule: str) -> Column:
    part, whole = RATES[rule]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k).  The terms are summed from k away from the mean, each from the one
    before it, until they no longer count: some multiples of sqrt(n) terms."""
    if k >= n or k < 0:
        return float(k >= n)
    up = k >= (n + 1) * p
    i = k + 1 if up else k
    first = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    term = total = 1.0
    while term > 1e-18 * total and (i < n if up else i > 0):
        term *= (n - i) * p / ((i + 1) * (1 - p)) if up else i * (1 - p) / ((n - i + 1) * p)
        i += 1 if up else -1
        total += term
    side = min(1.0, math.exp(first) * total)
    return 1.0 - side if up else side


def choose(good: list[int], bad: list[int], n: int, risk: float, level: float) -> float | None:
    """The cutoff for one rule in one stratum; good[j], bad[j]: documents above CUTOFFS[j]."""
    best, caught = None, 0
    for cut, g, b in zip(CUTOFFS, good, bad):
        if n == 0 or binomial_tail(g, n, risk) > level:
            break
        if b > caught:
            best, caught = cut, b
    return best


def calibrate(spark: SparkSession, measured: DataFrame, labels: DataFrame, id_col: str,
              stratum_col: str, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, one cut_<rule> column per rule; null: off) from all labelled texts.

    ``labels``: (id, quality 0/1); null labels are left out, an id with both counts as bad.
    Copies are no independent observations: a text that several labelled rows of a stratum
    hold (COPY, a hash of it) counts once, as bad if any of them is.
    The counts above each cutoff are one mergeable aggregate per stratum, so a stratum of
    a third of all rows costs one row per task."""
    truth = labels.filter("quality is not null").groupBy(F.col(id_col).alias("_label_id")).agg(
        F.min("quality").alias("_good"))
    rows = measured.filter(~base_failed()).join(
        truth, F.col(id_col) == F.col("_label_id")).select(
        _stratum(stratum_col).alias("stratum"), "_good", *COPY, *[rate(r).alias(f"_{r}") for r in RATES])
    rows = rows.groupBy("stratum", *COPY).agg(
        F.min("_good").alias("_good"), *[F.min(f"_{r}").alias(f"_{r}") for r in RATES])
    above = [F.count_if((F.col(f"_{r}") > c) & (F.col("_good") == g)).alias(f"{r}_{g}_{j}")
             for r in RATES for g in (0, 1) for j, c in enumerate(CUTOFFS)]
    counts = materialize(spark, rows.groupBy("stratum").agg(
        F.count_if(F.col("_good") == 1).alias("n"), *above), "counts")
    level = delta / (len(RATES) * max(1, counts.count()))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        out = {"stratum": [row["stratum"]]}
        for r in RATES:
            good, bad = ([int(row[f"{r}_{g}_{j}"]) for j in range(len(CUTOFFS))] for g in (1, 0))
            out[f"cut_{r}"] = [choose(good, bad, int(row["n"]), risk / len(RATES), level)]
        return pd.DataFrame(out)

    return materialize(spark, counts.groupBy("stratum").applyInPandas(
        pick, "stratum string, " + ", ".join(f"cut_{r} double" for r in RATES)), "cutoffs")


def _stratum(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str) -> DataFrame:
    """``measured`` with base_failed and kept.  A stratum without cutoffs keeps what the
    base rules keep."""
    over = F.lit(False)
    for r in RATES:
        over = over | F.coalesce(rate(r) > F.col(f"cut_{r}"), F.lit(False))
    return measured.withColumn("_stratum", _stratum(stratum_col)).join(
        cutoffs.withColumnRenamed("stratum", "_stratum"), "_stratum", "left") \
        .withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & ~over) \
        .drop("_stratum", *[f"cut_{r}" for r in RATES])


def quality_verdicts(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05,
                     delta: float = 0.05) -> DataFrame:
    """Per row: id, the STATS counts, base_failed, kept.

    Null and empty texts have no words and fail the base rules.  Repeated rows each return
    (copies count once in the bounds); null ids have no label; null strata are one
    stratum; empty tables give no rows, no labels no cutoffs.  Other columns are ignored."""
    src = docs.select(F.col(id_col), F.col(text_col).alias("_t"), F.col(stratum_col).alias("_s"))
    measured = materialize(spark, measure(_with_copies(src), [id_col, "_s", *COPY], "_t"), "measured")
    cutoffs = calibrate(spark, measured, labels, id_col, "_s", risk, delta)
    return judge(measured, cutoffs, "_s").drop("_s", *COPY)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05,
              delta: float = 0.05) -> DataFrame:
    """``docs`` (all columns) without the rows that the verdict rejects."""
    # Counts of all rows meet the labels: small rows are shuffled, no texts.
    slim = docs.select(F.col(id_col), F.col(text_col).alias("_t"), F.col(stratum_col).alias("_s"))
    cutoffs = calibrate(spark, measure(_with_copies(slim), [id_col, "_s", *COPY], "_t"), labels, id_col, "_s", risk, delta)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # theirs may clash with the counts
    hidden = docs.select([F.col(f"`{c}`").alias(h) for c, h in names.items()])
    judged = judge(measure(hidden, list(names.values()), names[text_col]), cutoffs, names[stratum_col])
    return judged.filter("kept").select([F.col(h).alias(c) for c, h in names.items()])
