"""Result blocks as text lines, and a tee of input/output logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import dense_number


def block_lines(rows: DataFrame, group: str, item: str, block: str,
                header: list[Column], render: Callable[[Column], Column],
                order: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``(group, line_no, line)`` for one block per group:

        BLOCK header...        (line 0)
          row                  (lines 1..n, rows sorted by ``item``)
        BLOCK-END              (line n+1)
                               (line n+2, empty)

    ``groups`` (one row per group, with the columns of ``header``) names the groups; one
    without rows gets its header and end.  Without it the groups are those of the rows,
    and ``header`` may use the group column only.

    Line numbers come from one range-partitioned numbering of all rows minus
    the first number of each group, so a group holding most rows is still
    numbered by many tasks; nothing is collected per group.  ``item`` is the
    rendered column; ``order`` (default: ``item``) sorts the rows."""
    order = order or [item]
    cols = list(dict.fromkeys([group, item, *order]))
    numbered = dense_number(rows.select(*cols), [F.col(group)] + [F.col(c) for c in order], "_no")
    per = numbered.groupBy(group).agg(F.min("_no").alias("_first"),
                                      F.count(F.lit(1)).alias("_n"))
    body = numbered.join(per, group).select(
        group, (F.col("_no") - F.col("_first") + 1).alias("line_no"),
        render(F.col(item)).alias("line"))
    if groups is not None:
        per = groups.join(per, group, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ln = lambda no, text: F.struct(no.cast("bigint").alias("line_no"), text.alias("line"))
    frame = per.select(group, F.explode(F.array(
        ln(F.lit(0), F.concat_ws(" ", F.lit(block), *header)),
        ln(F.col("_n") + 1, F.lit(f"{block}-END")),
        ln(F.col("_n") + 2, F.lit("")))).alias("_l")).select(
        group, F.col("_l.line_no").alias("line_no"), F.col("_l.line").alias("line"))
    return body.unionByName(frame)


def write_blocks(lines: DataFrame, group: str, path: str) -> None:
    """Write blocks as text, one folder per group; its files in name order, and the lines in
    each, are in block order.  Ranges of (group, line) are dealt out, so a block that holds
    most lines is written by many tasks."""
    (lines.repartitionByRange(F.col(group), F.col("line_no"))
     .sortWithinPartitions(group, "line_no")
     .select(group, "line").write.mode("overwrite").partitionBy(group).text(path))


def tee_batch(batch: DataFrame, in_path: str, out_path: str,
              result: Callable[[DataFrame], DataFrame]) -> None:
    """Append the input batch and its result to two logs."""
    batch.select(F.col("line").alias("value")).write.mode("append").text(in_path)
    result(batch).write.mode("append").text(out_path)


# --- the other result blocks: header columns and one row renderer each -------

def _q(c: Column) -> Column:
    from ..functions.text import quote_ascii
    return quote_ascii(c)


def errors_lines(diags: DataFrame, group: str, no: Column | None = None,
                 fname: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``ERRORS "file" no`` then ``  LVL beg end "msg"`` per diagnostic,
    one block per ``group`` (the file name column unless ``fname``, a column of
    ``groups``, is given)."""
    no = no if no is not None else F.lit(0)
    row = F.concat_ws(" ", F.lit(" "), F.col("lvl"), F.col("beg").cast("string"),
                      F.col("end").cast("string"), _q(F.col("msg")))
    return block_lines(diags.withColumn("_row", row), group, "_row", "ERRORS",
                       [_q(F.col(fname or group)), no.cast("string")], lambda c: c,
                       order=["beg", "end", "_row"], groups=groups)


def fontify_lines(spans: DataFrame, fname: str, size: Column, no: Column | None = None) -> DataFrame:
    """``FONTIFY "file" "file" no 0 size`` then ``  Class beg end``."""
    no = no if no is not None else F.lit(0)
    row = F.concat_ws(" ", F.lit(" "), F.col("cls"), F.col("beg").cast("string"),
                      F.col("end").cast("string"))
    d = spans.withColumn("_row", row)
    header = [_q(F.col(fname)), _q(F.col(fname)), no.cast("string"), F.lit("0"), size.cast("string")]
    return block_lines(d, fname, "_row", "FONTIFY", header, lambda c: c,
                       order=["beg", "end", "_row"])


def complete_lines(choices: DataFrame, cursor: str, name: Column, beg: Column, end: Column,
                   pref: Column) -> DataFrame:
    """``COMPLETE "name" beg end "pref"`` then ``  KIND "n" "n" beg end``."""
    from ..functions.text import kind_label
    row = F.concat_ws(" ", F.lit(" "), kind_label(F.col("kind")), _q(F.col("choice")),
                      _q(F.col("choice")), F.col("cbeg").cast("string"), F.col("cend").cast("string"))
    d = choices.withColumn("_row", row)
    header = [_q(name), beg.cast("string"), end.cast("string"), _q(pref)]
    return block_lines(d, cursor, "_row", "COMPLETE", header, lambda c: c, order=["_row"])


def usages_lines(usages: DataFrame, group: str, kind: str, pfx: str, system: bool) -> DataFrame:
    """S5e: ``USAGES kind "pfx" system`` then one row per usage, by name."""
    from ..functions import rules
    row = F.concat_ws(" ", F.col("role"), _q(F.col("fname")), F.lit("0"), F.lit("0"), F.lit("0"),
                      _q(F.lit("")), F.lit("0"), F.lit("0"), _q(F.col("name")), F.lit("0"),
                      F.lit("0"), F.lit(rules.USAGE_NOREC))
    d = usages.withColumn("_row", row)
    header = [F.lit(kind), _q(F.lit(pfx)), F.lit("system" if system else "non-system")]
    return block_lines(d, group, "_row", "USAGES", header, lambda c: c, order=["name", "_row"])


def message_text(msg: Column) -> Column:
    """S5f: a MESSAGE block as one string."""
    return F.concat(F.lit("MESSAGE "), _q(msg), F.lit("\nMESSAGE-END\n\n"))
