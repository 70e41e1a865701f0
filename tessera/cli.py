"""Run an editor command script over a source tree and print the protocol
output -- the batch counterpart of feeding the script to the interactive
server.

    python -m tessera.cli --roots SRC_DIR [--glob '*.go'] --commands SCRIPT
                          [--codeblocks] [--out DIR]

Lines are read with Spark (blank lines and ``#`` comments skipped), numbered in
file order, processed by :func:`tessera.streaming.session.process_commands`,
and printed in (command, line) order -- or written as text to ``--out``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .session import build_session
from .sources.catalog import scan_corpus
from .streaming.session import process_commands


def run(spark: SparkSession, roots: list[str], commands: str, glob: str = "*.go",
        codeblocks: bool = False):
    """The output lines (seq, line_no, line) of a command script."""
    raw = spark.read.text(commands).withColumnRenamed("value", "line")
    # file order: Spark reads one text file in order; the row index numbers it
    cmds = raw.withColumn("seq", F.monotonically_increasing_id()).checkpoint()
    return process_commands(cmds, scan_corpus(spark, roots, glob), codeblocks=codeblocks)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tessera")
    ap.add_argument("--roots", nargs="+", required=True)
    ap.add_argument("--commands", required=True)
    ap.add_argument("--glob", default="*.go")
    ap.add_argument("--codeblocks", action="store_true")
    ap.add_argument("--out")
    a = ap.parse_args(argv)
    spark = spark or build_session()
    lines = run(spark, a.roots, a.commands, a.glob, a.codeblocks)
    if a.out:
        lines.orderBy("seq", "line_no").select("line").write.mode("overwrite").text(a.out)
    else:
        for r in lines.orderBy("seq", "line_no").toLocalIterator():
            print(r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
