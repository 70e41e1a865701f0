"""Command lines as a table (batch) or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def keep_command_line(line: Column) -> Column:
    """Blank lines and '#' comments are skipped."""
    t = F.trim(line)
    return (t != "") & ~t.startswith("#")


def read_commands(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Command log files -> (line) rows that hold a command."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "line").filter(
        keep_command_line(F.col("line")))


def parse_commands(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds ``no``, ``name``, ``args`` (F2) to every command line."""
    cmd = T.parse_command(F.col(line_col))
    return lines.withColumn("_cmd", cmd).select(
        "*", F.col("_cmd.no").alias("no"), F.col("_cmd.name").alias("name"),
        F.col("_cmd.args").alias("args")).drop("_cmd")


def events_as_commands(events: DataFrame) -> DataFrame:
    """Binding of the ``events`` table as a command log:
    ``event_type -n event_id "user <user_id>" k`` with k from ``props``."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    line = F.concat(F.col("event_type"), F.lit(" -n "), F.col("event_id").cast("string"),
                    F.lit(' "user '), F.col("user_id").cast("string"), F.lit('" '), k)
    return events.select("event_id", "user_id", "event_type", k.alias("k"),
                         line.alias("line"))
