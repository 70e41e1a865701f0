"""T4: dispatch of commands by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def command_rules(spark, min_args: list[tuple[str, int]] | None = None) -> DataFrame:
    rows = min_args if min_args is not None else rules.COMMAND_MIN_ARGS
    return spark.createDataFrame(rows, "name string, min_args int")


def validate_commands(cmds: DataFrame, rule_df: DataFrame) -> DataFrame:
    """Status ok / too_few / unknown and the protocol message.

    The rule table is a fixed, small dimension (one row per command name), so
    broadcasting it is bounded by construction."""
    j = cmds.join(F.broadcast(rule_df), "name", "left")
    repr_ = T.render_command(F.col("no"), F.col("name"), F.col("args"))
    status = (F.when(F.col("min_args").isNull(), F.lit("unknown"))
              .when(F.size("args") < F.col("min_args"), F.lit("too_few"))
              .otherwise(F.lit("ok")))
    msg = (F.when(status == "unknown", F.format_string(rules.MSG_UNKNOWN_COMMAND, repr_))
           .when(status == "too_few",
                 F.format_string(rules.MSG_MIN_ARGS, F.col("min_args"), repr_)))
    return j.withColumn("status", status).withColumn("msg", msg)


def route_batch(cmds: DataFrame, routes: dict[str, Callable[[DataFrame], None]]) -> None:
    """Run one handler per command name over a (micro-)batch.  The batch is
    persisted once so that each route filters it without re-reading."""
    cmds = cmds.persist()
    try:
        for name, handler in routes.items():
            handler(cmds.filter(F.col("name") == name))
    finally:
        cmds.unpersist()


def route_stream(cmds: DataFrame, routes: dict[str, Callable[[DataFrame], None]],
                 checkpoint: str, trigger: dict | None = None):
    """Streaming form: ``foreachBatch`` applies :func:`route_batch`."""
    w = cmds.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _id: route_batch(batch, routes))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
