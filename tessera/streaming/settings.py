"""Last-write-wins settings per key (batch and stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settings_state(writes: DataFrame, key: str = "key", seq: str = "seq",
                   value: str = "value") -> DataFrame:
    """Final value per key; a write with a null value clears the key.

    ``max`` of a (seq, value) struct is a mergeable aggregate, so a hot key is
    combined map-side before the shuffle."""
    last = F.max(F.struct(F.col(seq).alias("seq"), F.col(value).alias("value")))
    return (writes.groupBy(key).agg(last.alias("_w"))
            .select(key, F.col("_w.value").alias(value), F.col("_w.seq").alias(seq)))


def settings_stream(writes: DataFrame, key: str = "key", seq: str = "seq",
                    value: str = "value") -> DataFrame:
    """Streaming form: the same aggregate, kept in the state store
    (output mode ``complete`` or ``update``)."""
    return settings_state(writes, key, seq, value)
