"""V1: user span processors.

``process_events`` walks the nested spans of each document in order and calls a processor
before and after every one.  The events of a document (an Euler tour: enter, leave) are
sorted, not grouped: they come to Python in Arrow batches, and the processor's state is
carried from batch to batch, so a document of any number of spans needs one batch at a time.
``process_spans`` hands the spans of one document at a time to a user pandas
function (Arrow batches, one group = one document, bounded by the document
size).  ``LongestSpan`` is the same hook as a Python table function that a SQL
user calls with ``TABLE(...) PARTITION BY``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# Python workers must not need this package on their path: the processors
# below travel to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def longest_token(pdf: pd.DataFrame) -> pd.DataFrame:
    """Longest token of one document by UTF-8 size (first one on ties)."""
    pdf = pdf.sort_values("i", kind="stable")
    sizes = pdf["tok"].map(lambda s: len(s.encode("utf-8")))
    k = int(sizes.to_numpy().argmax())
    row = pdf.iloc[k]
    return pd.DataFrame({"doc_id": [int(row["doc_id"])], "i": [int(row["i"])],
                         "tok": [row["tok"]], "n_bytes": [int(sizes.iloc[k])]})


def visit_events(spans: DataFrame, key: str) -> DataFrame:
    """(key, at, leave, cls): two events per span (key, cls, beg, end; nested or disjoint).

    Sorted by (key, at, order) they are the walk: where spans touch, the inner one is left
    first and the outer one entered first.  An empty span is entered and left at once."""
    size = F.col("end") - F.col("beg")
    empty = size == 0
    enter = F.struct(F.col("beg").alias("at"), F.lit(False).alias("leave"), F.struct(
        F.when(empty, 1).otherwise(2).alias("a"), (-size).alias("b"), F.lit(0).alias("c")).alias("order"))
    leave = F.struct(F.col("end").alias("at"), F.lit(True).alias("leave"), F.struct(
        F.when(empty, 1).otherwise(0).alias("a"), F.when(empty, 0).otherwise(size).alias("b"), F.lit(1).alias("c"))
        .alias("order"))
    return spans.select(key, "cls", F.explode(F.array(enter, leave)).alias("e")).select(
        key, "cls", "e.at", "e.leave", "e.order")


def process_events(events: DataFrame, key: str, processor: Callable[[], Any], schema: str) -> DataFrame:
    """Rows of ``schema`` (the key, then what a processor returns) for every document.

    ``processor()`` makes one for each document: ``before(cls, at)`` and ``after(cls, at)`` are
    called in the order of the walk, then ``result()`` gives its rows, as tuples."""
    out = StructType([events.schema[key], *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, state = None, None
        for b in batches:
            done: list[tuple] = []
            for k, cls, at, leave in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or k != document:
                    if state is not None:
                        done += [(document, *r) for r in state.result()]
                    document, state = k, processor()
                (state.after if leave else state.before)(cls, at)
            yield rows(done)
        if state is not None:
            yield rows([(document, *r) for r in state.result()])
    walk = events.repartition(F.col(key)).sortWithinPartitions(F.col(key), "at", "order")
    return walk.select(key, "cls", "at", "leave").mapInArrow(run, out)


class Nesting:
    """Per class: how many spans, and how deep they lie in one another."""

    def __init__(self):
        self.open: dict[str, int] = {}
        self.seen: dict[str, list[int]] = {}

    def before(self, cls: str, at: int) -> None:
        self.open[cls] = depth = self.open.get(cls, 0) + 1
        n, deepest = self.seen.get(cls, (0, 0))
        self.seen[cls] = [n + 1, max(deepest, depth)]

    def after(self, cls: str, at: int) -> None:
        self.open[cls] -= 1

    def result(self) -> list[tuple]:
        return [(cls, n, deepest) for cls, (n, deepest) in sorted(self.seen.items())]


def process_spans(spans: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame],
                  schema: str) -> DataFrame:
    return spans.groupBy(key).applyInPandas(fn, schema)


def transform_spans(spans: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """DataFrame-level hook: ``fn`` is any DataFrame -> DataFrame job."""
    return spans.transform(fn)


@udtf(returnType="doc_id: bigint, i: bigint, tok: string, n_bytes: bigint")
class LongestSpan:
    """Per partition (one document): the longest token, first one on ties."""

    def __init__(self):
        self.best = None

    def eval(self, row):
        n = len(row["tok"].encode("utf-8"))
        if self.best is None or n > self.best[3] or (
                n == self.best[3] and row["i"] < self.best[1]):
            self.best = (row["doc_id"], row["i"], row["tok"], n)

    def terminate(self):
        if self.best is not None:
            yield self.best
