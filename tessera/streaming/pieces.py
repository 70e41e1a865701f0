"""T1 for documents with any number of edits: edit scripts compose, so they are reduced in a tree.

A script says how a text is made of an older one: pieces that copy a range of it, and
pieces of new bytes.  Doing one script after another is again a script, and composition is
associative: consecutive edits of a document are made into scripts of ``CHUNK`` edits by
many tasks, scripts are composed ``FAN`` at a time, level by level, and the text is cut once,
from the last script.  What must run in order, the length of the text before each edit, is
one number a row, carried through the sorted edits in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from ..session import ensure_checkpoint_dir

#: Edits in a script of the first level, scripts that a task composes.
CHUNK, FAN = 1024, 16

#: A piece: (from the old text?, first byte, bytes); new bytes count in the script's own.
Piece = tuple[bool, int, int]


def cut(pieces: list[Piece], ends: list[int], beg: int, end: int) -> list[Piece]:
    """The pieces of the bytes beg .. end - 1; ``ends``: running lengths of ``pieces``."""
    out: list[Piece] = []
    i = bisect_right(ends, beg)
    while beg < end and i < len(pieces):
        old, at, n = pieces[i]
        skip = beg - (ends[i] - n)
        take = min(end - beg, n - skip)
        out.append((old, at + skip, take))
        beg += take
        i += 1
    return out


def compose(first: tuple[list[Piece], bytes], then: tuple[list[Piece], bytes]) -> tuple[list[Piece], bytes]:
    """The script that does ``first``, then ``then``."""
    pieces, new = first
    ends, out, shift = list(accumulate(p[2] for p in pieces)), [], len(new)
    for old, at, n in then[0]:
        if old:
            out += cut(pieces, ends, at, at + n)
        else:
            out.append((False, at + shift, n))
    return merge(out), new + then[1]


def merge(pieces: list[Piece]) -> list[Piece]:
    """Pieces that go on where the one before ends, as one; no empty ones."""
    out: list[Piece] = []
    for old, at, n in pieces:
        if n and out and out[-1][0] == old and out[-1][1] + out[-1][2] == at:
            out[-1] = (old, out[-1][1], out[-1][2] + n)
        elif n:
            out.append((old, at, n))
    return out


def edited(size: int, edits: Iterable[tuple[int, int, bytes]]) -> tuple[list[Piece], bytes]:
    """The script of consecutive edits (beg, end, new) of a text of ``size`` bytes."""
    pieces, new, used = [(True, 0, size)] if size else [], [], 0
    for beg, end, text in edits:
        ends = list(accumulate(p[2] for p in pieces))
        total = ends[-1] if ends else 0
        pieces = merge([*cut(pieces, ends, 0, min(beg, total)), (False, used, len(text)),
                        *cut(pieces, ends, min(end, total), total)])
        new.append(text)
        used += len(text)
    return pieces, b"".join(new)


def _lengths(edits: DataFrame, key: str) -> DataFrame:
    """``edits`` (key, seq, beg, end, new, size) with ``no`` (from 0 in a key's order) and ``was``, the
    bytes of the text before the edit."""
    schema = StructType([*edits.schema.fields]).add("no", LongType()).add("was", LongType())
    arrow, at = to_arrow_schema(schema), {c: i for i, c in enumerate(edits.columns)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, no, now, started = None, 0, 0, False
        for b in batches:
            nos, was = [], []
            for k, beg, end, n, size in zip(*(b.column(at[c]).to_pylist() for c in (key, "beg", "end", "_n", "size"))):
                if not started or k != last:
                    last, no, now, started = k, 0, size, True
                nos.append(no)
                was.append(now)
                no += 1
                now = min(beg, now) + n + max(0, now - end)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nos, pa.int64()), pa.array(was, pa.int64())],
                                             schema=arrow)
    ordered = edits.repartition(F.col(key)).sortWithinPartitions(key, "seq", "beg", "end", "new")
    return ordered.mapInArrow(run, schema)


def _row(key: list, chunk: int, script: tuple[list[Piece], bytes], n: int, last: int) -> pd.DataFrame:
    old, at, size = (list(x) for x in zip(*script[0])) if script[0] else ([], [], [])
    return pd.DataFrame({"_key": key, "chunk": [chunk], "old": [old], "at": [at], "n": [size], "new": [script[1]],
                         "n_edits": [n], "last_seq": [last]})


def _script(row) -> tuple[list[Piece], bytes]:
    return [(bool(o), int(a), int(n)) for o, a, n in zip(row.old, row.at, row.n)], bytes(row.new)


def fold_many(edits: DataFrame, key: str, base: DataFrame | None = None, base_col: str = "bin",
              chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(key, bin, n_edits, last_seq)`` as ``edits.fold_edits`` gives it, for documents of any number
    of edits (key, seq, beg, end, new_text).

    Edits are done in the order of seq, then beg, end and new text.  A null base is empty; an
    offset past the text's end means its end, a negative one its begin; a null text is
    empty; an end before the begin copies the bytes between twice, as ``splice`` does."""
    spark = edits.sparkSession
    ensure_checkpoint_dir(spark)
    kind = edits.schema[key].dataType.simpleString()
    zero = F.lit(0).cast("long")
    e = edits.select(F.col(key).alias("_key"), F.col("seq").cast("long").alias("seq"), *[F.greatest(
        F.coalesce(F.col(c).cast("long"), zero), zero).alias(c) for c in ("beg", "end")], F.encode(
        F.coalesce("new_text", F.lit("")), "UTF-8").alias("new"))
    if base is not None:
        sizes = base.select(F.col(key).alias("_key"), F.octet_length(base_col).cast("long").alias("size"))
        e = e.join(sizes, "_key", "left")
    else:
        e = e.withColumn("size", zero)
    e = e.withColumn("size", F.coalesce("size", zero)).withColumn("_n", F.octet_length("new").cast("long"))
    script = (f"_key {kind}, chunk long, old array<boolean>, at array<long>, n array<long>, new binary, "
              "n_edits long, last_seq long")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        made = edited(int(pdf.was.iloc[0]), zip(pdf.beg, pdf.end, map(bytes, pdf.new)))
        return _row([pdf["_key"].iloc[0]], int(pdf.chunk.iloc[0]), made, len(pdf), int(pdf.seq.iloc[-1]))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        made = None
        for row in pdf.itertuples(index=False):
            made = _script(row) if made is None else compose(made, _script(row))
        return _row([pdf["_key"].iloc[0]], int(pdf.chunk.iloc[0]) // fan, made, int(pdf.n_edits.sum()),
                    int(pdf.last_seq.iloc[-1]))
    rows = _lengths(e, "_key").withColumn("chunk", F.floor(F.col("no") / chunk).cast("long"))
    scripts = rows.groupBy("_key", "chunk").applyInPandas(first, script).checkpoint()
    while (scripts.agg(F.max("chunk")).first()[0] or 0) > 0:
        scripts = scripts.groupBy("_key", F.floor(F.col("chunk") / fan).alias("_to")).applyInPandas(join, script).checkpoint()
    if base is not None:
        scripts = scripts.join(base.select(F.col(key).alias("_key"), F.col(base_col).alias("_base")), "_key", "left")
    else:
        scripts = scripts.withColumn("_base", F.lit(None).cast("binary"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base_, old, at, n, new in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                text = base_ or b""
                out.append(b"".join((text if o else new)[a:a + k] for o, a, k in zip(old, at, n)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(6), b.column(7)],
                                             names=[key, "bin", "n_edits", "last_seq"])
    return scripts.select("_key", "_base", "old", "at", "n", "new", "n_edits", "last_seq").mapInArrow(
        run, f"`{key}` {kind}, bin binary, n_edits long, last_seq long")
