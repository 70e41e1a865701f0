"""F12 splice, T1 fold, T2 dirty recompute, T3 settings: batch and stream."""

import json
import os

from pyspark.sql import functions as F

from tessera.functions import text as T
import pytest

from tessera.streaming.edits import (apply_edits, compact_state, current_state, dirty_recompute,
                                     edit_stream, edit_stream_batch, fold_edits)
from tessera.streaming.settings import settings_state, settings_stream

EDIT_SCHEMA = "doc_id long, seq long, beg long, end long, new_text string"


def test_splice_cuts_multibyte(spark):
    df = spark.createDataFrame([("aéb",)], "s string")
    out = df.select(T.splice(F.encode("s", "UTF-8"), F.lit(2), F.lit(2), F.encode(F.lit("X"), "UTF-8"))
                    .alias("b")).select(
        F.hex("b").alias("h"), F.is_valid_utf8(F.col("b").cast("string")).alias("ok"),
        T.as_text(F.col("b")).alias("t")).first()
    assert out.h == "61C358A962" and out.ok is False and out.t.startswith("a")


def test_fold_order_and_positions(spark):
    edits = spark.createDataFrame(
        [(1, 2, 0, 0, "<"), (1, 1, 0, 0, "hello"), (1, 3, 6, 6, ">"), (1, 4, 1, 3, "E"),
         (2, 1, 0, 0, "x")], EDIT_SCHEMA)
    got = {r.doc_id: bytes(r.bin).decode() for r in fold_edits(edits, "doc_id").collect()}
    assert got == {1: "<Ello>", 2: "x"}


def test_dirty_recompute_touches_only_batch_keys(spark):
    state = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"cd"))], "doc_id long, bin binary")
    batch = spark.createDataFrame([(2, 5, 2, 2, "!")], EDIT_SCHEMA)
    got = {r.doc_id: (bytes(r.bin), r.dirty) for r in dirty_recompute(state, batch, "doc_id").collect()}
    assert got == {1: (b"ab", False), 2: (b"cd!", True)}


def _write_json(path, rows, name):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_edit_stream_equals_batch(spark, scratch):
    rows = [dict(doc_id=d, seq=s, beg=0, end=0, new_text=f"{d}.{s};") for d in range(4) for s in range(5)]
    src, state, ck = (os.path.join(scratch, x) for x in ("in", "state", "ck"))
    _write_json(src, [r for r in rows if r["seq"] < 2], "a.json")
    reader = lambda: spark.readStream.schema(EDIT_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    edit_stream(reader(), state, ck, "doc_id", buckets=4, trigger={"availableNow": True}).awaitTermination()
    _write_json(src, [r for r in rows if r["seq"] >= 2 and r["doc_id"] % 2 == 0], "b.json")
    _write_json(src, [r for r in rows if r["seq"] >= 2 and r["doc_id"] % 2 == 1], "c.json")
    edit_stream(reader(), state, ck, "doc_id", buckets=4, trigger={"availableNow": True}).awaitTermination()
    got = {r.doc_id: bytes(r.bin) for r in current_state(spark.read.parquet(state), "doc_id").collect()}
    batch = apply_edits(None, spark.createDataFrame(
        [tuple(r.values()) for r in rows], EDIT_SCHEMA), "doc_id")
    want = {r.doc_id: bytes(r.bin) for r in batch.collect()}
    assert got == want


def test_replayed_edit_batch_changes_nothing(spark, scratch):
    state = os.path.join(scratch, "state")

    def batch(*rows):
        return spark.createDataFrame(list(rows), EDIT_SCHEMA)

    def now(path=state):
        return {r.doc_id: bytes(r.bin) for r in current_state(spark.read.parquet(path), "doc_id").collect()}
    edit_stream_batch(batch((1, 0, 0, 0, "ab"), (2, 0, 0, 0, "x")), 0, state, "doc_id", 4)
    second = batch((1, 1, 2, 2, "cd"))
    edit_stream_batch(second, 1, state, "doc_id", 4)
    edit_stream_batch(second, 1, state, "doc_id", 4)
    assert now() == {1: b"abcd", 2: b"x"}
    edit_stream_batch(batch((2, 2, 1, 1, "y"), (3, 2, 0, 0, "z")), 2, state, "doc_id", 4)
    assert now() == {1: b"abcd", 2: b"xy", 3: b"z"}
    with pytest.raises(ValueError):
        edit_stream_batch(second, 3, state, "doc_id", 8)
    with pytest.raises(Exception):  # a state that is not there is no empty state
        edit_stream_batch(second, 1, os.path.join(scratch, "nothing"), "doc_id", 4)
    small = os.path.join(scratch, "small")
    compact_state(spark, state, small, "doc_id", 2)
    assert now(small) == now()


def test_settings_stream_equals_batch(spark, scratch):
    rows = [dict(key=k % 3, seq=k, value=None if k % 4 == 0 else f"v{k}") for k in range(20)]
    src = os.path.join(scratch, "settings")
    _write_json(src, rows[:10], "a.json")
    _write_json(src, rows[10:], "b.json")
    sch = "key long, seq long, value string"
    q = (settings_stream(spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).json(src))
         .writeStream.outputMode("complete").format("memory").queryName("settings_t3")
         .option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("settings_t3").collect()}
    want = {tuple(r) for r in settings_state(spark.createDataFrame(
        [tuple(r.values()) for r in rows], sch)).collect()}
    assert got == want
