"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2 ** ``ring_bits`` places.  Every shard owns ``vnodes`` places by hash; a key
hashes to a place and belongs to the first virtual node clockwise.  A shard takes its own
keys up to its capacity; the keys that overflow continue clockwise to the next virtual
node whose shard has room.  Capacities add up to the number of rows (floor or ceiling of
the mean), so counts differ by one at most, and only overflowing keys leave their node.

Which keys of a place overflow is a matter of rank inside the place, so the walk needs
only the number of keys per place: a table bounded by the ring, whatever the data.  The
rows meet its result in one equi-join on the place, after one window inside places.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, row_hash


#: Shares of a place's rows.
SALTS = 16


def ring(shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise."""
    points = []
    for shard in range(shards):
        for i in range(vnodes):
            h = int.from_bytes(hashlib.sha256(f"{shard}:{i}".encode()).digest()[:8], "big")
            points.append((h >> (64 - ring_bits), h, shard))
    return [(place, shard) for place, _, shard in sorted(points)]


def walk(counts: dict[int, int], shards: int, vnodes: int, ring_bits: int
         ) -> list[tuple[int, int, int, int, int]]:
    """(place, lo, hi, shard, base): keys of rank lo..hi-1 at ``place`` go to ``shard``, where
    they hold the slots from ``base`` on.  ``counts``: keys per place."""
    nodes = ring(shards, vnodes, ring_bits)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def give(place: int, lo: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((place, lo, lo + n, shard, filled[shard]))
            filled[shard] += n
            room[shard] -= n
        return n

    overflow = []
    at = 0
    for place in sorted(counts):
        while at < len(nodes) and nodes[at][0] < place:
            at += 1
        node = at % len(nodes)
        n = counts[place]
        taken = give(place, 0, n, nodes[node][1])
        if taken < n:
            overflow.append((place, taken, n, node))
    ahead = list(range(1, len(nodes))) + [0]  # the next node that may have room

    def next_with_room(node: int) -> int:
        passed = []
        while not room[nodes[node][1]]:
            passed.append(node)
            node = ahead[node]
        for p in passed:
            ahead[p] = node
        return node

    for place, lo, n, node in overflow:
        while lo < n:
            node = next_with_room(node)
            lo += give(place, lo, n - lo, nodes[node][1])
    return out


def place_of(key: Column, ring_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - ring_bits).cast("int")


def assign_shards(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", shards: int = 40,
                  vnodes: int = 128, ring_bits: int = 15, ties: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns) with shard and slot (0.. without gaps inside a shard).

    The key is the id; ``ties`` are columns that order rows of one id.  Equal rows may
    swap their slots; a null id is a key like any other; fewer rows than shards leave the
    last shards empty; an empty table returns no rows.  Columns named shard or slot are
    replaced, all others stay.

    Rows of one place are ranked by salt, then inside it, so an id that many rows share is
    ranked in as many tasks as its ties tell apart."""
    place, salt, order, rank, before, lo, hi, to, base = names = fresh(
        docs, "_place", "_salt", "_hash", "_rank", "_before", "_lo", "_hi", "_shard", "_base")
    columns = [id_col, *(ties or [])]
    placed = [place_of(F.col(id_col), ring_bits).alias(place),
              F.pmod(row_hash(docs, 0, columns), F.lit(SALTS)).cast("int").alias(salt)]
    held = docs.select(*placed).groupBy(place, salt).agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in  # bounded by the ring: 2 ** ring_bits rows
              held.groupBy(place).agg(F.sum("n")).collect()}
    pieces = spark.createDataFrame(walk(counts, shards, vnodes, ring_bits),
                                   f"{place} int, {lo} long, {hi} long, {to} int, {base} long")
    ahead = Window.partitionBy(place).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    earlier = held.select(place, salt, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))  # places x salts
    inside = Window.partitionBy(place, salt).orderBy(order, *columns)
    ranked = docs.select("*", *placed, F.xxhash64(id_col).alias(order)).withColumn(
        rank, F.row_number().over(inside) - 1).join(earlier, [place, salt]).withColumn(
        rank, F.col(rank) + F.col(before))
    return ranked.join(F.broadcast(pieces), place).filter((F.col(lo) <= F.col(rank)) & (F.col(rank) < F.col(hi))) \
        .withColumn("shard", F.col(to)).withColumn("slot", F.col(base) + F.col(rank) - F.col(lo)).drop(*names)


def shard_report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shards: int = 40) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null: the law is rows)."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    return assign_shards(spark, slim, "_id", shards, ties=["text_crc32", "size"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
