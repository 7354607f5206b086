"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many virtual nodes on a ring of 65,536 arcs. A key belongs to the first node at or
after its arc; where that shard is full it continues clockwise to the next node whose shard has
room. Capacities add up to the number of rows (at most one apart), so row counts are at most one
apart too, and only what overflows leaves its place on the ring.

Only the rows of each arc are counted and sent to the driver (65,536 numbers at any size); there the
arcs are walked once, and the segments of arcs that each shard takes go back as a bounded broadcast.
Rows rank within their arc. Equal rows are one row with a count until the end, so a repeated row,
however often, is never gathered.

Defined cases: a null text has no bytes (size 1, checksum 0); a null doc_id is a key of its own for
each text; a very long text counts as one row; keys that tie in arc and hash stand by id, checksum
and size; rows that repeat are placed one by one; an empty table gives an empty result; more shards
than rows leave shards empty; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import counted_out, table

ARCS = 1 << 16


def ring(shards: int, nodes: int = 128) -> list[tuple[int, int]]:
    """(arc, shard) of each virtual node, in ring order."""
    place = lambda s, k: int.from_bytes(hashlib.blake2b(f"{s}/{k}".encode(), digest_size=8).digest(), "little") % ARCS
    return sorted((place(s, k), s) for s in range(shards) for k in range(nodes))


def walk(counts: dict[int, int], shards: int, nodes: int = 128) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, slot of the first rank) under bounded loads."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    of = ring(shards, nodes)
    arcs = [a for a, _ in of]
    out = []
    for arc in sorted(counts):
        left, rank, k = counts[arc], 0, bisect.bisect_left(arcs, arc)
        while left:
            s = of[k % len(of)][1]
            take = min(left, room[s] - used[s])
            if take:
                out.append((arc, rank, rank + take, s, used[s]))
                used[s] += take
                rank += take
                left -= take
            k += 1
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, size, text_crc32) with their arc, hash and number of rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_many"))
    rows = rows.withColumn("_hash", F.xxhash64("doc_id", "text_crc32", "size"))
    return rows.withColumn("_arc", F.shiftrightunsigned("_hash", 48).cast("int"))


def assign(docs: DataFrame, shards: int, nodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs."""
    rows = keyed(docs)
    counts = {r[0]: int(r[1]) for r in rows.groupBy("_arc").agg(F.sum("_many")).collect()}
    segments = docs.sparkSession.createDataFrame(walk(counts, shards, nodes), "_arc int, _from long, _to long, shard int, _slot long")
    before = W.partitionBy("_arc").orderBy("_hash", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_rank", F.coalesce(F.sum("_many").over(before), F.lit(0)))
    low, high = F.greatest("_rank", "_from"), F.least(F.col("_rank") + F.col("_many"), F.col("_to"))
    # at most ARCS segments and one more for each shard that fills up: a bounded broadcast
    met = rows.join(F.broadcast(segments), "_arc").where(low < high).select("doc_id", "size", "text_crc32", "shard", "_slot", "_from", low.alias("_low"), (high - 1).alias("_high"))
    met = counted_out(met, F.col("_low"), F.col("_high"), "_at")
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_at") - F.col("_from")).alias("slot"))


def shard_texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The documents themselves with shard and slot, joined on id and checksum; equal rows count as one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of = docs.dropDuplicates(["doc_id", "text"]).withColumns({"_crc": F.crc32(text), "_size": (F.octet_length(text) + 1).cast("long")})
    on = of["doc_id"].eqNullSafe(placed["doc_id"]) & (of["_crc"] == placed["text_crc32"]) & (of["_size"] == placed["size"])
    return of.join(placed, on).select(*[of["`" + c.replace("`", "``") + "`"] for c in docs.columns], placed["shard"], placed["slot"])


def op7(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, shards: int = 8) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents") if docs is None else docs, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the shard and slot of each row of the mix."""
    return op7(spark, sf_dir, docs)
