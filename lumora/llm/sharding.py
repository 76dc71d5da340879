"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of slots. Each shard owns several virtual nodes on it, so each slot has a clockwise order
of shards. A row's key picks its slot. In turn, every slot offers its rows to the next shard of its order; a shard takes
them in ring order until its capacity is reached, and what overflows continues clockwise. As capacities add up to the
number of rows and differ by one at most, counts differ by one at most. The plan is made on counts by slot: its size
is the number of slots, whatever the number of rows. Rows need one shuffle of their small columns, by slot.

Nulls: a null key is placed as the text "null"; a null text has no bytes. Repeated keys are ordered by size and
checksum. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 14  # a parameter of the ring: the plan has so many rows at most
VNODES = 128  # of each shard


def _point(text: str, slots: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) * slots >> 32


def ring(shards: int, slots: int = SLOTS, vnodes: int = VNODES) -> list[list[int]]:
    """By slot, all shards in the order in which they are met clockwise."""
    nodes = sorted((_point(f"shard-{s}-{v}", slots), s) for s in range(shards) for v in range(vnodes))
    orders: list[list[int]] = []
    for k in range(len(nodes)):
        seen = dict.fromkeys(nodes[(k + i) % len(nodes)][1] for i in range(len(nodes)))
        orders.append(list(seen))
    out, at = [], 0
    for slot in range(slots):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        out.append(orders[at % len(nodes)])
    return out


def plan(counts: dict[int, int], shards: int, slots: int = SLOTS, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, rank after the last, shard, place in the shard of the first) of every run of rows."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    order = ring(shards, slots, vnodes)
    left = {slot: (0, n) for slot, n in sorted(counts.items())}
    runs, used = [], [0] * shards
    for turn in range(shards):
        over = {}
        for slot, (begin, end) in left.items():
            shard = order[slot][turn]
            n = min(end - begin, room[shard] - used[shard])
            if n:
                runs.append((slot, begin, begin + n, shard, used[shard]))
                used[shard] += n
            if begin + n < end:
                over[slot] = (begin + n, end)
        left = over
    return runs


def place(df: DataFrame, key: str, shards: int = 8, slots: int = SLOTS, vnodes: int = VNODES, by: list[str] | None = None) -> DataFrame:
    """df with columns shard and slot (gapless from 0 in each shard). by: columns that order rows of equal key.

    Carry few and short columns: they are shuffled by ring slot.
    """
    spark = df.sparkSession
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    point = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    placed = df.withColumn("_slot", F.shiftright(point * F.lit(slots), 32).cast("int"))
    counts = {r["_slot"]: r["n"] for r in placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).collect()}  # `slots` rows at most
    runs = spark.createDataFrame(plan(counts, shards, slots, vnodes), "_slot int, _begin long, _end long, shard int, _base long")
    order = Window.partitionBy("_slot").orderBy(F.col(key).asc_nulls_last(), *(by or []))
    ranked = placed.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    # bounded: at most slots * shards runs
    out = ranked.join(F.broadcast(runs), "_slot").where("_rank >= _begin and _rank < _end")
    return out.withColumn("slot", F.col("_base") + F.col("_rank") - F.col("_begin")).drop("_slot", "_begin", "_end", "_base", "_rank")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return place(small, "doc_id", shards, by=["size", "text_crc32"])
