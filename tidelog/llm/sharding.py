"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into thousands of slots and never change slot; only the map from
slots to shards is edited.  Its first version packs the bytes of the slots, the
largest first, into the lightest shard; a later version moves just the slots
that bring the shards level again.  `sharded` stores both: the map for the shards
asked for, and its edit for one shard more.  Equal texts share a slot, so groups
of copies stay in one shard, unless a group has more than half of a shard's
bytes or rows: such groups, at most 4 for each shard, are spread by id over all
slots, so no slot, and no task that numbers one, holds a group of any size.

The law held is `bytes`: shard sizes nearly equal.  A null text counts no
bytes; every record counts one more.  Very long texts count whole.  Repeated
rows are records of their own.  Null ids hash as such.  Extra columns are left
out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, ready

SLOTS = 4096
#: Parts of a slot for numbering, so that no task has to order a whole slot.
PARTS = 16


def packed(weights: dict[int, int], shards: int) -> dict[int, int]:
    """slot -> shard, largest slots first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weight, shard))
    return out


def rebalanced(old: dict[int, int], weights: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """An edited map for `shards` shards: slots only leave shards above their share, or that are gone."""
    new, loads, own = dict(old), [0] * shards, [[] for _ in range(shards)]
    loose = []
    for slot, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        shard = old.get(slot)
        if shard is None or shard >= shards:
            loose.append(slot)
        else:
            loads[shard] += weight
            own[shard].append(slot)
    share = sum(weights.values()) / shards
    for shard in range(shards):
        for slot in list(own[shard]):
            if loads[shard] - weights[slot] >= share * (1 - slack) and loads[shard] > share * (1 + slack):
                loads[shard] -= weights[slot]
                loose.append(slot)
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda x: (-weights[x], x)):
        load, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return new


class SlotMap:
    """The stored versions of a slot-to-shard map, a folder of (slot, shard) tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, version: int, slots: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(slots.items()) or [], "slot int, shard int")
        rows.coalesce(1).write.parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        """At most SLOTS rows."""
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")

    def slots(self, version: int) -> dict[int, int]:
        return {r.slot: r.shard for r in self.load(version).collect()}


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )


def slotted(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """rows of records() with their virtual slot."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    heavy = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy = heavy.where((F.col("bytes") > total / (2 * shards)) | (F.col("n") > n / (2 * shards)))
    large = [r[0] for r in heavy.select("group").collect()]  # fewer than 4 for each shard
    key = F.xxhash64("group")
    if large:
        key = F.when(F.col("group").isin(large), F.xxhash64("group", "doc_id")).otherwise(key)
    return rows.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    return dict(rows.groupBy("virtual_slot").agg(F.sum("size")).collect())  # a row for each slot


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless), grown_shard, virtual_slot, edited_shard (by the map's second version, for one shard more)."""
    spark = ready(docs.sparkSession)
    scratch = scratch or Scratch(spark, "sharding")
    rows = scratch.table(records(docs, id_col, text_col), "records")
    rows = slotted(rows, shards, slots)
    stored = SlotMap(spark, scratch.path("map"))
    weights = slot_bytes(rows)
    stored.save(1, packed(weights, shards))
    stored.save(2, rebalanced(stored.slots(1), weights, shards + 1))
    both = stored.load(1).join(stored.load(2).select("slot", F.col("shard").alias("edited_shard")), "slot")
    placed = rows.join(F.broadcast(both), rows["virtual_slot"] == F.col("slot")).drop("slot")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "group"), F.lit(PARTS)).cast("int"))
    counts = placed.groupBy("shard", "virtual_slot", "part").agg(F.count("*").alias("n"))
    order = W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))  # slots x PARTS rows
    within = W.partitionBy("virtual_slot", "part").orderBy("doc_id", "group")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "edited_shard",
    )
