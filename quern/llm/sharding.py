"""Shards by fixed virtual slots and a versioned slot-to-shard map (operator 9).

A record's slot is a hash of its id and text and never changes; only the map from the
slots to shards does.  The first version deals slots to shards by their bytes; later versions
move as few slots as level the shards again.  The map has one row for each slot whatever
the number of records.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, written

#: Virtual slots; more of them level larger clusters.
SLOTS = 8192
SHARDS = 24
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, rows long"


def size_of(text: Column) -> Column:
    """A record's bytes: its text in UTF-8 (null: none) and RECORD_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def virtual_slot(slots: int = SLOTS) -> Column:
    """The slot of a record (doc_id, text); null ids are spread by their texts."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def deal_slots(slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """Slot to shard: the largest slots first, each to the shard with the fewest bytes (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, n in sorted(slot_bytes.items(), key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + n, shard))
    return out


def rebalanced(old: dict[int, int], slot_bytes: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """``old`` with the fewest slots moved that bring every shard within ``slack`` of the mean, as far as slots allow.

    Slots of shards beyond ``shards`` and slots new to the map count as homeless.  Overfull
    shards give their largest slots that do not leave them short; homeless slots go to the emptiest.
    """
    new = {s: t for s, t in old.items() if s in slot_bytes and t < shards}
    held = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for s, t in new.items():
        held[t] += slot_bytes[s]
        own[t].append(s)
    mean = sum(slot_bytes.values()) / shards
    homeless = [s for s in slot_bytes if s not in new]
    for t in range(shards):
        for s in sorted(own[t], key=lambda s: (-slot_bytes[s], s)):
            if held[t] <= mean * (1 + slack):
                break
            if held[t] - slot_bytes[s] >= mean * (1 - slack):
                held[t] -= slot_bytes[s]
                homeless.append(s)
                del new[s]
    heap = [(n, t) for t, n in enumerate(held)]
    heapq.heapify(heap)
    for s in sorted(homeless, key=lambda s: (-slot_bytes[s], s)):
        n, t = heapq.heappop(heap)
        new[s] = t
        heapq.heappush(heap, (n + slot_bytes[s], t))
    return new


class SlotMap:
    """A versioned slot-to-shard map, stored as one Parquet folder for each version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v{version}")

    def _write(self, version: int, shard_of: dict[int, int], weights: dict[int, tuple[int, int]]) -> DataFrame:
        rows = [(version, s, t, *weights[s]) for s, t in sorted(shard_of.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/v{version}")
        return self.read(version)

    @staticmethod
    def _weights(slot_sums: DataFrame) -> dict[int, tuple[int, int]]:
        """One row for each slot, so at most SLOTS rows come to the driver."""
        return {r["vslot"]: (r["bytes"], r["rows"]) for r in slot_sums.select("vslot", "bytes", "rows").collect()}

    def create(self, slot_sums: DataFrame, shards: int) -> DataFrame:
        """Version 0 from (vslot, bytes, rows)."""
        w = self._weights(slot_sums)
        return self._write(0, deal_slots({s: b for s, (b, _) in w.items()}, shards), w)

    def rebalance(self, version: int, slot_sums: DataFrame, shards: int) -> DataFrame:
        """The version after ``version``, for new sums or another number of shards."""
        w = self._weights(slot_sums)
        old = {r["vslot"]: r["shard"] for r in self.read(version).select("vslot", "shard").collect()}
        return self._write(version + 1, rebalanced(old, {s: b for s, (b, _) in w.items()}, shards), w)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard under a fresh version-0 map; law ``bytes``.

    slot is the row's place in its shard, gapless from 0: rows of one virtual slot lie
    together, by doc_id, size and CRC.  Window groups are virtual slots, and a running sum over at most SLOTS rows places
    them, so no task holds a shard.  Null texts have size RECORD_BYTES and CRC 0.  Repeated rows
    take places of their own; those of one doc_id and text lie in one virtual slot, so a table that repeats one whole row
    without end would fill one task with it (copies of a text under ids of their own do not).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), virtual_slot(slots).alias("vslot"))
    rows = written(rows, "sized")
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    slot_map = SlotMap(spark, fresh_path(spark, "slot-map")).create(sums, shards)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.select("version", "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")) - 1
    out = rows.withColumn("inside", inside).join(F.broadcast(placed), "vslot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
