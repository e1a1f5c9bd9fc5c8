"""Operator 4: sharding over fixed virtual slots.

Each record is hashed into one of thousands of virtual slots, whose number never changes. Spark sums rows and bytes
by slot; a versioned map from slots to shards, one row for each slot and version, is stored as a table. The map of
version 1 deals slots out in turn; rebalancing loads the newest map and edits it: a shard keeps its slots while they fit into
an even share of the bytes, and the slots that are left go, largest first, to the emptiest shards; the result is stored as the
next version, beside those before. Records move only with their slot. The driver holds the map alone, as many rows as there are slots.

Defined results: a null text has no bytes and the checksum 0; a null id is hashed by its text like any other; equal
records share a slot; an empty table gives an empty table; columns beyond the id and the text stay behind.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektra.llm.common import fresh_path, settled

SLOTS = 8192
#: Parts of a slot that are numbered apart, so that copies of one record don't meet in one task.
PARTS = 16
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class ShardMap:
    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> ShardMap:
        return ShardMap(1, shards, tuple(slot % shards for slot in range(slots)))

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, size in sizes.items():
            out[self.shard_of[slot]] += size
        return out

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> ShardMap:
        """The next version: even bytes over ``shards`` (as many as now if None), moving few slots."""
        shards = shards or self.shards
        share = sum(sizes.values()) / shards
        shard_of, loads, loose = list(self.shard_of), [0] * shards, []
        for slot in sorted(range(len(shard_of)), key=lambda s: (-sizes.get(s, 0), s)):
            size, at = sizes.get(slot, 0), shard_of[slot]
            if at < shards and loads[at] + size <= share:
                loads[at] += size
            else:
                loose.append(slot)
        heap = [(load, at) for at, load in enumerate(loads)]
        heapq.heapify(heap)
        for slot in loose:
            load, at = heap[0]
            shard_of[slot] = at
            heapq.heapreplace(heap, (load + sizes.get(slot, 0), at))
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(shard_of))

    def grown(self) -> ShardMap:
        """The next version with one more shard, which takes an even number of slots and is the only one to get any."""
        shards, shard_of = self.shards + 1, list(self.shard_of)
        own = [[s for s in range(len(shard_of)) if shard_of[s] == at] for at in range(self.shards)]
        for _ in range(len(shard_of) // shards):
            most = max(own, key=len)
            shard_of[most.pop()] = self.shards
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(shard_of))


def store(spark: SparkSession, shard_map: ShardMap, path: str) -> None:
    """Add one version of a map to the table at ``path``; a version that is there is an error."""
    rows = [(shard_map.shards, slot, shard) for slot, shard in enumerate(shard_map.shard_of)]
    spark.createDataFrame(rows, "shards int, virtual_slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={shard_map.version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of one version, the newest if None: as many as there are slots."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version).select("version", "shards", "virtual_slot", "shard")


def newest(spark: SparkSession, path: str) -> ShardMap | None:
    """The newest map at ``path``, or None where there is none yet."""
    try:
        rows = load(spark, path).orderBy("virtual_slot").collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return ShardMap(rows[0].version, rows[0].shards, tuple(r.shard for r in rows))


def slotted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, part) of each record."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32")
    return rows.select("*", F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"), F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"))


def sharded(docs: DataFrame, shards: int, *, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version): near equal bytes in each shard.

    ``slot`` numbers the records of a shard from 0 without a gap. The map's versions are kept at ``map_path``; a call loads the newest,
    fits it to the bytes and the number of shards, and adds it as the next version.
    """
    spark = docs.sparkSession
    map_path = map_path or fresh_path(spark, "shard-map")
    rows = settled(slotted(docs))
    pieces = settled(rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))  # SLOTS * PARTS rows at most
    sizes = {r.virtual_slot: r.bytes for r in pieces.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect()}  # SLOTS rows at most
    first = newest(spark, map_path)
    if first is None:
        first = ShardMap.even(shards)
        store(spark, first, map_path)
    edited = first.rebalanced(sizes, shards)
    store(spark, edited, map_path)
    shard_map = load(spark, map_path, edited.version).select("virtual_slot", "shard", F.col("version").alias("map_version"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.join(F.broadcast(shard_map), "virtual_slot").select("virtual_slot", "part", "shard", "map_version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(placed), ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
