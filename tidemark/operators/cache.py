"""Block caches as tables: routing to shards, hit rates, invalidation, stale mappings, eviction."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.estimates import ratio

SHARDS = 16
ENTRY_BYTES = 100


def shard_loads(entries: DataFrame, key: str, size: str, capacity: int, shards: int = SHARDS) -> DataFrame:
    """Entries, bytes with overhead, and load of each shard."""
    routed = entries.withColumn("shard", codec.shard(F.col(key), shards))
    loads = routed.groupBy("shard").agg(F.count("*").alias("entries"), (F.sum(size) + ENTRY_BYTES * F.count("*")).cast("long").alias("bytes"))
    return loads.withColumn("load", F.col("bytes") / F.lit(capacity / shards))


def hit_stats(accesses: DataFrame, hit: str, *by: str) -> DataFrame:
    """Requests, hits, misses and rates; 0 where nothing was asked."""
    counted = accesses.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    return counted.withColumn("hit_rate", ratio(F.col("hits"), F.col("requests"))).withColumn("miss_rate", ratio(F.col("misses"), F.col("requests")))


def merge_stats(stats: DataFrame) -> DataFrame:
    total = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("requests", "hits", "misses")])
    return total.withColumn("hit_rate", ratio(F.col("hits"), F.col("requests")))


def invalidate(entries: DataFrame, pattern: str, table: str = "table") -> tuple[DataFrame, DataFrame]:
    """(what stays, blocks and bytes freed of each table that the glob matches)."""
    gone = codec.glob_match(F.col(table), pattern)
    freed = entries.where(gone).groupBy(table).agg(F.count("*").alias("blocks"), F.sum("bytes").cast("long").alias("bytes"))
    return entries.where(~gone | F.col(table).isNull()), freed


def stale(mappings: DataFrame, resident: DataFrame, on: list[str]) -> DataFrame:
    """Mappings whose block is no longer in the cache."""
    return mappings.join(resident, on, "left_anti")


def table_stats(mappings: DataFrame, resident: DataFrame, on: list[str], table: str = "table") -> DataFrame:
    """Blocks of each table, how many are resident, and their bytes."""
    both = mappings.join(resident.select(*on, "bytes").withColumn("_in", F.lit(1)), on, "left")
    stats = both.groupBy(table).agg(F.count("*").alias("blocks"), F.count("_in").alias("resident"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    return stats.withColumn("resident_rate", ratio(F.col("resident"), F.col("blocks")))


class Lru:
    """A cache that holds entries of up to `capacity` bytes and gives up those that were not asked for longest."""

    def __init__(self, capacity: int):
        self.capacity, self.bytes, self.entries = capacity, 0, OrderedDict()

    def get(self, key) -> int | None:
        """The size of an entry, which then is the latest."""
        if key not in self.entries:
            return None
        self.entries.move_to_end(key)
        return self.entries[key][0]

    def value(self, key):
        return self.entries[key][1]

    def put(self, key, size: int, value=None) -> int | None:
        """How many entries had to go; None if this one is too large for the cache, which is empty then."""
        self.delete(key)
        gone = self.prune(self.capacity - size)
        if size > self.capacity:
            return None
        self.entries[key] = size, value
        self.bytes += size
        return gone

    def delete(self, key) -> bool:
        size = self.entries.pop(key, (None, None))[0]
        self.bytes -= size or 0
        return size is not None

    def prune(self, to: int) -> int:
        gone = 0
        while self.bytes > to and self.entries:
            self.bytes -= self.entries.popitem(last=False)[1][0]
            gone += 1
        return gone

    def clear(self) -> None:
        self.entries.clear()
        self.bytes = 0


def lru_trace(accesses: DataFrame, capacity: int) -> DataFrame:
    """(shard, ord, hit, evicted) of an access log (shard, ord, key, size): each access asks for a key and puts it in on a miss.

    A cache goes on from access to access, so a shard is one stream in the order of `ord`; what a
    task holds is the caches' contents, not the log."""

    def run(batches):
        shard, held = None, Lru(capacity)
        for batch in batches:
            hits, gone = [], []
            for s, key, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "size")), strict=True):
                if s != shard:
                    shard, held = s, Lru(capacity)
                hit = held.get(key) is not None
                hits.append(hit)
                gone.append(0 if hit else held.put(key, size) or 0)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("ord"), pa.array(hits, pa.bool_()), pa.array(gone, pa.int32())], ["shard", "ord", "hit", "evicted"])

    kinds = dict(accesses.dtypes)
    rows = accesses.select("shard", "ord", "key", "size").repartition("shard").sortWithinPartitions("shard", "ord")
    return rows.mapInArrow(run, f"shard {kinds['shard']}, ord {kinds['ord']}, hit boolean, evicted int")


def accesses(log: DataFrame, key: str, at: str) -> DataFrame:
    """How often each entry was asked for, and when last."""
    return log.groupBy(key).agg(F.count("*").alias("accesses"), F.max(at).alias("last_access"))
