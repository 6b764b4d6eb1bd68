"""What a sorted table holds: prefix sharing, restart points, blocks and their index, statistics.

Runs are worked off in ranges of keys, so a run is as many tasks as there are ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import snapshot

RESTART = 16
BLOCK_BYTES = 4096
FULL, ALMOST, LARGE = 0.85, 0.75, 0.50


def order_violations(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, in the order of `position`, whose key is not above the one before."""
    return snapshot.previous(rows, "key", "position", by=by).where(F.col("before") >= F.col("key"))


def prefix_sharing(rows: DataFrame, *by: str) -> DataFrame:
    """Shared and own bytes of each key after the one before it; `by` are the columns that name a run."""
    shared = codec.common_prefix(F.col("before"), F.col("key"))
    return snapshot.previous(rows, "key", by=by).withColumn("shared", shared).withColumn("own", (F.length("key") - F.col("shared")).cast("int")).drop("before")


def restart_points(rows: DataFrame, *by: str, every: int = RESTART) -> DataFrame:
    """Each `every`-th key of a run, with its index."""
    at = snapshot.numbered(rows, by=by).withColumn("entry", (F.col("running") - 1).cast("int")).drop("running")
    return at.where(F.col("entry") % every == 0)


def blocks(rows: DataFrame, size: Column, *by: str, bytes_each: int = BLOCK_BYTES) -> DataFrame:
    """Rows with the block of their run that they fall into: a running size over 85 % of a block."""
    sized = snapshot.running(rows.withColumn("_bytes", size.cast("long")), "_bytes", by=by)
    return sized.withColumn("block", F.floor((F.col("running") - 1) / int(bytes_each * FULL)).cast("int")).drop("_bytes", "running")


def block_index(rows: DataFrame, size: Column, *by: str) -> DataFrame:
    """Last key, entries and bytes of each block."""
    sized = blocks(rows.withColumn("_size", size), F.col("_size"), *by)
    return sized.groupBy(*by, "block").agg(F.max("key").alias("last_key"), F.count("*").alias("entries"), F.sum("_size").cast("long").alias("bytes"))


def block_of(index: DataFrame, key) -> DataFrame:
    """The block to look into: the first whose last key is not below `key`, else the last one."""
    first = index.where(F.col("last_key") >= key).orderBy("last_key").limit(1)
    last = index.orderBy(F.desc("last_key")).limit(1)
    return first.withColumn("_o", F.lit(0)).unionByName(last.withColumn("_o", F.lit(1))).orderBy("_o").limit(1).drop("_o")


def fill(used: Column, capacity: Column) -> Column:
    """full, almost, large or fits."""
    share = used / capacity
    return F.when(share > FULL, "full").when(share > ALMOST, "almost").when(share > LARGE, "large").otherwise("fits")


def table_stats(rows: DataFrame, size: Column, *by: str) -> DataFrame:
    sized = blocks(rows.withColumn("_size", size), F.col("_size"), *by)
    stats = sized.groupBy(*by).agg(F.count("*").alias("entries"), F.countDistinct("block").alias("blocks"), F.sum("_size").cast("long").alias("bytes"), F.min("key").alias("smallest"), F.max("key").alias("largest"))
    return stats.withColumn("entries_per_block", F.col("entries") / F.col("blocks"))
