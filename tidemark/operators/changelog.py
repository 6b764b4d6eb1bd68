"""Changelogs: (key, seq, op, value columns...), op 1 for puts and 0 for deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import snapshot


def changelog(rows: DataFrame, key: str, seq: str, is_delete: Column, *values: str) -> DataFrame:
    """Any table with a totally ordered column as a changelog."""
    return rows.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.when(is_delete, codec.DELETE).otherwise(codec.PUT).cast("int").alias("op"), *values)


def sequence_batches(batches: DataFrame, start: int = 0, parts: int | None = None) -> DataFrame:
    """Numbers the operations of (batch_id, ops) rows: contiguous, in the order of batches, then of operations.

    The running sum is worked out inside ranges of batch ids and over the ranges, so no task holds all batches."""
    sized = snapshot.running(batches.withColumn("_n", F.size("ops").cast("long")), "_n", "batch_id", parts)
    return sized.withColumn("start_seq", F.lit(start) + F.col("running") - F.col("_n")).drop("running", "_n")


def operations(batches: DataFrame) -> DataFrame:
    """(key, seq, op, value, batch_id) of batches with start_seq; ops are structs (op, key, value)."""
    each = batches.select("batch_id", "start_seq", F.posexplode("ops").alias("_at", "_op"))
    return each.select("_op.key", (F.col("start_seq") + F.col("_at")).alias("seq"), "_op.op", "_op.value", "batch_id")


def accounted_size(log: DataFrame, *by: str) -> DataFrame:
    """Bytes that entries take in memory, over everything or by columns; value is text or binary."""
    entry = codec.memory_bytes(F.col("key"), F.col("value"), F.col("op"))
    return log.groupBy(*by).agg(F.sum(entry.cast("long")).alias("bytes"), F.count("*").alias("entries"))


def next_sequence(log: DataFrame) -> DataFrame:
    """What replay continues with."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).cast("long").alias("next_seq"), F.count("*").alias("replayed"))


def rotations(log: DataFrame, limit: int, parts: int | None = None) -> DataFrame:
    """Entries with `memory`, the number of the memory table that they go to in the order of sequences, by their running size over `limit` bytes."""
    sized = log.withColumn("_bytes", codec.memory_bytes(F.col("key"), F.col("value"), F.col("op")).cast("long"))
    running = snapshot.running(sized, "_bytes", "seq", parts)
    return running.withColumn("memory", F.floor((F.col("running") - F.col("_bytes")) / limit).cast("int")).drop("_bytes", "running")
