"""Counters of a database, and of scans over levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.estimates import ratio


def operations(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count_if(F.col("op") == 1).alias("puts"), F.count_if(F.col("op") == 0).alias("deletes"), F.countDistinct("key").alias("keys"), F.max("seq").alias("last_seq"))


def lookups(answers: DataFrame) -> DataFrame:
    """Gets, successful gets and hit rate of multi_get's answers."""
    counted = answers.agg(F.count("*").alias("gets"), F.count_if(F.col("found")).alias("found"))
    return counted.withColumn("hit_rate", ratio(F.col("found"), F.col("gets")))


def scan_stats(files: DataFrame) -> DataFrame:
    """Levels with data and files read by a full scan."""
    counted = files.agg(F.countDistinct("level").alias("levels"), F.count("*").alias("files"))
    return counted.withColumn("files_per_level", ratio(F.col("files"), F.col("levels")))


def status(log: DataFrame, files: DataFrame, flushed: int) -> DataFrame:
    """Entries not flushed yet, files and their bytes, and the last sequence, as one row."""
    memory = log.agg(F.count_if(F.col("seq") > flushed).alias("memory_entries"), F.coalesce(F.max("seq"), F.lit(-1)).cast("long").alias("last_seq"), F.lit(1).alias("_one"))
    held = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("file_bytes"), F.lit(1).alias("_one"))
    return memory.join(held, "_one").drop("_one")


def server(commands: DataFrame) -> DataFrame:
    """Of (session, kind): sessions, commands, and how many of them read, put and delete."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return commands.agg(F.countDistinct("session").alias("connections"), F.count("*").alias("commands"), of("PUT").alias("puts"), of("GET").alias("gets"), of("DELETE").alias("deletes"))
