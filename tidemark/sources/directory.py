"""Whole databases in binary form: manifests, tables and logs of one directory as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import manifest, snapshot
from tidemark.sources import manifest_log, sstable, wal


def live_files(spark: SparkSession, path: str) -> DataFrame:
    return manifest.replay(manifest_log.read(spark, path))


def log(spark: SparkSession, path: str) -> DataFrame:
    """(key, op, value, age): every version in live tables and logs. Tables have no sequences: logs are newer than
    tables, level 0 is newer than the levels below, and in a level the larger number is newer."""
    files = live_files(spark, path).select("level", "file_number")
    tables = sstable.read(spark, path).join(files, "file_number")
    age = lambda *columns: F.struct(*[c.cast("long").alias(f"a{i}") for i, c in enumerate(columns)])
    stored = tables.select("key", F.lit(1).alias("op"), "value", age(F.lit(0), -F.col("level"), F.col("file_number")).alias("age"))
    logged = wal.read(spark, path).select("key", "op", "value", age(F.lit(1), F.lit(0), F.col("seq")).alias("age"))
    return stored.unionByName(logged)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of all live keys of a database in binary form, as `Store.write_frame` takes them."""
    newest = snapshot.newest(log(spark, path), seq="age")
    return newest.where(F.col("op") == 1).select("key", "value")
