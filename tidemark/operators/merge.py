"""Merging sorted runs; every key once, the newest version wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import codec
from tidemark.operators import snapshot


def union(*runs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def merge(rows: DataFrame, drop_deletes: bool = False) -> DataFrame:
    """One row for each key of many runs, by (seq, file_number). Deletes may only go if no older run can hold the key."""
    newest = snapshot.newest(rows.withColumn("_order", F.struct("seq", "file_number")), seq="_order").drop("_order")
    return newest.where(F.col("op") == codec.PUT) if drop_deletes else newest


def singleton(spark: SparkSession, schema: T.StructType, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def zipped(rows: DataFrame, keys: str, values: str) -> DataFrame:
    """(key, value) pairs of two arrays, as long as the shorter one."""
    n = F.least(F.size(keys), F.size(values))
    cut = lambda c: F.slice(F.col(c), F.lit(1), n)
    pair = F.arrays_zip(cut(keys).alias("key"), cut(values).alias("value"))
    return rows.select(*[c for c in rows.columns if c not in (keys, values)], F.inline(pair).alias("key", "value"))


def runs_left(rows: DataFrame, key) -> DataFrame:
    """How many runs still have keys from `key` on."""
    return rows.where(F.col("key") >= key).agg(F.countDistinct("file_number").alias("runs"))
