"""Leveled compaction: what to compact, with what, and the rewrite.

`files` is (level, file_number, file_size, smallest, largest, ...), a row for each file; file numbers
are unique. Overlaps are found by a sweep over sorted keys; the rewrite works on the runs' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.estimates import ratio
from tidemark.operators import merge, snapshot

BASE_BYTES = 4 << 20
FACTOR = 10
TRIGGER = 4  # files of level 0
NONE = 2_147_483_647  # priority when nothing is to do


def level_limit(level: Column, base: int = BASE_BYTES) -> Column:
    """Bytes that a level may hold: 4 bases for level 0, then the base, ten times more for each level."""
    return F.when(level == 0, F.lit(4 * base)).otherwise(F.lit(base) * F.pow(F.lit(float(FACTOR)), level - 1)).cast("long")


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("long").alias("bytes"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def full_levels(files: DataFrame, base: int = BASE_BYTES) -> DataFrame:
    """Levels that call for a compaction: level 0 by files, the others by bytes."""
    stats = level_stats(files)
    full = F.when(F.col("level") == 0, F.col("files") >= TRIGGER).otherwise(F.col("bytes") >= level_limit(F.col("level"), base))
    return stats.where(full)


def pick(files: DataFrame, base: int = BASE_BYTES) -> DataFrame:
    """The input files: all of level 0, or the largest file (the smaller number of equals) of the first full level, or else a file whose seeks are used up."""
    level = full_levels(files, base).orderBy("level").limit(1).select("level")
    of_level = files.join(F.broadcast(level), "level")  # one row
    largest = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("file_size"), "file_number"))
    chosen = of_level.withColumn("_rank", F.when(F.col("level") == 0, 1).otherwise(largest)).where("_rank = 1").drop("_rank")
    if "allowed_seeks" not in files.columns:
        return chosen
    worn = files.where("allowed_seeks <= 0").orderBy("level", "file_number").limit(1)
    some = full_levels(files, base).limit(1).select(F.lit(1).alias("_one"))
    return chosen.unionByName(worn.withColumn("_one", F.lit(1)).join(some, "_one", "left_anti").drop("_one"))


def priority(files: DataFrame, base: int = BASE_BYTES) -> DataFrame:
    return full_levels(files, base).agg(F.coalesce(F.min("level"), F.lit(NONE)).cast("int").alias("priority"))


def overlap(a: str = "a", b: str = "b") -> Column:
    """Whether the key ranges of two aliased file tables meet."""
    return (F.col(f"{a}.largest") >= F.col(f"{b}.smallest")) & (F.col(f"{a}.smallest") <= F.col(f"{b}.largest"))


def _meets(files: DataFrame, others: DataFrame, step: int) -> DataFrame:
    """`files` with `_meets`: whether the range of any of `others`, `step` levels below, meets theirs.

    A sweep in the order of keys instead of a join of ranges: something meets [a, b] if the largest
    end of all ranges that begin at or before b is not before a. One sort of the file rows of a level."""
    starts = others.select((F.col("level") - step).alias("_level"), F.col("smallest").alias("_at"), F.lit(0).alias("_kind"), F.col("largest").alias("_end"), F.lit(None).cast("long").alias("_id"))
    numbered = files.withColumn("_id", F.col("file_number").cast("long"))
    ends = numbered.select(F.col("level").alias("_level"), F.col("largest").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(files.dtypes)["largest"]).alias("_end"), "_id")
    before = Window.partitionBy("_level").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = starts.unionByName(ends).withColumn("_reach", F.max("_end").over(before)).where("_kind = 1").select("_level", "_id", "_reach").distinct()
    met = numbered.join(swept, (F.col("level") == F.col("_level")) & numbered["_id"].eqNullSafe(swept["_id"]))
    return met.withColumn("_meets", F.coalesce(F.col("_reach") >= F.col("smallest"), F.lit(False))).select(*files.columns, "_meets")


def overlapping(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """Files of the next level that overlap any input, each once."""
    return _meets(files, inputs, -1).where("_meets").drop("_meets")


def trivial_moves(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs that alone meet nothing in the next level: they only change their level."""
    return _meets(inputs, files, 1).where("not _meets").drop("_meets")


def rewrite(rows: DataFrame, level: int, last_level: int, oldest: bool | None = None) -> DataFrame:
    """The merged rows of the input runs for `level`. Deletes go only if nothing older can be below."""
    return merge.merge(rows, drop_deletes=level >= last_level if oldest is None else oldest)


def output_files(rows: DataFrame, size: Column, target: int) -> DataFrame:
    """Rows with `output`, the file that they go to: their running size in the order of keys over `target` bytes."""
    sized = snapshot.running(rows.withColumn("_size", size.cast("long")), "_size")
    return sized.withColumn("output", F.floor((F.col("running") - F.col("_size")) / target).cast("int")).drop("_size", "running")


def with_ratio(stats: DataFrame) -> DataFrame:
    return stats.withColumn("ratio", ratio(F.col("output_bytes"), F.col("input_bytes"))).withColumn("saved_bytes", F.col("input_bytes") - F.col("output_bytes"))


def merge_stats(stats: DataFrame, *by: str) -> DataFrame:
    """Sums, first start and last end; level of the earliest (-1 if there is none)."""
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_files", "output_files", "input_bytes", "output_bytes")]
    merged = stats.groupBy(*by).agg(F.coalesce(F.min_by("level", "start_ms"), F.lit(-1)).cast("int").alias("level"), *total, F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return with_ratio(merged)
