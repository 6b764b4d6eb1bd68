"""Manifests: an append-only log of files added and removed, folded into the live files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import snapshot

ADD, REMOVE = "ADD", "DEL"


def replay(edits: DataFrame, up_to: int | None = None) -> DataFrame:
    """Live files of (edit_id, action, level, file_number, ...): the last action on a file of a level counts; in an edit removals precede additions."""
    if up_to is not None:
        edits = edits.where(F.col("edit_id") <= up_to)
    last = Window.partitionBy("level", "file_number").orderBy(F.desc("edit_id"), F.when(F.col("action") == ADD, 0).otherwise(1))
    return edits.withColumn("_rank", F.row_number().over(last)).where((F.col("_rank") == 1) & (F.col("action") == ADD)).drop("_rank", "action")


def moves(edits: DataFrame) -> DataFrame:
    """(edit_id, file_number) of files that one edit takes from a level and adds to another."""
    pick = lambda action, name: edits.where(F.col("action") == action).select("edit_id", "file_number", F.col("level").alias(name))
    return pick(REMOVE, "from_level").join(pick(ADD, "to_level"), ["edit_id", "file_number"]).where("from_level <> to_level").distinct()


def counters(edits: DataFrame) -> DataFrame:
    """The next file number and the last sequence: the largest seen, never smaller than before."""
    return edits.agg((F.coalesce(F.max("file_number"), F.lit(0)) + 1).cast("long").alias("next_file_number"), F.coalesce(F.max("last_sequence"), F.lit(0)).cast("long").alias("last_sequence"))


def next_number(names: DataFrame, column: str = "name") -> DataFrame:
    """The number after the largest of existing logs and tables."""
    return names.agg((F.coalesce(F.max(codec.file_number(F.col(column))), F.lit(0)) + 1).cast("long").alias("next_file_number"))


def ordered(files: DataFrame) -> DataFrame:
    """Files with their place in the level: level 0 by number, the others by smallest key."""
    by = Window.partitionBy("level").orderBy(F.when(F.col("level") == 0, F.col("file_number")), "smallest", "file_number")
    return files.withColumn("place", F.row_number().over(by))


def _spread(files: DataFrame, cuts: list) -> DataFrame:
    """Files with `_first`, the range of keys where they begin, and a row for each range (`_part`) that they reach."""
    kind = dict(files.dtypes)["smallest"]
    first, last = (snapshot.part_of(c, kind, cuts) for c in ("smallest", "largest"))
    return files.withColumn("_first", first).withColumn("_part", F.explode(F.sequence(F.col("_first"), last)))


def containing(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, level, file_number) of all files whose range holds a requested key.

    Keys are cut into ranges, and a key meets the files that reach its range: a join on equal
    ranges. A file counts once for each range that it reaches."""
    cuts = snapshot.bounds(files, "smallest")
    spread = _spread(files, cuts).drop("_first")
    asked = requests.withColumn("_part", snapshot.part_of("key", dict(requests.dtypes)["key"], cuts))
    return asked.join(spread, "_part").where(F.col("key").between(F.col("smallest"), F.col("largest"))).select("key", "level", "file_number")


def overlap_pairs(files: DataFrame) -> DataFrame:
    """(input_file, next_file): files of a level and of the next one whose ranges meet, by ranges of keys as `containing`."""
    spread = _spread(files, snapshot.bounds(files, "smallest")).select("level", "file_number", "smallest", "largest", "_first", "_part")
    lower = spread.select((F.col("level") - 1).alias("level"), F.col("file_number").alias("next_file"), F.col("smallest").alias("_low"), F.col("largest").alias("_high"), F.col("_first").alias("_from"), "_part")
    met = spread.join(lower, ["level", "_part"]).where((F.col("largest") >= F.col("_low")) & (F.col("smallest") <= F.col("_high")))
    # a pair that shares several ranges counts in the first of them
    return met.where(F.col("_part") == F.greatest("_first", "_from")).select(F.col("file_number").alias("input_file"), "next_file")


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"), F.countDistinct("level").alias("levels"))
