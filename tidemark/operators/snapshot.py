"""Reads of a changelog: newest live value of each key, lookups, seeks and scans.

A filter on the key goes below the fold and reaches the scan; a filter on anything else must
stay above it, or deleted keys come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import codec


def newest(log: DataFrame, key: str | Sequence[str] = "key", seq: str = "seq") -> DataFrame:
    """The newest version of each key (or combination of columns), deletes included.

    row_number() = 1 becomes a group limit on both sides of the shuffle, so a map task sends one
    row of a key however hot it is."""
    by_key = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.desc(seq))
    return log.withColumn("_rank", F.row_number().over(by_key)).where("_rank = 1").drop("_rank")


def snapshot(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest value of each key whose newest version is no delete; `as_of` ignores later sequences."""
    if as_of is not None:
        log = log.where(F.col("seq") <= as_of)
    return newest(log).where(F.col("op") == codec.PUT).drop("op")


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(log).where(F.col("op") == codec.DELETE).select("key", "seq")


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """No or one row. The key filter is applied before the fold and pushed to the scan."""
    return snapshot(log.where(F.col("key") == key), as_of)


def multi_get(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Each requested key with its value columns, null where it is absent, and `found`."""
    values = [c for c in log.columns if c not in ("key", "op")]
    wanted = snapshot(log.join(requests.select("key").distinct(), "key", "left_semi")).withColumn("_hit", F.lit(True))
    return requests.join(wanted, "key", "left").select(*requests.columns, *values, F.coalesce("_hit", F.lit(False)).alias("found"))


def get_exact(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Versions by exact (key, seq)."""
    return log.join(requests, ["key", "seq"], "left_semi")


def versions(log: DataFrame, live_only: bool = False) -> DataFrame:
    """All versions with their place in the internal order of their key, newest first."""
    log = log.where(F.col("op") == codec.PUT) if live_only else log
    return log.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))))


def between(rows: DataFrame, low=None, high=None, key: str = "key") -> DataFrame:
    """Keys in [low, high); a missing bound is open. Pushed to the scan."""
    if low is not None:
        rows = rows.where(F.col(key) >= low)
    return rows.where(F.col(key) < high) if high is not None else rows


def seek(rows: DataFrame, low, limit: int | None = None, key: str = "key") -> DataFrame:
    """From the first key not below `low`, in order; with a limit only the top rows are kept on every side."""
    found = between(rows, low, None, key).orderBy(key)
    return found if limit is None else found.limit(limit)


def first(rows: DataFrame, limit: int = 1, key: str = "key") -> DataFrame:
    return rows.orderBy(key).limit(limit)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


#: Bytes, as the optimizer estimates them, that are one range of keys without asking for more.
_ONE_RANGE = 4 << 20


def bounds(rows: DataFrame, key: str = "key", parts: int | None = None) -> list:
    """Keys that cut `rows` into about `parts` ranges of like size (10,000 at most), ascending; that many is all the driver gets to keep.

    Without `parts` as many as there are shuffle partitions, but one range if the plan's estimate is a few megabytes."""
    if parts is None and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= _ONE_RANGE:
        return []
    parts = min(10_000, parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts < 2:
        return []
    if dict(rows.dtypes)[key] in _NUMBERS:
        shares = F.split(F.lit(",".join(str(k / parts) for k in range(1, parts))), ",").cast("array<double>")
        found = rows.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts))).first()[0] or []
    else:  # a fixed number of sampled keys
        drawn = sorted(r[0] for r in rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(min(64 * parts, 100_000)).collect())
        found = [drawn[k * len(drawn) // parts] for k in range(1, parts)] if drawn else []
    return sorted(set(found))


def part_of(key: str, kind: str, cuts: list) -> Column:
    """How many of the ascending `cuts` are below the key, by a binary search; -1 for a null key.

    The cuts are one literal and the search a fixed expression, however many there are."""
    if not cuts:
        return F.when(F.col(key).isNull(), -1).otherwise(0)
    if kind in _NUMBERS:
        own, every = F.col(key), F.split(F.lit(",".join(map(str, cuts))), ",").cast(f"array<{kind}>")
    elif kind in ("string", "binary"):  # hexadecimal text sorts as the bytes do
        own = F.hex(F.col(key).cast("binary"))
        every = F.split(F.lit(",".join((c.encode() if isinstance(c, str) else bytes(c)).hex().upper() for c in cuts)), ",")
    else:
        own, every = F.col(key), F.array(*[F.lit(c) for c in cuts])
    n = len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.try_element_at(every, at + step) < own), at + step).otherwise(at))
    return F.when(F.col(key).isNull(), -1).otherwise(below).cast("int")


def running(rows: DataFrame, amount: str, key: str = "key", parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows with `running`, the sum of `amount` (a long) up to and with their key, over the whole order or that of each `by`. Keys are unique there.

    The running sum inside a range of keys plus the sums of the ranges before it: only one number
    for each range (and `by`) meets in one place."""
    cuts = bounds(rows, key, parts)
    if not cuts:
        return rows.withColumn("running", F.sum(amount).over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    placed = rows.withColumn("_part", part_of(key, dict(rows.dtypes)[key], cuts))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*by, "_part").agg(F.sum(amount).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = placed.withColumn("_inside", F.sum(amount).over(Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not by:
        before = F.broadcast(before)  # 10,001 rows at most
    return _with(inside, before, [*by, "_part"]).withColumn("running", (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")


def previous(rows: DataFrame, value: str, key: str = "key", parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows with `before`, the `value` of the row before them in the order of keys, over everything or in each `by`.

    Inside a range of keys by a window; the first row of a range looks at the last one of the ranges before it."""
    cuts = bounds(rows, key, parts)
    if not cuts:
        return rows.withColumn("before", F.lag(value).over(Window.partitionBy(*by).orderBy(key)))
    placed = rows.withColumn("_part", part_of(key, dict(rows.dtypes)[key], cuts))
    inside = placed.withColumn("_first", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(key)) == 1).withColumn("before", F.lag(value).over(Window.partitionBy(*by, "_part").orderBy(key)))
    ends = placed.groupBy(*by, "_part").agg(F.when(F.col("_part") < 0, F.last(value)).otherwise(F.max_by(value, key)).alias("_end")).withColumn("_end", F.lag("_end").over(Window.partitionBy(*by).orderBy("_part")))
    if not by:
        ends = F.broadcast(ends)  # 10,001 rows at most
    return _with(inside, ends, [*by, "_part"]).withColumn("before", F.when(F.col("_first"), F.col("_end")).otherwise(F.col("before"))).drop("_part", "_first", "_end")


def _with(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the columns of `few` by keys that may be null."""
    named = few.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return rows.join(named, on).drop(*[f"_of_{k}" for k in keys])


def ranked(rows: DataFrame, key: str = "key") -> DataFrame:
    """Rows with `rank`, the place of their key in the whole order (from 1). Keys are unique."""
    return numbered(rows, key).withColumnRenamed("running", "rank")


def numbered(rows: DataFrame, key: str = "key", by: Sequence[str] = ()) -> DataFrame:
    """Rows with `running`, their number (from 1) in the order of keys, over everything or in each `by`."""
    return running(rows.withColumn("_one", F.lit(1).cast("long")), "_one", key, by=by).drop("_one")


def dump(log: DataFrame, columns: Sequence[str], text: Column | None = None) -> DataFrame:
    """One line of text for each version, in internal order."""
    line = text if text is not None else F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return log.select("key", "seq", line.alias("line")).orderBy("key", F.desc("seq"))
