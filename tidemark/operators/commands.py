"""Client commands: which are valid, and which batches of a session take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import codec

START, COMMIT, CANCEL = "START", "COMMIT", "CANCEL"
#: What a client reads.
DONE, STARTED, NOT_STARTED, FAILED = "OK", "Batch already started", "No batch in progress", "ERROR: "


def _marked(commands: DataFrame) -> DataFrame:
    """(session, ord, kind, ...) with the control command before each row. A START inside a batch is an error and starts nothing."""
    control = F.when(F.col("kind").isin(START, COMMIT, CANCEL), F.col("kind"))
    earlier = Window.partitionBy("session").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = commands.withColumn("_before", F.last(control, ignorenulls=True).over(earlier))
    opens = (F.col("kind") == START) & ~F.col("_before").eqNullSafe(START)
    upto = Window.partitionBy("session").orderBy("ord")
    return rows.withColumn("_batch", F.sum(opens.cast("int")).over(upto))


def errors(commands: DataFrame) -> DataFrame:
    """Each control command that has no effect, and why."""
    rows = _marked(commands)
    why = F.when((F.col("kind") == START) & (F.col("_before") == START), STARTED).when(F.col("kind").isin(COMMIT, CANCEL) & ~F.col("_before").eqNullSafe(START), NOT_STARTED)
    return rows.withColumn("error", why).where(F.col("error").isNotNull()).drop("_before", "_batch")


def applied(commands: DataFrame, timeout_s: int | None = None) -> DataFrame:
    """Data commands that take effect, with `batch`: null outside batches, else the number of a committed batch.

    With a timeout and a `ts` column a batch is cancelled if a command comes later than that after its start."""
    rows = _marked(commands)
    inside = F.col("_before").eqNullSafe(START)
    batch = Window.partitionBy("session", "_batch")
    ends = F.max(F.when((F.col("kind") == COMMIT) & inside, True)).over(batch)
    if timeout_s is not None:
        length = F.max(F.when(inside, F.col("ts").cast("timestamp").cast("double"))).over(batch) - F.min(F.when(F.col("kind") == START, F.col("ts").cast("timestamp").cast("double"))).over(batch)
        ends = ends & (length <= timeout_s)
    rows = rows.withColumn("_done", F.coalesce(ends, F.lit(False)))
    data = ~F.col("kind").isin(START, COMMIT, CANCEL)
    return rows.where(data & (~inside | F.col("_done"))).withColumn("batch", F.when(inside, F.col("_batch")).cast("int")).drop("_before", "_batch", "_done")


def replies(commands: DataFrame) -> DataFrame:
    """Each command but reads, with `reply`: that it is done, or why it has no effect; as bytes in hexadecimal."""
    rows = _marked(commands).where(F.col("kind") != "GET")
    why = F.when((F.col("kind") == START) & (F.col("_before") == START), STARTED).when(F.col("kind").isin(COMMIT, CANCEL) & ~F.col("_before").eqNullSafe(START), NOT_STARTED)
    text = F.coalesce(F.concat(F.lit(FAILED), why), F.lit(DONE))
    return rows.withColumn("reply", codec.text_reply(text)).drop("_before", "_batch")


def sessions(commands: DataFrame) -> DataFrame:
    """Commands and seconds of each session."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(micros) - F.min(micros)) / 1e6
    return commands.groupBy("session").agg(F.count("*").alias("commands"), F.round(seconds, 3).alias("seconds"))
