"""The newest version of each key over a stream of changes. The winner has the largest sequence, so late rows do no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import codec


def newest(changes: DataFrame, *values: str) -> DataFrame:
    """(key, seq, op, values...) by an aggregation whose state is one row for each key; for update or complete mode."""
    packed = F.struct("seq", "op", *values)
    return changes.groupBy("key").agg(F.max_by(packed, "seq").alias("_last")).select("key", "_last.*")


def live(changes: DataFrame, *values: str) -> DataFrame:
    return newest(changes, *values).where(F.col("op") == codec.PUT).drop("op")


def into_store(changes: DataFrame, store, checkpoint: str, **trigger) -> StreamingQuery:
    """Every batch of (key, seq, op, value) becomes a run of `store`, with the stream's sequences: a row that comes
    after newer ones of its key stays hidden. A batch that comes again writes the same versions again."""

    def write(batch: DataFrame, _epoch: int) -> None:
        from tidemark.operators import snapshot

        rows = snapshot.newest(batch).select("key", "seq", F.when(F.col("op") == codec.PUT, F.col("value")).alias("value"))
        if not rows.isEmpty():
            store.write_frame(rows)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
