"""What the corpus operators share: reading tables, held-out rows, checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 1, F.lit(False))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the folder that spark.checkpoint.dir names, and cut its lineage.

    A folder of this machine is used only where the setting is absent and Spark runs on this
    machine alone, as in tests; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()
