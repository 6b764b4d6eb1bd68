"""A cleaning pipeline over `documents`: quality, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Rejected are: documents that the quality classifier scores under 0.5;
documents whose language is undetermined or predicted with a probability under 0.5; all but the
document of the smallest id in each group of near duplicates (five-word shingles, similarity of
at least 0.8); repeated passages, and documents that are left without a word by that.

Rows that repeat a doc_id count as one document from the near-duplicate stage on: of them the one
with the longest text stays, of equal lengths the one whose text sorts first (then lang, source and
n_chars). Rows without doc_id are kept by that stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import langid, neardup, packing, quality, substring
from tidemark.llm.common import checkpoint, held_out, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(3))
    return quality.score(docs, model, *COLUMNS).where(F.col("score") >= 0.5).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, ~held_out(3))
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= 0.5)
    return langid.predict(docs, model, *COLUMNS).where(known).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    gone = checkpoint(neardup.groups(docs, neardup.Config(width=5)).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    numbered = docs.where(F.col("doc_id").isNotNull()).join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.char_length(F.coalesce("text", F.lit("")))), "text", "lang", "source", "n_chars")
    one = numbered.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(*COLUMNS)  # a map sends one row of an id
    return one.union(docs.where(F.col("doc_id").isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.dedup(docs.select(*COLUMNS))
    left = (F.size("removed_spans") == 0) | F.col("text").rlike(r"\S")
    length = F.when(F.size("removed_spans") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(left).withColumn("n_chars", length).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: Trained models, signatures and tokens are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)  # later stages read their input several times
    return docs
