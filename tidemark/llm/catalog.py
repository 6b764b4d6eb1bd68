"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, fingerprint, langid, licenses, neardup, packing, pieces, quality, substring, suffixtree
from tidemark.llm.common import held_out, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.size("removed_spans"), F.lit(0))
    return substring.dedup(docs).select("doc_id", "text", "removed_spans", n.alias("n_removed"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, ~held_out(3))
    scored = quality.score(docs, model, "doc_id")
    return scored.select("doc_id", held_out(3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out(3))
    return langid.predict(docs, model, "doc_id").select("doc_id", held_out(3).alias("held_out"), "lang_pred", "score")


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.edited(table(spark, sf_dir, "documents"))
    texts = [fingerprint.text_of(F.col(k)).alias(name) for k, name in (("fp", "fingerprint"), ("edited_fp", "edited_fingerprint"))]
    return made.select("doc_id", "n_chars", "edited_sha256", *texts, "near_edited", "near_next")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), neardup.Config(width=2))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffixtree.score(table(spark, sf_dir, "documents"), ~held_out(5))
    return scored.select("doc_id", held_out(5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece_sampling": op5_sentencepiece_sampling,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_license_scans": op9_license_scans,
    "op10_lm_scoring": op10_lm_scoring,
}

#: All pairs by their common shingles, then the least id reachable. The other operators train models,
#: hash, draw or search approximately: tests/llm holds them against brute force instead.
ORACLES: dict[str, str] = {
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1:1] ELSE w[i:i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM split WHERE len(w) > 0)
), coded AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles
), sizes AS (SELECT doc_id, count(*) AS n FROM coded GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id
"""
}
