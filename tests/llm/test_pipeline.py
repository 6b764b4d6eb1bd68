import corpus_pipeline
from tidemark.llm.common import table

from .test_neardup import plain_groups


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_dedup", "substring_dedup", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
    texts = [{r.doc_id: r.text for r in x.collect()} for x in seen[:-1]]
    for frame in seen[1:-1]:
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    kept = [i for i in texts[0] if labels.get(i) == 1]
    assert sum(i in texts[1] for i in kept) > 0.95 * len(kept) and len(texts[1]) < len(texts[0])
    assert len(texts[2]) > 0.95 * len(texts[1])
    groups = plain_groups(texts[2].items(), 5)
    assert set(texts[3]) == {i for i, (_, c) in groups.items() if c == i}
    assert set(texts[4]) <= set(texts[3]) and all(len(texts[4][i]) <= len(texts[3][i]) for i in texts[4])
    assert {r.doc_id for r in seen[5].collect()} == set(texts[4])


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_defined_cases(spark, documents, odd, tmp_path):
    """Null, empty, blank and repeated rows, clashing columns and empty tables go through all stages."""
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for name, rows, marks in (("odd", odd, labels), ("none", [], labels.limit(0)), ("unmarked", odd, labels.limit(0))):
        path = str(tmp_path / name)
        documents(rows).write.parquet(f"{path}/documents.parquet")
        marks.write.parquet(f"{path}/labels.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert {p.doc_id for p in got} <= {i for i, _ in rows}
        assert len([p for p in got if p.doc_id == 5 and p.start == 0]) <= 1


def test_of_repeated_ids_the_longest_text_stays(spark, documents):
    rows = [(1, "a short text"), (1, "a longer text by far"), (1, "b longer text by far"), (2, None), (2, "x"), (None, "y"), (None, "y")]
    for parts in (1, 3):
        got = corpus_pipeline.keep_one_of_near_duplicates(spark, documents(rows, parts), "").collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "y"), (0, "y"), (1, "a longer text by far"), (2, "x")]
