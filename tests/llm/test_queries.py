import duckdb

import __spark_entry__ as entry
from tidemark.llm.catalog import ORACLES

from .conftest import NAMES


def test_all_are_registered():
    assert [n for n in NAMES if n not in entry.queries()] == []


def test_near_duplicates_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(ORACLES["op7_minhash_near_dedup"])
    names = [d[0] for d in found.description]
    got = entry.queries()["op7_minhash_near_dedup"](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_results_by_a_path_of_parts(spark, sf_dir, tmp_path):
    """Tables of many files, as a cluster writes them, give the same rows."""
    path = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(7).write.parquet(f"{path}/{name}.parquet")
    for name in ("op4_language_id", "op6_document_fingerprints", "op9_license_scans", "op7_minhash_near_dedup"):
        one, other = (sorted(map(str, entry.queries()[name](spark, p).collect())) for p in (sf_dir, path))
        assert one == other, name
