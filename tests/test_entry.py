import importlib.util

import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "seq", "event_type", "value"] and df.count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    if importlib.util.find_spec("corpus_pipeline") is None:
        assert not any(n.startswith("op") and n[2:3].isdigit() for n in queries)


def test_library_does_not_import_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys, tidemark.plans.catalog, tidemark.store, tidemark.streaming.fold, tidemark.sources.directory; sys.exit(any(m.startswith('tidemark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
