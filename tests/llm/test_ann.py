import numpy as np

from tidemark.llm import ann
from tidemark.llm.catalog import op8_nearest_neighbours
from tidemark.llm.common import table


def brute(ids, x, top=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        order = np.lexsort((ids, -np.round(s, 12)))
        out[int(ids[k])] = [(int(ids[i]), s[i]) for i in order if i != k][:top]
    return out


def test_query_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").toPandas()
    exact = brute(rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float))
    got = op8_nearest_neighbours(spark, sf_dir).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (own.score.diff().dropna() <= 0).all()
        hits += len({i for i, _ in exact[q]} & set(own.vec_id))
        near = {i: s for i, s in exact[q]}
        assert all(abs(near[i] - s) < 1e-12 for i, s in zip(own.vec_id, own.score, strict=True) if i in near)
    assert set(got.query_id) == set(exact) and hits / (5 * len(exact)) >= 0.9


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])]
    rows += [(1000 + i, [1.0, 1.0]) for i in range(1, 20)] + [(7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [-1.0, 0.0]), (1050, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, query_id long, entry string")
    got = ann.search(df, df.vec_id % 50 == 0, ann.Config(words=4, books=2)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [7, 1001, 1002, 1003, 1004], 1050: [1001, 1002, 1003, 1004, 1005]}
    assert ann.search(df.limit(0), df.vec_id % 50 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(two, two.vec_id == 0).collect()] == [(0, 1, 1)]


def test_beam_search_and_refit_do_not_lose():
    x = ann.unit(np.random.default_rng(5).normal(size=(600, 16)))
    error = lambda b, beam: ((x - b.decode(ann.encode(x, b, beam))) ** 2).sum()
    start = ann.train(x, ann.Config(books=4, words=16, rounds=0))
    assert error(start, 8) <= error(start, 1)
    codes = ann.encode(x, start, 4)
    fitted = ann.refit(x.astype(np.float32), codes, start)
    assert ((x - fitted.decode(codes)) ** 2).sum() <= ((x - start.decode(codes)) ** 2).sum()
