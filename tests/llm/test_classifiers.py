import collections
import math
import random
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm import langid, quality
from tidemark.llm.catalog import op2_quality_classifier, op4_language_id
from tidemark.llm.common import held_out, table


def test_quality_on_held_out_rows(spark, sf_dir):
    got = op2_quality_classifier(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    own = got.merge(table(spark, sf_dir, "labels").toPandas(), on="doc_id")
    own = own[own.held_out]
    good, bad = own[own.quality == 1].score.values, own[own.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.8
    assert (own[own.quality == 1].predicted == 1).mean() > 0.9


def test_score_is_the_sparse_dot_product(spark, documents):
    config = quality.Config(bits=10)
    model = quality.Model(np.random.default_rng(1).normal(size=1 << 10), 0.3, config)
    docs = documents([(1, "a b a. C"), (2, "other words here " * 9), (3, "")])
    scored = {r.doc_id: r.score for r in quality.score(docs, model, "doc_id").collect()}
    for r in quality.features(docs, config, "doc_id").collect():
        x = np.frombuffer(r["values"], "<f4") @ model.weights[np.frombuffer(r["ids"], "<u4").astype(int)] + 0.3
        assert abs(scored[r.doc_id] - 1 / (1 + np.exp(-x))) < 1e-5


def plain_features(text, config):
    """{bucket: value} of a text, from its words one after the other."""
    words = [m[0] for m in re.finditer(r"[0-9A-Za-z\x80-\uffff]+|[^0-9A-Za-z\x00-\x20\x7f-\uffff]+", text)]
    h = [K.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])) for w in words]  # as they are written
    grams = [int(x[0]) for x in h]
    grams += [int(K.pair(a, b)[0]) for a, b in zip(h[:-1], h[1:], strict=True)]
    for k, code in enumerate(quality._AGAIN, 1):
        grams += [int(code)] * sum(a == b for a, b in zip(words[:-k], words[k:], strict=True))
    counts = collections.Counter(g >> (64 - config.bits) for g in grams)
    return {b: n * config.scale / sum(counts.values()) for b, n in counts.items()}


def test_training_equals_a_plain_loop(spark, documents):
    """Features and follow-the-regularised-leader updates, one number after the other."""
    r = random.Random(3)
    config = quality.Config(bits=12, epochs=2, l1=0.01)
    rows = [(i, " ".join(r.choice(["good", "Fine", "text,", "é", "bad bad", f"w{r.randrange(40)}"] if i % 3 else ["junk", "!!", "spam spam", f"w{r.randrange(40)}"]) for _ in range(r.randrange(1, 30)))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.train(documents(rows), labels, F.lit(True), config)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= config.l1:
            return 0.0
        return (math.copysign(config.l1, z[i]) - z[i]) / ((config.beta + math.sqrt(n[i])) / config.alpha + config.l2)

    made = [({**plain_features(t, config), "bias": 1.0}, int(i % 3 > 0)) for i, t in rows]
    positive = sum(y for _, y in made)
    share = [len(made) / (2 * (len(made) - positive)), len(made) / (2 * positive)]
    order = np.random.default_rng(7)
    for _ in range(config.epochs):
        for k in order.permutation(len(made)):
            x, y = made[k]
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in [(i, v) for i, v in x.items()]:
                w, g = weight(i), (p - y) * v * share[y]
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / config.alpha
                z[i] += g - sigma * w
                n[i] += g * g
    assert abs(model.bias - weight("bias")) < 1e-3 and np.count_nonzero(model.weights) > 20
    for i in range(1 << config.bits):
        assert abs(model.weights[i] - weight(i)) < 1e-3, i
    for row in quality.score(documents(rows), model, "doc_id").collect():
        x = made[row.doc_id][0]
        assert abs(row.score - 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))) < 1e-3


def test_quality_of_repeated_ids_and_ties(spark, documents):
    """Rows that repeat an id train once, whichever partition they are in."""
    rows = [(1, "good text here"), (1, "other good text"), (1, "good text here"), (2, "junk !! junk"), (3, "good text here"), (3, "good text here")]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    models = [quality.train(documents(rows, parts), labels, F.lit(True)) for parts in (1, 2, 5)]
    assert all((m.weights == models[0].weights).all() and m.bias == models[0].bias for m in models)
    got = [(r.doc_id, r.score) for r in quality.score(documents(rows), models[0], "doc_id").collect()]
    assert len(got) == 6 and len({s for i, s in got if i == 3}) == 1


def test_quality_defined_cases(spark, documents, odd):
    docs = documents(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none, ~held_out(3))
    assert {r.score for r in quality.score(docs, model, "doc_id").collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1, None), (7, 0, 0), (7, 0, 0), (8, 0, 1), (8, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, F.lit(True))
    got = quality.score(docs, model, "doc_id", "members").collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[4] > scores[7] and scores[1] == scores[2] == scores[3]
    assert quality.score(documents([]), model, "doc_id").collect() == []


def test_language_on_held_out_rows(spark, sf_dir):
    got = op4_language_id(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas()
    own = got.merge(docs, on="doc_id")
    assert len(own) == len(docs)
    own = own[own.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.93 and got.score.between(0, 1).all()


def test_language_defined_cases(spark, documents, odd):
    docs = documents([*odd, (20, "the house is here", "en"), (21, "la casa está aquí", "es"), (22, "la casa es esta", "es"), (23, "the house is this", "en")])
    model = langid.train(docs, F.lit(True))
    assert model.labels == ("en", "es")
    got = {r.doc_id: r for r in langid.predict(docs, model, "doc_id").collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 7))
    assert got[20].lang_pred == "en" and got[21].lang_pred == "es" and 0 < got[9].score <= 1
    empty = langid.train(documents(odd), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, empty, "doc_id").collect()} == {"und"}
    assert langid.predict(documents([]), model, "doc_id").collect() == []


def plain_grams(text, orders, bits):
    """Buckets of a text's n-grams, one character after the other."""
    folded = []
    for ch in text:
        c = (ch.lower() if len(ch.lower()) == 1 else ch) if unicodedata.category(ch)[0] in "LM" else " "
        if c != " " or not folded or folded[-1] != " ":
            folded.append(c)
    for n in orders:
        for i in range(len(folded) - n + 1):
            g = 0
            for c in folded[i : i + n]:
                g = (g * 0x01000193 + ord(c) + 1) & 0xFFFFFFFF
            yield (((g ^ (g >> 15)) * (0x85EBCA6B + 2 * (n - 1))) & 0xFFFFFFFF) >> (32 - bits)


def test_language_score_is_the_posterior(spark, documents):
    """Against naive Bayes spelled out over code points, for scripts of one to four bytes a character."""
    texts = [(1, "Straße, STRASSE: über!", "de"), (2, "Москва и ПЕТЕРБУРГ", "ru"), (3, "今日は 晴れ 𝄞𐐀", "ja"), (4, "नमस्ते दुनिया", "hi"), (5, "the house", "en"), (6, "Über Москва 晴れ 𐐨 the"), (7, "İstanbul  --  УЛИЦА"), (8, "the STRAẞE")]
    config = langid.Config(bits=9)
    model = langid.train(documents(texts, 2), F.lit(True), config)
    langs = sorted(t[2] for t in texts[:5])
    counts = {k: [config.alpha] * (1 << config.bits) for k in langs}
    for _, text, lang in texts[:5]:
        for b in plain_grams(text, config.orders, config.bits):
            counts[lang][b] += 1
    for r in langid.predict(documents(texts), model, "doc_id").collect():
        text = next(t[1] for t in texts if t[0] == r.doc_id)
        ll = {k: sum(math.log(counts[k][b] / sum(counts[k])) for b in plain_grams(text, config.orders, config.bits)) for k in langs}
        best = max(langs, key=ll.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(v - ll[best]) for v in ll.values())) < 1e-3


def test_all_languages_are_learned(documents):
    """With many languages the matrix has fewer buckets, not fewer rows."""
    rows = [(i, f"text {chr(0x4E00 + i % 600)} {chr(0x4E00 + i % 600)}{chr(0x4E00 + i % 600)}", f"l{i % 600:03}") for i in range(1200)]
    model = langid.train(documents(rows), F.lit(True), langid.Config(cells=1 << 17))
    assert len(model.labels) == 600 and model.logp.shape == (600, 128)


def test_rows_without_ids_train_by_their_texts(documents):
    rows = [(None, f"text w{i}", "en") for i in range(400)]
    docs = documents(rows)
    models = [langid.train(docs, F.lit(True), langid.Config(per_class=n, bits=8)) for n in (100, 100, 10**6)]
    assert (models[0].logp == models[1].logp).all() and (models[0].logp != models[2].logp).any()
