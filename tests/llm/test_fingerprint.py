import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprint
from tidemark.llm.catalog import op6_document_fingerprints
from tidemark.llm.common import table


def prints(spark, rows):
    df = spark.createDataFrame(rows, "k string, text string")
    return {r.k: r.fp for r in fingerprint.sums(df, "k").collect()}


def test_order_insertion_and_deletion(spark):
    got = prints(spark, [("ab", "one paragraph\nand another one"), ("ba", "and another one\none paragraph"), ("a", "one paragraph"), ("b", "and another one"), ("aa", "one paragraph\none paragraph"), ("none", None), ("empty", "")])
    assert got["ab"] == got["ba"] != got["a"] and got["aa"] != got["a"] and got["none"] == got["empty"]
    one = spark.createDataFrame([(got["a"], got["b"], got["ab"])], "a array<long>, b array<long>, ab array<long>")
    r = one.select(fingerprint.combine(F.col("a"), F.col("b")).alias("up"), fingerprint.combine(F.col("ab"), F.col("b"), -1).alias("down")).first()
    assert r.up == got["ab"] and r.down == got["a"]


def expected(rows):
    """(doc_id, n_chars, sha256 of the edited text), by the definition."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()), r[1] or ""))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts_across_ranges(spark, documents, odd):
    for rows, size in ((odd, 2), (odd, 1000), (odd[:1], 5), ([(None, "x y"), (None, "z")], 5), ([(9, "ab")], 5), ([(i, f"text {i} " * i) for i in range(50)], 7)):
        got = fingerprint.edited(documents(rows), size).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    assert fingerprint.edited(documents([])).collect() == []


def test_crowded_ids_make_ranges_of_their_own(spark, documents):
    """A third of the rows has no id, another third one and the same; no range has many of them."""
    many = [(None, f"bare {i} " * (i % 5)) for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(i, f"other {i}") for i in range(40)]
    top = [(100, f"top {i}") for i in range(30)]
    for rows in (many, many + top, top, many[:60], [(3, "same")] * 40 + [(None, "same")] * 40 + [(1, "x")], many + [(-5, "least")]):
        docs = documents(rows)
        for size in (4, 9, 1000):
            got = fingerprint.edited(docs, size).collect()
            assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(rows)
    placed = fingerprint._ranges(documents(many).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 5)
    per = [r["count"] for r in placed.where("not ghost").groupBy("range").count().collect()]
    assert max(per) <= 20 and len(per) >= 25


def test_query(spark, sf_dir):
    got = op6_document_fingerprints(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    frame = got.toPandas().merge(table(spark, sf_dir, "documents").select("doc_id", "text").toPandas(), on="doc_id")
    assert frame.groupby("text").fingerprint.nunique().max() == 1 and frame.groupby("fingerprint").text.nunique().max() == 1
    assert frame.near_edited.between(0, 1).all() and frame.near_next.between(0, 1).all()
    long = frame[frame.n_chars > 500]
    assert (long.near_edited > long.near_next).mean() > 0.95


def plain(text):
    """(pieces, wide sums, narrow sums) of a text, by the definition, with another library's hash."""

    def h(seed, part):
        first = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        return xxhash.xxh64(part.encode(), seed=first).intdigest()

    pieces, wide, narrow = 0, [0] * fingerprint.WIDE, [0] * fingerprint.LANES
    for paragraph in text.split("\n"):
        for k in range(fingerprint.WIDE // 2):
            v = h(100 + k, paragraph)
            wide[2 * k] += v & 0xFFFFFFFF
            wide[2 * k + 1] += v >> 32
        for at in range(0, len(paragraph), fingerprint.PIECE):
            pieces += 1
            for k in range(fingerprint.LANES // 64):
                v = h(k, paragraph[at : at + fingerprint.PIECE])
                for b in range(32):
                    narrow[64 * k + 2 * b] += v >> b & 1
                    narrow[64 * k + 2 * b + 1] += v >> (b + 32) & 1
    return pieces, [w % 2**32 for w in wide], narrow


def test_query_equals_plain_code(spark, documents):
    """All columns of the query's operator, for texts of one to four bytes a character, empty ones and line ends."""
    r = random.Random(5)
    texts = [None, "", "\n", "a", "é𝄞", "one\n\ntwo\n", "x" * 100]
    texts += ["\n".join("".join(r.choice("ab é𝄞ñ") for _ in range(r.randrange(80))) for _ in range(r.randrange(1, 6))) for _ in range(40)]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    own = {i: t or "" for i, t in rows}
    ids = sorted(own, reverse=True)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))

    def like(a, b):
        if a == b:
            return 1.0
        x, y = ([2 * v - p for v in n] for p, _, n in (a, b))
        both = sum(v * v for v in x) + sum(v * v for v in y)
        return max(0.0, 1 - sum((v - w) ** 2 for v, w in zip(x, y, strict=True)) / both) if both else 0.0

    for size in (5, 1000):
        got = fingerprint.edited(documents(rows), size).collect()
        assert len(got) == len(rows)
        for x in got:
            text, following = own[x.doc_id], own[after[x.doc_id]]
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            for fp, t in ((x.fp, text), (x.edited_fp, changed), (x.next_fp, following)):
                pieces, wide, narrow = plain(t)
                assert fp == [pieces, *wide, *narrow]
            assert abs(x.near_edited - like(plain(text), plain(changed))) < 1e-12 and abs(x.near_next - like(plain(text), plain(following))) < 1e-12
