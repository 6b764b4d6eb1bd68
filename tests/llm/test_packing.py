import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.catalog import op3_packing
from tidemark.llm.common import table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.Config().path())


def whole(pieces, docs, tokenizer, length):
    """Checks that pieces are an exact tiling; returns the sequences' sizes."""
    expected = {}
    for i, text in docs:
        expected.setdefault(i, []).append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(expected)
    for i, own in by_doc.items():
        copies = expected[i]
        assert sum(p.length for p in own) == sum(map(len, copies))
        for p in own:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in copies)
        if len(copies) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
            assert at == len(copies[0])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return [sum(p.length for p in own) for own in by_sequence.values()]


def test_all_documents_with_little_padding(spark, sf_dir, tokenizer):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    sizes = whole(op3_packing(spark, sf_dir).collect(), docs, tokenizer, 4096)
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert padding < 0.02 * sum(sizes)


def test_defined_cases(documents, odd, tokenizer):
    pieces = packing.pack(documents(odd)).collect()
    whole(pieces, odd, tokenizer, 4096)
    assert all(p.length == p.doc_tokens == 1 for p in pieces if p.doc_id in (1, 2, 3))
    assert packing.pack(documents([])).collect() == []


def test_order_of_the_partition_is_kept(documents, tokenizer):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(60)]
    pieces = packing.pack(documents(rows, 1).orderBy("doc_id"), packing.Config(stretch=5000)).collect()
    whole(pieces, rows, tokenizer, 4096)
    ordered = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    assert [(p.doc_id, p.start) for p in ordered] == sorted((p.doc_id, p.start) for p in pieces)


def test_cuts_are_the_cheapest():
    """Against all ways to cut, where every token is a candidate."""
    r = np.random.default_rng(3)
    for _ in range(40):
        size = int(r.integers(1, 13))
        config = packing.Config(length=4, inner=1, sentence_penalty=0.5, token_penalty=1.25)
        ids = r.integers(0, 2, size).astype(np.uint32)
        stops = np.array([False, True])
        ends = np.unique(np.append(r.integers(1, size + 1, 2), size))
        price = lambda p: 0 if p in ends or p == size else 0.5 if stops[ids[p - 1]] else 1.25  # noqa: B023, E731
        pad = lambda n, p: 0 if n & (n - 1) == 0 and p > size - 4 else 4 - n  # noqa: B023, E731
        cost = lambda cuts: sum(pad(b - a, b) + price(b) for a, b in itertools.pairwise([0, *cuts]))  # noqa: E731, B023
        best = min(cost([*c, size]) for k in range(size) for c in itertools.combinations(range(1, size), k) if all(b - a <= 4 for a, b in itertools.pairwise([0, *c, size])))
        got = packing.cuts(ids, ends, stops, config, True)
        assert got[-1] == size and abs(cost(got) - best) < 1e-9


def test_ids_equal_the_tokenizer(tokenizer):
    words = packing.Words(packing.Config(cache=5))
    for text in ["It's we'll 42nd x’y", "ÀÉ ß ǅ İI ﬁ", "a b c\x1cd", "é ñ", "<|endoftext|> x", "naïve CAFÉ!!! (ok)...", "日本語 text", "", "  ", "a_b-c/d@e.f", "½ ² ª º", "dogs' it's… x…!! --- (a) 's' <|ENDOFTEXT|>. b_", "z" * 300]:
        assert words.ids(text, words.words([text])[0]).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
