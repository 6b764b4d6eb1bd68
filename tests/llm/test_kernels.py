import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import kernels as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zé\n\t.", max_size=60)), max_size=8)


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_equal_the_contract(texts, limit):
    raw, offsets, nulls = K.buffers(pa.array(texts, pa.string()))
    h, counts = K.words(raw, offsets, limit=limit)
    expected = [plain(t) for t in texts]
    assert counts.tolist() == [len(w) for w in expected]
    assert nulls.tolist() == [t is None for t in texts]
    flat = [w for ws in expected for w in ws]
    names = {}
    for w, code in zip(flat, h.tolist(), strict=True):
        assert names.setdefault(w, code) == code
    assert len(set(names.values())) == len(names)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles_equal_windows(texts, width):
    raw, offsets, _ = K.buffers(pa.array(texts, pa.string()))
    h, counts = K.words(raw, offsets)
    s, per = K.shingles(h, counts, width)
    at, seen = 0, {}
    for text, n in zip(texts, per.tolist(), strict=True):
        w = plain(text)
        expected = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([("short", *w)] if w else [])
        assert n == len(expected)
        for e, code in zip(expected, s[at : at + n].tolist(), strict=True):
            assert seen.setdefault(e, code) == code
        at += n
    assert len(set(seen.values())) == len(seen)


def test_sliced_column():
    column = pa.array(["aa bb", None, "cc", ""]).slice(1)
    raw, offsets, nulls = K.buffers(column)
    assert K.words(raw, offsets)[1].tolist() == [0, 1, 0] and nulls.tolist() == [True, False, False]
