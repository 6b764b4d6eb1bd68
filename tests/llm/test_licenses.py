import itertools
import random

import numpy as np

from tidemark.llm import kernels as K
from tidemark.llm import licenses
from tidemark.llm.licenses import TEMPLATES, Config, align, winnow


def test_notices_are_found_where_they_stand(documents):
    r = random.Random(2)
    filler = lambda n: " ".join(f"q{r.randrange(9999)}" for _ in range(n))
    rows, expected = [], {}
    for t, (name, text) in enumerate(TEMPLATES):
        before = "Vör𝄞 " + filler(40) + ".\n"
        rows.append((t, before + text + "\n" + filler(30)))
        expected[t] = (name, t, 1.0, len(before))
    got = {x.doc_id: x for x in licenses.scan(documents(rows)).collect()}
    assert {i: (x.license, x.template, x.coverage, x.start) for i, x in got.items()} == expected
    for i, x in got.items():
        assert dict(rows)[i][x.start : x.end].rstrip('."/>') == TEMPLATES[x.template][1].rstrip('."/>')


def test_edits_and_partial_notices(documents):
    words = TEMPLATES[1][1].split()
    edited = [w for k, w in enumerate(words) if k not in (9, 20)]
    edited[15] = "whatever"
    rows = [(1, " ".join(edited)), (2, " ".join(words[8:16])), (3, "\n".join([TEMPLATES[8][1], "text", TEMPLATES[11][1], TEMPLATES[8][1]]))]
    got = licenses.scan(documents(rows)).collect()
    assert [(x.doc_id, x.template) for x in got if x.doc_id == 1] == [(1, 1)] and 0.75 < [x.coverage for x in got if x.doc_id == 1][0] < 1
    assert not [x for x in got if x.doc_id == 2]
    assert sorted((x.start, x.license) for x in got if x.doc_id == 3) == [(0, "MIT"), (37, "proprietary"), (58, "MIT")]


def test_defined_cases(documents, odd):
    assert licenses.scan(documents(odd)).collect() == [] == licenses.scan(documents([])).collect()
    twice = licenses.scan(documents([(1, "All rights reserved."), (1, "All rights reserved."), (None, "All rights reserved.")])).collect()
    assert sorted((x.doc_id or 0, x.start, x.end) for x in twice) == [(0, 0, 19), (1, 0, 19), (1, 0, 19)]


def test_winnowing_leaves_no_window_empty():
    h = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 5, 300):
        at = set(winnow(h, w).tolist())
        assert all(any(k in at and h[k] == h[i : i + w].min() for k in range(i, min(i + w, 200))) for i in range(max(1, 200 - w + 1)))


def test_alignment_equals_full_dynamic_programme():
    r = np.random.default_rng(6)
    for _ in range(60):
        a, b = r.integers(0, 4, 7), r.integers(0, 4, 9)
        score = np.zeros((8, 10))
        for i in range(7):
            for j in range(9):
                score[i + 1, j + 1] = max(0, score[i, j] + (1 if a[i] == b[j] else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
        got = align(a, b, 0, 20)
        assert (got is None) == (score.max() == 0)
        if got:
            assert got[0] >= score.max() and 0 <= got[1] <= got[2] < 9 and a[-1] is not None
    assert Config().coverage <= 1


def test_notices_side_by_side_all_count(documents):
    rows = [(1, "All rights reserved. All rights reserved."), (2, "Released under the MIT License.\n" * 2), (3, "All rights reserved. " * 7), (4, "Released under the MIT License. So. Released under the MIT License.")]
    got = licenses.scan(documents(rows)).collect()
    spans = {i: sorted((x.start, x.end) for x in got if x.doc_id == i) for i, _ in rows}
    assert spans[1] == [(0, 19), (21, 40)] and spans[2] == [(0, 30), (32, 62)] and spans[4] == [(0, 30), (36, 66)]
    assert spans[3] == [(21 * k, 21 * k + 19) for k in range(7)]


def test_short_notices_with_as_many_words_changed_as_may_be(documents):
    """Whichever words of a short notice are replaced, no two side by side, it is found while enough of them match."""
    rows, expected = [], {}
    for t, replaced in ((0, 2), (8, 1)):
        words = TEMPLATES[t][1].rstrip(".").replace("2.0", "2 0").split()
        for at in itertools.combinations(range(len(words)), replaced):
            if replaced == 2 and at[1] == at[0] + 1:
                continue
            rows.append((len(rows), "before it " + " ".join("zzz" if k in at else w for k, w in enumerate(words)) + " after it"))
            expected[rows[-1][0]] = t, len(words) - replaced
    got = {x.doc_id: (x.template, x.matched_words) for x in licenses.scan(documents(rows)).collect()}
    assert got == expected


def hashed(text):
    b = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    return K.hashes(b, *K.runs(b, np.array([0, len(b)]), licenses._CLASSES))


def aligned(template, text):
    """Matched words of the best local alignment of two sequences of words, without a band."""
    n = len(text) + 1
    score, match = [0] * n, [0] * n
    best = (0, 0)
    for word in template:
        row, own = [0] * n, [0] * n
        for j in range(1, n):
            hit = text[j - 1] == word
            cell = (score[j - 1] + (1 if hit else -1), match[j - 1] + hit)
            cell = max(cell, (score[j] - 1, match[j]), (row[j - 1] - 1, own[j - 1]))
            if cell[0] < 0:
                cell = (0, 0)
            row[j], own[j] = cell
            best = max(best, cell)
        score, match = row, own
    return best[1]


def test_recall_on_edited_notices(documents):
    """Notices with up to a quarter of their words replaced, left out or added, against alignments of the whole texts."""
    r = random.Random(21)
    rows, truth = [], {}
    for t in range(len(TEMPLATES)):
        for share in (0.05, 0.1, 0.15, 0.2, 0.25):
            words = []
            for w in TEMPLATES[t][1].split():
                kind = r.choice(["replace", "drop", "add"]) if r.random() < share else "keep"
                words += {"keep": [w], "replace": [f"q{r.randrange(999)}"], "drop": [], "add": [w, f"q{r.randrange(999)}"]}[kind]
            text = " ".join([*(f"z{r.randrange(999)}" for _ in range(r.randrange(30))), *words, *(f"z{r.randrange(999)}" for _ in range(r.randrange(30)))])
            own = hashed(TEMPLATES[t][1])
            if aligned(own.tolist(), hashed(text).tolist()) >= Config().coverage * len(own):
                truth[len(rows)] = t
            rows.append((len(rows), text))
    got = {}
    for x in licenses.scan(documents(rows)).collect():
        got.setdefault(x.doc_id, []).append(x)
    sizes = [len(hashed(text)) for _, text in TEMPLATES]
    found = [any(x.template == t or x.matched_words >= Config().coverage * sizes[t] for x in got.get(i, ())) for i, t in truth.items()]
    assert len(truth) > 100 and sum(found) >= 0.97 * len(truth)
