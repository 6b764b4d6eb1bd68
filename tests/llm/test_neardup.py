import random
import re

import numpy as np

from tidemark.llm import neardup


def plain_groups(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * union:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(seed=5):
    """Copies and near copies of a few texts, edited more and less, so that links chain and break."""
    r = random.Random(seed)
    rows = []
    for base in range(6):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 30, 60]))]
        for _ in range(25):
            own = words[:]
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows) * 3 + base, " ".join(own)))
    return rows


def test_groups_equal_all_pairs(documents):
    for width in (2, 5):
        rows = made()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(documents(rows), neardup.Config(width=width)).collect()}
        assert got == plain_groups(rows, width)


def test_defined_cases(documents, odd):
    got = neardup.groups(documents(odd), neardup.Config(width=2)).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].n_shingles == 0 and by[i].kept and by[i].component_id == i for i in (1, 2, 3))
    assert by[4].n_shingles == 1 and by[6].component_id == 5 and not by[6].kept
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert sum(r.doc_id == 5 for r in got) == 2
    assert neardup.groups(documents([])).collect() == []


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 2**63, 100).astype(np.uint64)])
    both = np.concatenate([np.unique(a), np.unique(b), a[:1]])
    sig = neardup.superminhash(both, np.array([400, 400, 1]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    assert len(np.unique(sig[2] >> 22)) > 300  # one element gives every register another rank, nearly


def test_parity_bits_bound_the_difference():
    r = np.random.default_rng(4)
    a = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    b = np.unique(np.concatenate([a[:180], r.integers(0, 2**63, 15).astype(np.uint64)]))
    x, y = neardup.odd_bits(np.concatenate([a, b]), np.array([len(a), len(b)])).view(np.uint64)
    assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


def test_repeated_ids_with_other_texts(documents):
    """Of rows that share an id the largest set counts, in links and in components."""
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    long, short = words(62), words(59)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(long)), (1, " ".join(short)), (2, near(long)), (3, near(short)), (4, " ".join(short)), (1, None)]
    got = neardup.groups(documents(rows), neardup.Config(width=2)).collect()
    by = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)
    assert by == [(1, 0, 1), (1, 58, 1), (1, 61, 1), (2, 61, 1), (3, 58, 3), (4, 58, 3)]
    tied = [(7, " ".join(long)), (7, " ".join(words(62))), (8, near(long))]
    runs = {tuple(sorted((r.doc_id, r.component_id) for r in neardup.groups(documents(tied, parts), neardup.Config(width=2)).collect())) for parts in (1, 2, 3)}
    assert len(runs) == 1


def test_a_bucket_of_many_unlike_classes(documents, monkeypatch):
    """Parts of a hot bucket are put in order by themselves, and its pairs come by rare shingles; no link is lost by that."""
    asked = []
    plain = neardup.sharing_rare
    monkeypatch.setattr(neardup, "sharing_rare", lambda *a: asked.append(1) or plain(*a))
    for part, seed in ((2, 8), (3, 11)):
        rows = made(seed=seed)
        one = {r.doc_id: r.component_id for r in neardup.groups(documents(rows), neardup.Config(width=2, bands=8, rows=1, part=part)).collect()}
        assert one == {i: c for i, (_, c) in plain_groups(rows, 2).items()}
    assert asked


def test_similar_sets_share_a_rare_shingle(spark):
    """All pairs of the threshold's similarity come up, whatever the sizes."""
    r = random.Random(2)
    own, kept = {}, []
    for base in range(12):
        core = [r.randrange(2**60) for _ in range(r.choice([1, 3, 4, 5, 9, 40]))]
        for _ in range(6):
            own[len(own)] = sorted({*r.sample(core, max(1, len(core) - r.randrange(4))), *(r.randrange(50) for _ in range(r.randrange(3)))})
    sets = spark.createDataFrame([(i, bytearray(np.array(x, "<i8").tobytes())) for i, x in own.items()], "doc_id long, members binary")
    nodes = spark.createDataFrame([(i, len(x), i) for i, x in own.items()], "node long, n long, component long")
    got = {tuple(x) for x in neardup.sharing_rare(nodes, sets, neardup.Config()).collect()}
    kept = {(i, j) for i in own for j in own if i < j and 100 * len({*own[i]} & {*own[j]}) >= 80 * len({*own[i]} | {*own[j]})}
    assert len(kept) >= 15 and kept <= got and len(got) < len(own) ** 2 / 4
