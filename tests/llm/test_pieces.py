import itertools
import math

import numpy as np
import pytest

from tidemark.llm import pieces
from tidemark.llm.pieces import Config, Lattice, top_k


def rows_of(*texts):
    """(bytes, offsets) of texts."""
    data = [x.encode() for x in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def segmentations(lattice, unit):
    """All segmentations of a unit with unnormalised log-weights, by recursion."""
    if not unit:
        return [(0.0, ())]
    out = []
    for n in range(1, len(unit) + 1):
        if unit[:n] in lattice.ids:
            first = (lattice.ids[unit[:n]],)
        elif n == 1:
            first = tuple(lattice.bytes[b] for b in pieces._utf8(unit[0]))
        else:
            continue
        w = sum(float(lattice.weight[k]) for k in first)
        out += [(w + s, first + rest) for s, rest in segmentations(lattice, unit[n:])]
    return out


@pytest.fixture(scope="module")
def lattice():
    return Lattice(Config(k=2))


def test_samples_follow_the_distribution_without_replacement(lattice):
    units = lattice.units(*rows_of("the in "))[0]
    lattice.learn()
    first, count, log_p = (x.used for x in (lattice.first, lattice.count, lattice.log_p))
    p = {z: math.exp(sum(log_p[list(z)])) for z in itertools.product(*[range(first[i], first[i] + count[i]) for i in units])}
    assert abs(sum(p.values()) - 1) < 1e-9
    n = 20_000
    got, top = dict.fromkeys(p, 0), dict.fromkeys(p, 0)
    for out, after in top_k(lattice, np.tile(units, n), np.full(n, len(units)), 2, list(range(n))):
        a, b = (tuple(c) for c, _, _ in out)
        assert a != b and out[0][2] >= out[1][2] >= after
        top[a] += 1
        got[a] += 1
        got[b] += 1
    for z in p:
        among = p[z] + sum(p[y] * p[z] / (1 - p[y]) for y in p if y != z)
        for share, k in ((p[z], top[z]), (among, got[z])):
            assert abs(k / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_all_segmentations_where_k_exceeds_them(lattice):
    units = lattice.units(*rows_of("of"))[0]
    lattice.learn()
    n = int(lattice.count.used[units].prod())
    ((out, after),) = top_k(lattice, units, np.array([len(units)]), 1000, [5])
    assert len({tuple(c) for c, _, _ in out}) == len(out) == n and after is None
    assert abs(sum(math.exp(p) for _, p, _ in out) - 1) < 1e-9


def test_round_trip_and_defined_cases(documents, odd):
    got = pieces.sample(documents(odd), with_ids=True).collect()
    assert all(r.round_trip for r in got)
    texts = {i: t or "" for i, t in odd}
    decoded = pieces.decode(pieces.sample(documents(odd), with_ids=True), sampled=True).collect()
    assert {(r.doc_id, r.text) for r in decoded} == {(i, t or "") for i, t in odd}
    empty = [r for r in got if r.doc_id in (1, 2)]
    assert len(empty) == 2 and all(r.n_pieces == 0 and r.inclusion == 1 for r in empty)
    for i in texts:
        own = [r for r in got if r.doc_id == i and i != 5]
        assert len({tuple(r.ids) for r in own}) == len(own) or i is None
    same = sorted((r["sample"], r.ids_crc32) for r in got if r.doc_id == 5)
    assert same[0::2] == same[1::2]
    assert pieces.sample(documents([])).collect() == []


def test_model_encoding_round_trip(documents):
    docs = documents([(1, "The house is here"), (2, None), (3, "Straße 42")])
    coded = pieces.encode(docs)
    assert {r.doc_id: r.text for r in pieces.decode(coded).collect()} == {1: "The house is here", 2: "", 3: "Straße 42"}


def test_inclusion_scores_estimate_sums(lattice):
    """Weighting each sample by 1 / inclusion estimates the number of segmentations' total probability."""
    rows = [s for key in range(3000) for s in [pieces.samples(lattice, *rows_of("the on"), [key])[0]]]
    total = np.mean([sum(math.exp(p) / share for _, p, _, share in own) for own in rows])
    assert abs(total - 1) < 0.05


def test_long_words_are_drawn_from_their_whole_lattice(lattice):
    word = pieces.MARK + "however"
    assert len(word) > lattice.config.unit and word in lattice.ids
    weights = {z: math.exp(w) for w, z in segmentations(lattice, word)}
    p = {z: w / sum(weights.values()) for z, w in weights.items()}
    units = lattice.units(*rows_of("however"))[0]
    lattice.learn()
    n = 20_000
    got, top = dict.fromkeys(p, 0), dict.fromkeys(p, 0)
    found = top_k(lattice, np.tile(units, n), np.full(n, len(units)), 2, list(range(n)))
    ids = iter(pieces.ids_of(lattice, [c for out, _ in found for c, _, _ in out]))
    for out, after in found:
        a, b = (tuple(next(ids).tolist()) for _ in out)
        assert a != b and out[0][2] >= out[1][2] >= after
        assert all(abs(x[1] - math.log(p[z])) < 1e-9 for x, z in zip(out, (a, b), strict=True))
        top[a] += 1
        got[a] += 1
        got[b] += 1
    assert top[(lattice.ids[word],)] > 0
    for z in p:
        among = p[z] + sum(p[y] * p[z] / (1 - p[y]) for y in p if y != z)
        for share, k in ((p[z], top[z]), (among, got[z])):
            assert abs(k / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_long_words_have_all_their_segmentations(lattice):
    for text in ("however", "straßen𝄞", "an onwards"):
        units = lattice.units(*rows_of(text))[0]
        lattice.learn()
        n = math.prod(len(segmentations(lattice, pieces.MARK + w)) for w in text.split())
        ((out, after),) = top_k(lattice, units, np.array([len(units)]), n + 5, [5])
        ids = pieces.ids_of(lattice, [c for c, _, _ in out])
        assert len({tuple(x.tolist()) for x in ids}) == len(out) == n and after is None
        assert {lattice.decode(x.tolist()) for x in ids} == {text}
        assert abs(sum(math.exp(p) for _, p, _ in out) - 1) < 1e-9


def test_edges_of_all_words_at_once_equal_those_of_one():
    words = [pieces.MARK + w for w in ("international", "straßen𝄞\udc81x", "a" * 40, "l'été-2024", "zz\x00\nqq")]
    tables = []
    for name in ("_grow", "_grow_all"):
        own = Lattice(Config())
        roots = getattr(own, name)(words)
        per = [(r, {(int(own.step.data[e, 3]), int(own.edge_piece.data[e])): tuple(np.round(own.step.data[e, 1:3], 9).tolist()) for e in range(a, a + n)}) for r, a, n in zip(range(own.edge.size), own.edge.used.tolist(), own.edges.used.tolist(), strict=True)]
        runs = {k: c for c, k in own.byte_runs.items()}
        tables.append((roots.tolist(), [(r, {(to, k if k >= 0 else runs[-1 - k]): v for (to, k), v in x.items()}) for r, x in per]))
    assert tables[0] == tables[1]


def test_units_stand_between_blanks():
    own = Lattice(Config())
    texts = ["a  b ", "", " ", "b", "▁x a"]
    units, sizes = own.units(*rows_of(*texts))
    names = np.array(own.index.new)[units].tolist()
    assert sizes.tolist() == [4, 0, 2, 1, 2]
    assert names == [pieces.MARK + w for w in ("a", "", "b", "", "", "", "b", pieces._OWN_MARK + "x", "a")]


def test_listed_words_have_all_their_segmentations():
    own = Lattice(Config())
    words = ["the", "a", "", "é𝄞", "\x00\n", "ab▁c", "zq#é", "house"]
    units, _ = own.units(*rows_of(*words))
    units, _ = own.units(*rows_of(" ".join(words)))
    names = np.array(own.index.new)[units].tolist()
    own.learn()
    for u, name in zip(units.tolist(), names, strict=True):
        a, n = int(own.first.data[u]), int(own.count.data[u])
        made = [(float(own.log_p.data[k]), tuple(own.pieces.data[own.end.data[k - 1] if k else 0 : own.end.data[k]].tolist())) for k in range(a, a + n)]
        plain = segmentations(own, name)
        total = math.log(sum(math.exp(w) for w, _ in plain))
        assert sorted(z for _, z in made) == sorted(z for _, z in plain)
        by = {z: w - total for w, z in plain}
        assert all(abs(by[z] - w) < 1e-9 for w, z in made) and made == sorted(made, key=lambda x: -x[0])
