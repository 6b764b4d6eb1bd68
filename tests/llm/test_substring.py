import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm import substring
from tidemark.llm.substring import Config


def sentence(r, n=9):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."


def dedup(documents, rows, **kw):
    got = substring.dedup(documents(rows), Config(**kw)).collect()
    return {r.doc_id: r for r in got}, got


def test_passages_stay_in_the_first_document_only(documents):
    r = random.Random(1)
    passage = " ".join(sentence(r) for _ in range(7))
    short = sentence(r, 5)
    rows = []
    for i in range(40):
        own = [" ".join(sentence(r) for _ in range(3)) for _ in range(3)]
        if i % 2:
            own.insert(i % 3, passage if i % 4 == 1 else sentence(r) + " " + passage.upper().replace(" ", "  ") + " " + sentence(r))
        own.append(short)
        rows.append((i, "\n".join(own)))
    by, got = dedup(documents, rows)
    texts = dict(rows)
    holders = [i for i in by if passage.split()[10].lower() in by[i].text.lower()]
    assert holders == [1]
    for i, row in by.items():
        assert short in row.text  # five words are no passage
        if i % 2 == 0 or i == 1:
            assert row.text == texts[i] and row.removed_spans == []
        else:
            kept = texts[i]
            for s in reversed(row.removed_spans):
                assert s.first_doc_id == 1
                kept = kept[: s.start] + kept[s.end :]
            assert kept == row.text
            assert i % 4 == 1 or all(w in row.text for w in [texts[i].split()[0], texts[i].split()[-1]])


def test_repeats_inside_a_document(documents):
    r = random.Random(3)
    line = sentence(r, 25)
    by, _ = dedup(documents, [(4, "\n".join([line, "between", line, line, "after"]))])
    assert by[4].text == "\n".join([line, "between", "after"])


def test_spans_are_code_points(documents):
    r = random.Random(4)
    passage = " ".join("é𝄞" + sentence(r) for _ in range(4))
    text = "ünï 𝄞𝄞 vorher.\n" + passage
    by, _ = dedup(documents, [(1, passage), (2, text)])
    (span,) = by[2].removed_spans
    assert text[span.start : span.end] == passage and by[2].text == text[: span.start]


def test_units_of_short_sentences_join(documents):
    shout = "\n".join(" ".join(f"W{i}X{k}!!" for k in range(30)) for i in range(2))
    by, _ = dedup(documents, [(1, shout), (2, shout)])
    assert by[1].text == shout and by[2].text == ""


def test_defined_cases(documents, odd):
    by, got = dedup(documents, odd)
    assert len(got) == len(odd) and by[1].text is None and by[2].text == "" and by[3].text == " \t\n "
    assert [r.text for r in got if r.doc_id == 5] == ["same text here twice over and over again"] * 2
    assert {r.source for r in got} == {None} and {r.members for r in got} == {"x"}
    rows = [(5, "one two three four. " * 2 + "five six seven eight nine ten."), (5, "one two three four. " * 2 + "five six seven eight nine ten."), (None, "one two three four. five six seven eight nine ten.")]
    got = substring.dedup(documents(rows), Config(min_words=4)).collect()
    texts = sorted((r.doc_id or 0, " ".join(r.text.split())) for r in got)
    assert texts == [(0, ""), (5, "one two three four. five six seven eight nine ten.")] + [(5, "one two three four. five six seven eight nine ten.")]
    assert substring.dedup(documents([])).collect() == []


def plain(rows, config):
    """Substring dedup over plain words and strings: {(doc_id, text): (text left, spans)}."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def number(word):
        b = np.frombuffer(word.encode(), np.uint8)
        return int(K.hashes(b, np.array([0]), np.array([len(b)]))[0])

    def cut(text):
        """[(words, start, end)] in characters."""
        out, at = [], 0
        for line in text.split("\n"):
            words = [(m.start() + at, m.end() + at) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
            at += len(line) + 1
            names = [lower(text[a:b]) for a, b in words]
            h = [number(x) for x in names]
            starts = [i for i in range(len(words)) if i == 0 or (names[i - 1][-1] in ".!?" and i + config.short <= len(words))]
            rank = {i: (0 if i == 0 else h[i] | 1, i) for i in starts}
            cuts = {i for i in starts if all(rank[i] <= rank[j] for j in starts if abs(i - j) < config.short)}
            inner = {
                i
                for i in range(len(words))
                if all((h[i], i) <= (h[j], j) for j in range(max(0, i - config.reach), min(len(words), i + config.reach + 1)))
                and all(abs(i - j) >= config.short for j in cuts)
                and i + config.short <= len(words)
            }
            edges = [*sorted(cuts | inner), len(words)]
            out += [(names[a:b], words[a][0], words[b - 1][1]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    least = min(config.short, config.min_words)
    holders = collections.defaultdict(list)
    for i, t in rows:
        for key in {" ".join(w) for w, _, _ in cut(t or "") if len(w) >= least}:
            holders[key].append(i)
    owner = {k: min(x for x in v if x is not None) for k, v in holders.items() if any(x is not None for x in v)}
    out = {}
    for i, t in rows:
        if t is None:
            out[i, t] = None, []
            continue
        parts, seen, marks = cut(t), set(), []
        for w, _, _ in parts:
            key = " ".join(w)
            marks.append(None if len(w) < least else key in seen or (key in owner and owner[key] != i))
            seen.add(key)
        spans, k = [], 0
        while k < len(parts):
            if marks[k] is not True:
                k += 1
                continue
            z = last = k
            while z < len(parts) and marks[z] in (True, None):
                last = z if marks[z] else last
                z += 1
            if sum(len(w) for w, _, _ in parts[k : last + 1]) >= config.min_words:
                a, b = parts[k][1], parts[last][2]
                first = next((owner[" ".join(w)] for w, _, _ in parts[k : last + 1] if owner.get(" ".join(w), i) != i), i)
                after = parts[last + 1][1] if last + 1 < len(parts) else len(t)
                before = re.search(r"[\x20\x09-\x0D]*$", t[:a])[0]
                if (len(before) == a or "\n" in before) and (after == len(t) or "\n" in t[b:after]):
                    b = after
                spans.append((a, b, first))
            k = z
        left, at = "", 0
        for a, b, _ in spans:
            left, at = left + t[at:a], b
        out[i, t] = left + t[at:], spans
    return out


@pytest.mark.parametrize("config", [Config(), Config(min_words=1), Config(min_words=2, short=4, reach=2), Config(min_words=8, short=1)])
def test_results_equal_plain_code(documents, odd, config):
    r = random.Random(7)
    word = lambda: r.choice(["é", "Ab", "the.", "of", "x!", "y?", "𝄞𝄞", "long", "w%d" % r.randrange(30), "w%d" % r.randrange(3000)])
    passages = [r.choice([" ", "  ", "\n", " \n\n "]).join(word() for _ in range(r.randrange(3, 60))) for _ in range(12)]
    rows = [x for x in odd if len(x[1] or "") < 1000]
    for i in range(150):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randrange(20))) for _ in range(r.randrange(1, 6))]
        rows.append((None if i % 17 == 0 else 100 + i // 2 * r.choice([1, 1, 1, 0]) + i % 2, r.choice([" ", "\n", ". ", "\t"]).join(parts)))
    expected = plain(rows, config)
    got = substring.dedup(documents(rows), config).collect()
    assert len(got) == len(rows)
    assert sorted(((x.doc_id or -1, x.text or "", [tuple(s) for s in x.removed_spans]) for x in got), key=repr) == sorted(((i or -1, *(lambda v: (v[0] or "", v[1]))(expected[i, t])) for i, t in rows), key=repr)
    assert any(x.removed_spans for x in got)


def test_passages_inside_longer_sentences(documents):
    """A passage of 51 words without a mark, set into sentences of other words."""
    r = random.Random(12)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows, passages = [], [words(51) for _ in range(40)]
    for i in range(120):
        rows.append((i, f"{words(r.randrange(3, 40))} {passages[i % 40]} {words(r.randrange(3, 40))}."))
    by, _ = dedup(documents, rows)
    gone = sum(s.end - s.start for i, _ in rows for s in by[i].removed_spans) / sum(len(passages[i % 40]) for i in range(40, 120))
    assert all(by[i].removed_spans == [] for i in range(40)) and sum(bool(by[i].removed_spans) for i in range(40, 120)) >= 78 and gone > 0.6


def test_clashing_names_and_repeated_rows(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text, "a", 1, "t"), (2, text, "b", 2, "t"), (2, text, "b", 2, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, taken string, row long, digest string").repartition(3)
    got = sorted(map(tuple, substring.dedup(docs.withColumn("removed_spans", F.lit(1)).withColumn("doc", F.lit("x"))).collect()))
    assert [x[:6] for x in got] == [(1, text, "a", 1, "t", "x"), (2, "", "b", 2, "t", "x"), (2, "", "b", 2, "t", "x")]
