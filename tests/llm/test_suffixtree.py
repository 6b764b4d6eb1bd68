import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffixtree
from tidemark.llm.catalog import op10_lm_scoring
from tidemark.llm.common import table
from tidemark.llm.suffixtree import Config


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, learned):
    """(n_tokens, n_known, N, base) of each row, by the definition."""
    words = [[*split(t), None] for _, t in rows]
    c = collections.Counter()
    for (i, _), w in zip(rows, words, strict=True):
        if learned(i):
            c.update(w)
    total, kinds = sum(c.values()), len(c)
    return sorted((len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), 6)) for w in words)


def values(frame):
    return sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame)


class PlainTree:
    """The suffix tree spelled out with dictionaries of symbols and sequences."""

    def __init__(self, texts, config):
        words = [split(t) for t in texts]
        c = collections.Counter(w for own in words for w in own)
        n = sum(c.values()) + len(words)
        least = config.threshold(n)
        self.config, self.c, self.often = config, c, {w for w in c if c[w] >= least}
        of_class = collections.Counter()
        for w in c:
            if w not in self.often:
                of_class[self.ending(w)] += c[w]
        self.classes = {e for e in of_class if of_class[e] >= least}
        self.rows = [[self.symbol(w) for w in own] + ["END"] for own in words]
        self.members = collections.defaultdict(set)
        for w in c:
            if w not in self.often:
                self.members[self.symbol(w)].add(w)
        alphabet = {"END", ("class", None), *(("word", w) for w in self.often), *(("class", e) for e in self.classes)}
        one = collections.Counter(s for row in self.rows for s in row)
        self.whole = one
        self.root = {s: (one[s] + 0.5) / (n + 0.5 * len(alphabet)) for s in alphabet}
        grams = collections.Counter()
        for row in self.rows:
            padded = ["END", *row]
            for i in range(1, len(padded)):
                for size in range(2, config.depth + 2):
                    if i - size + 1 >= 0:
                        grams[tuple(padded[i - size + 1 : i + 1])] += 1
        self.grams = {g: k for g, k in grams.items() if k >= least}
        total = {(s,): k for s, k in one.items()}
        total.update(self.grams)
        self.next = collections.defaultdict(dict)
        for g, k in self.grams.items():
            self.next[g[:-1]][g[-1]] = k
        self.share = {g: (k - config.discount) / total[g[:-1]] for g, k in self.grams.items()}
        self.states, self.weight = set(), {}
        for context in sorted(self.next, key=len):
            if "END" in context[1:]:
                continue
            up = {s: self.root[s] if len(context) == 1 else self.share[(*context[1:], s)] for s in self.next[context]}
            size = total[context]
            rest, up_rest = size - sum(self.next[context].values()), 1 - sum(up.values())
            gain = sum(k * math.log(k / size / up[s]) for s, k in self.next[context].items())
            gain += rest * math.log(rest / size / up_rest) if rest else 0
            self.weight[context] = max(1 - sum(self.share[(*context, s)] for s in up), 1e-12) / up_rest
            if gain > config.price * (len(up) + 1) * math.log(max(size, 2)):
                self.states.update(context[k:] for k in range(len(context)))

    @staticmethod
    def ending(word):
        return word.encode()[-3:]

    def symbol(self, word):
        if word in self.often:
            return "word", word
        return "class", self.ending(word) if self.ending(word) in self.classes else None

    def p(self, context, symbol):
        if not context:
            return self.root[symbol]
        if (*context, symbol) in self.share:
            return self.share[(*context, symbol)]
        return self.weight[context] * self.p(context[1:], symbol)

    def score(self, text):
        words = split(text)
        row = ["END", *map(self.symbol, words), "END"]
        out = 0.0
        for i in range(1, len(row)):
            for size in range(min(i, self.config.depth), -1, -1):
                context = tuple(row[i - size : i])
                if not context or context in self.states:
                    break
            out += math.log10(self.p(context, row[i]))
        for w in words:
            s = self.symbol(w)
            if s[0] == "class" and self.whole[s]:
                out += math.log10((self.c[w] - 0.5 if self.c[w] else 0.5 * len(self.members[s])) / self.whole[s])
        return out


class WholeTree(PlainTree):
    """The same with all sequences that come up `fewest` times, however long the input, hot contexts without a test."""

    def __init__(self, texts, config):
        super().__init__(texts, config)
        grams, total = collections.Counter(), collections.Counter(self.whole)
        for row in self.rows:
            padded = ["END", *row]
            for i in range(1, len(padded)):
                for size in range(2, min(i, config.depth) + 2):
                    grams[tuple(padded[i - size + 1 : i + 1])] += 1
        total.update({(s,): k for s, k in self.whole.items()})
        total.update(grams)
        self.grams, self.next, self.states, self.weight = {g: k for g, k in grams.items() if k >= config.fewest}, collections.defaultdict(dict), set(), {}
        for g, k in self.grams.items():
            self.next[g[:-1]][g[-1]] = k
        self.share = {g: (k - config.discount) / total[g[:-1]] for g, k in self.grams.items()}
        hot = config.hot(sum(self.whole.values()))
        for context in self.next:
            if "END" in context[1:]:
                continue
            up = {s: self.root[s] if len(context) == 1 else self.share[(*context[1:], s)] for s in self.next[context]}
            size = total[context]
            left, up_left = size - sum(self.next[context].values()), 1 - min(sum(up.values()), 1 - 1e-9)
            gain = sum(k * math.log(k / size / up[s]) for s, k in self.next[context].items()) + (left * math.log(left / size / up_left) if left else 0)
            self.weight[context] = max(1 - sum(self.share[(*context, s)] for s in up), 1e-12) / up_left
            if size >= hot or gain > config.price * (len(up) + 1) * math.log(max(size, 2)):
                self.states.update(context[k:] for k in range(len(context)))


def corpus(seed, rows=60, kinds=9):
    """Texts of a few words that depend on the two before them, with rare words in between."""
    r = random.Random(seed)
    out = []
    for i in range(rows):
        last, own = [0, 0], []
        for _ in range(r.randrange(0, 120)):
            x = (3 * last[-1] + last[-2] ** 2 + r.randrange(2)) % kinds if r.random() < 0.9 else r.randrange(kinds)
            last.append(x)
            own.append(f"w{'x' * (x % 4)}{x}" if r.random() < 0.9 else f"r{r.randrange(500)}{r.choice(['ing', 'ed', 'a'])}")
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("config", [Config(least=8), Config(least=3, price=0.1), Config(least=2, price=0.0, depth=2), Config(least=5, depth=1, known_words=3)])
def test_scores_equal_a_plain_tree(spark, documents, config):
    rows = [*corpus(3), (900, None), (901, ""), (902, "unseen wxx2 W5 w5 rnew77ing and zzz END end")]
    learned = lambda i: i % 3 != 0
    tree = PlainTree([t for i, t in rows if learned(i)], config)
    got = suffixtree.score(documents(rows), F.col("doc_id") % 3 != 0, config).collect()
    texts = dict(rows)
    assert len(got) == len(rows) and tree.states and max(map(len, tree.states)) >= min(2, config.depth)
    for r in got:
        assert abs(r.score - tree.score(texts[r.doc_id])) < 1e-4 * max(1, r.n_tokens), r.doc_id


@pytest.mark.parametrize("config", [Config(fewest=2, floor=0.0), Config(fewest=2, share=0.03), Config(fewest=1, share=2.0, dealt=100, price=0.1), Config(fewest=3, share=0.05, depth=2), Config(fewest=2, share=0.1, depth=4)])
def test_scores_equal_a_whole_tree(spark, documents, config):
    """Sequences under the threshold are in the tree too, below hot contexts and wherever their contexts meet."""
    rows = [*corpus(3), *((700 + i, t) for i, t in corpus(5, 20, 30)), (900, None), (901, ""), (902, "unseen wxx2 W5 w5 rnew77ing and zzz END end")]
    learned = lambda i: i % 3 != 0
    texts = [t for i, t in rows if learned(i)]
    tree, cut, table_of = WholeTree(texts, config), PlainTree(texts, config), dict(rows)
    got = suffixtree.score(documents(rows), F.col("doc_id") % 3 != 0, config).collect()
    assert len(got) == len(rows) and len(tree.states) > 2 * len(cut.states)
    for r in got:
        assert abs(r.score - tree.score(table_of[r.doc_id])) < 1e-4 * max(1, r.n_tokens), r.doc_id


def test_sequences_that_recur_are_not_dropped_as_the_input_grows(spark, documents):
    """A text that comes twice is told from one that comes once, however many others there are."""
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    draw = lambda: " ".join(r.choices(words, k=100))
    twice = draw()
    for others in (30, 600):
        rows = [(1, twice), (2, twice), *((3 + i, draw()) for i in range(others))]
        got = {x.doc_id: x.score / x.base_score for x in suffixtree.score(documents(rows), F.lit(True)).collect()}
        assert got[1] < 0.6 * min(v for k, v in got.items() if k > 2), others


def test_whole_tree_gives_distributions():
    tree = WholeTree([t for _, t in corpus(5, 30, 30)], Config(fewest=2, share=0.05))
    for context in [(), *tree.states]:
        assert abs(sum(tree.p(context, s) for s in tree.root) - 1) < 1e-6


def test_symbols_beyond_two_million_are_kept_apart():
    levels = suffixtree.Levels([np.array([(1 << suffixtree._BITS) | 0])])
    assert levels.find(0, np.array([0, 1]), np.array([1 << 21, 0])).tolist() == [-1, 0]
    assert suffixtree.WHOLE.threshold(10**13) == math.ceil((10**13) ** (1 / 3)) and suffixtree.WHOLE.fewest == 2


def test_packed_numbers():
    arrays = [np.array([], np.int64), np.array([0, 0]), np.arange(300), np.array([2**40, 5, 2**62])]
    assert [x.tolist() for x in suffixtree.unpack(suffixtree.pack(arrays))] == [x.tolist() for x in arrays]


def test_plain_tree_gives_distributions():
    """Of the tree that the operator is held against: after every context the symbols' probabilities sum up to one."""
    tree = PlainTree([t for _, t in corpus(4)], Config(least=3, price=0.1))
    for context in [(), *tree.states]:
        assert abs(sum(tree.p(context, s) for s in tree.root) - 1) < 1e-9


def test_query(spark, sf_dir):
    got = op10_lm_scoring(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert values(got) == plain(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_scores_do_not_depend_on_what_is_broadcast(spark, documents, odd):
    docs = documents([*odd, *[(100 + i, f"the w{i % 7} and w{i} end") for i in range(60)]])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    usable = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    scores = []
    for known in (0, 5, 10**6):
        got = suffixtree.score(docs, usable, Config(known_words=known, least=4)).collect()
        assert values(got) == plain(rows, lambda i: i is not None and i % 2 == 0)
        scores.append(sorted(round(r.score, 6) for r in got))
    assert scores[0] == scores[1] == scores[2]


def test_untrained_and_empty(spark, documents, odd):
    got = suffixtree.score(documents(odd), F.lit(False)).collect()
    assert len(got) == len(odd) and all(abs(r.base_score) < 1e-6 and r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in got)
    assert suffixtree.score(documents([]), F.lit(True)).collect() == []


def test_the_tree_grows_with_the_input():
    config = Config()
    sizes = [n / config.threshold(n) for n in (10**5, 10**6, 10**7, 10**8, 10**9)]
    assert all(b > 2 * a for a, b in zip(sizes[:-1], sizes[1:], strict=True) if b < 2**18) and max(sizes) <= 2**19
    assert config.threshold(10**13) == math.ceil(10**13 / 2**19) and config.threshold(0) == config.least


def test_sequences_do_not_span_texts():
    x = suffixtree.sequence(np.array([5, 6, 7]), np.array([2, 0, 1]))
    assert x.tolist() == [5, 6, 0, 0, 7, 0]
    pair = lambda a, b: (a << suffixtree._BITS) | b
    levels = suffixtree.Levels([np.array(sorted([pair(0, 5), pair(5, 6), pair(6, 0), pair(0, 0), pair(0, 7)]))])
    (one, own), (two, _) = levels.walk(x)
    assert one.tolist() == [0, 5, 6, 0, 0, 7] and (own >= 0).tolist() == [True, True, True, True, True, False]
    assert (two >= 0).tolist() == [False, True, True, False, False, True]


def test_context_helps(spark, documents):
    """Words that follow each other in turn are predicted better than by their frequencies."""
    docs = documents([(i, "a b c d " * 40) for i in range(20)])
    got = suffixtree.score(docs, F.lit(True)).first()
    assert got.score > 0.3 * got.base_score
