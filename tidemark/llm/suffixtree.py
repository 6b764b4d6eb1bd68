"""Language-model scoring with a probabilistic suffix tree over the words of a text.

Tokens are the words of the contract in lower case and an end mark. Symbols of the tree are the end
mark, every word that came up at least `threshold` times in training, and for all other words the
classes of their endings (the last three bytes); endings below the threshold share one class. A word
of a class is predicted as P(class | state) * P(word | class), with the exact count of the word;
seen words are discounted and what that frees is the probability of a word not seen. The query's
threshold is max(least, N ** (1/3)) of the training tokens N, so the symbols grow with the input.

Candidates are all sequences of up to `depth` symbols and the next one that come up `fewest` times, two
for the query, however long the input. A context is kept as a state if its next-symbol distribution
differs enough from its parent's (the context without its oldest symbol): count times
Kullback-Leibler divergence must exceed a description-length price; with a state all its suffixes
are states. Listed next symbols get their discounted share, all others what is left, in proportion
to the parent state. Each symbol is scored by the longest suffix state of what precedes it, back to
the start of the text.

The tree is never in one place. Only hot contexts, with a share of at least `share` of the tokens
(at most 1 / share for each length, and states without the test), have their next symbols counted
by a shuffle and broadcast. Every other position goes to a task with all other occurrences of its
shortest context that is not hot; a longer context is below that one, so that task has the whole
subtree, counts and tests it, scores its positions by it and sends back a sum for each text.
A `Config` with `fewest` 0 takes the threshold for sequences too and broadcasts the whole tree.

All counts are of the whole training set. Counts of the most frequent words (at most `known_words`
and those of the tree) are broadcast; tokens of all other words are looked up by a join, so every
count is exact and no vocabulary has to fit into memory.

Defined cases: null and empty texts are the end mark alone; without training rows the base is
log10(0.5/0.5) = 0 for each token and symbols are uniform; repeated rows are scored each by
itself; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import checkpoint

WORD, TEXT = 0, 2


@dataclass(frozen=True)
class Config:
    depth: int = 3  # most symbols of a context
    floor: float = 2.0**-19  # least share of the tokens that a sequence must have, however long the input
    least: int = 8
    price: float = 0.5  # of a listed next symbol, times the logarithm of the count
    discount: float = 0.5
    known_words: int = 1 << 19
    held: int = 3_000_000  # counts that a task holds
    fewest: int = 0  # occurrences of a sequence of the tree, however long the input; 0: the threshold
    share: float = 2.0**-10  # of the tokens that a context must have to be hot
    dealt: int = 1_000_000  # positions that a task holds before it deals them out
    bucket: int = 1_000_000  # positions that meet in one task

    def threshold(self, tokens: int) -> int:
        return int(max(self.least, np.ceil(tokens ** (1 / 3)), np.ceil(tokens * self.floor)))

    def hot(self, tokens: int) -> int:
        return int(max(self.threshold(tokens), np.ceil(tokens * self.share)))


#: Every sequence that recurs is a candidate, and every word of the cube root of the tokens a symbol.
WHOLE = Config(floor=0.0, fewest=2)


@dataclass(frozen=True)
class Alphabet:
    """Symbol 0 is the end mark; then words; then endings; the last is the class of all other words."""

    words: np.ndarray  # sorted hashes
    endings: np.ndarray  # sorted codes
    count: np.ndarray  # of each symbol in training
    kinds: np.ndarray  # words of each class, 0 for other symbols

    @property
    def size(self) -> int:
        return len(self.count)

    def symbols(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.size - 1, np.int64)
        first = 1
        found = np.zeros(len(h), bool)
        for keys, own in ((self.words, h), (self.endings, ending)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = (keys[at] == own) & ~found
                out[hit] = first + at[hit]
                found |= hit
            first += len(keys)
        return out

    def is_class(self, symbols: np.ndarray) -> np.ndarray:
        return symbols > len(self.words)


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """(word hashes, endings, words of each row)."""
    counts = np.zeros(len(offsets) - 1, np.int64)
    hs, es = [], []
    for i, j, b, off in K.segments(raw, offsets):
        b = K.LOWER[b]
        s, e = K.runs(b, off, K.WORD)
        hs.append(K.hashes(b, s, e))
        code = b[e - 1].astype(np.int64)
        for k in (2, 3):
            code |= np.where(e - k >= s, b[np.maximum(e - k, 0)], 0).astype(np.int64) << (8 * (k - 1))
        es.append(code)
        counts[i:j] += np.diff(np.searchsorted(s, off))
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    return np.concatenate(hs), np.concatenate(es), counts


class _Counter:
    """Sums of counts by key, compacted when many are held."""

    def __init__(self, most: int):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.most:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
        return self.size > self.most and len(self.parts) == 1

    def total(self):
        k = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in self.parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(x for _, x in self.parts)])
        if not len(k):
            return k, n
        order = np.argsort(k)
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(n, first)


def _batches(kind: int, keys: np.ndarray, counts: np.ndarray, endings: np.ndarray):
    for i in range(0, len(keys), 200_000):
        x = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[x]), kind, np.int32)), pa.array(keys[x]), pa.array(endings[x].astype(np.int32)), pa.array(counts[x])], ["kind", "key", "ending", "n"])


def count_words(docs: DataFrame, config: Config) -> DataFrame:
    """(kind, key, ending, n): words by their hash with their ending, and the number of texts."""

    def run(batches):
        held, ends, texts = _Counter(config.held), {}, 0

        def emit():
            k, n = held.total()
            yield from _batches(WORD, k, n, ends_of(k))

        def ends_of(k):
            keys, values = ends["all"]
            return values[np.searchsorted(keys, k)]

        for batch in batches:
            raw, offsets, _ = K.buffers(batch.column("text"))
            texts += batch.num_rows
            for i, j in K.slices(offsets):
                h, ending, _ = tokens(raw, offsets[i : j + 1])
                k, first, n = np.unique(h.view(np.int64), return_index=True, return_counts=True)
                if "all" in ends:
                    keys, values = ends["all"]
                    at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
                    new = keys[at] != k if len(keys) else np.ones(len(k), bool)
                    spot = np.searchsorted(keys, k[new])
                    ends["all"] = np.insert(keys, spot, k[new]), np.insert(values, spot, ending[first[new]])
                else:
                    ends["all"] = k, ending[first]
                if held.add(k, n):
                    yield from emit()
                    held, ends = _Counter(config.held), {}
        if "all" in ends:
            yield from emit()
        yield from _batches(TEXT, np.zeros(1, np.int64), np.array([texts]), np.zeros(1, np.int64))

    return docs.select("text").mapInArrow(K.tidy(run), "kind int, key long, ending int, n long").groupBy("kind", "key", "ending").agg(F.sum("n").alias("n"))


def sequence(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Symbols of all rows one after the other, the end mark after each row."""
    out = np.zeros(len(symbols) + len(counts), np.int64)
    out[np.arange(len(symbols)) + K.row_of(counts)] = symbols
    return out


#: Bits of a symbol in a key; the bits above are the number of the sequence before it.
_BITS = 28


class Levels:
    """Sequences that reach the threshold, by their length: a symbol's number is itself, a longer
    sequence's is its place among the sorted keys (number of all but its last symbol, last symbol)."""

    def __init__(self, keys: list[np.ndarray]):
        self.keys = keys  # of two symbols and more

    def find(self, level: int, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Numbers of the sequences `before` + `symbol`, of `level` + 2 symbols; -1 where there is none."""
        keys, out = self.keys[level], np.full(len(symbol), -1)
        if len(keys):
            key = (before << _BITS) | symbol
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (before >= 0) & (keys[at] == key)
            out[hit] = at[hit]
        return out

    def walk(self, x: np.ndarray):
        """Of each length from 1 on: (number of the context of that length before each symbol, number of
        it with the symbol), -1 where there is none. The last is of one symbol more than any key has."""
        own = x
        for level in range(len(self.keys) + 1):
            before = np.empty(len(x), np.int64)
            before[1:] = own[:-1]
            if level:
                before[1:][x[:-1] == 0] = -1  # nothing reaches back over the start of a text
            before[:1] = -1 if level else 0
            own = self.find(level, before, x) if level < len(self.keys) else None
            yield before, own

    def number(self, cs: list[np.ndarray]) -> np.ndarray:
        """Numbers of the sequences of these symbols, the last first; -1 where there is none."""
        out = cs[-1]
        for k, c in enumerate(cs[-2::-1]):
            out = self.find(k, out, c)
        return out

    def hottest(self, hot: list[np.ndarray], cs: list[np.ndarray], none: int):
        """(how many of the contexts `cs` of each symbol, from the shortest on, are flagged in `hot`, the
        symbols for which that is all of them, the number of the longest)."""
        many, at, before = np.zeros(len(cs[0]), np.int64), np.arange(len(cs[0])), None
        for level, flags in enumerate(hot):
            at = at[cs[level][at] != none]
            before = self.number([c[at] for c in cs[: level + 1]])
            there = before >= 0
            there[there] = flags[before[there]]
            at, before = at[there], before[there]
            many[at] = level + 1
        return many, at, before

    def spelled(self, level: int) -> np.ndarray:
        """The symbols of all sequences of `level` + 2 symbols, the oldest first."""
        before, last = self.keys[level] >> _BITS, self.keys[level] & ((1 << _BITS) - 1)
        front = self.spelled(level - 1)[before] if level else before[:, None]
        return np.concatenate([front, last[:, None]], 1)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers from 0 on in as few bytes as the largest needs, byte by byte of all numbers, compressed."""
    parts, head = [], [len(arrays)]
    for x in arrays:
        x = np.ascontiguousarray(x, np.int64)
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        head += [len(x), width]
    body = b"".join([np.array(head, "<i8").tobytes(), *parts])
    return len(body).to_bytes(5, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob) -> list[np.ndarray]:
    raw = memoryview(blob)
    body = np.frombuffer(pa.decompress(pa.py_buffer(raw[5:]), int.from_bytes(raw[:5], "little"), codec="zstd"), np.uint8)
    size = int(body[:8].view("<i8")[0])
    out, at = [], 8 + 16 * size
    for n, width in body[8:at].view("<i8").reshape(-1, 2).tolist():
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = body[at : at + n * width].reshape(width, n).T
        out.append(x.view(np.int64)[:, 0])
        at += n * width
    return out


def _coded(rid: np.ndarray, learned: np.ndarray, n: np.ndarray, symbols: np.ndarray) -> bytes:
    """Texts in symbols, the end mark after each: number of the first row, steps to the others, whether learned from, length."""
    return pack([rid[:1], np.diff(rid), learned, n + 1, sequence(symbols, n)])


def _decoded(cell):
    """(row numbers, learned from, lengths with the end mark, symbols)."""
    first, steps, learned, n, x = unpack(cell.as_buffer())
    return np.concatenate([first, first + np.cumsum(steps)]), learned.astype(bool), n, x


def count_sequences(coded: DataFrame, levels: Levels, config: Config, hot: list[np.ndarray] | None = None) -> DataFrame:
    """(key, n) of the sequences one symbol longer than those of `levels` whose first and last parts are among them;
    with `hot`, flags of symbols and all of `levels`, of all sequences that begin with a flagged longest one."""
    none = 1 << _BITS
    shared = coded.sparkSession.sparkContext.broadcast((levels.keys, hot))

    def run(batches):
        held, levels, hot = _Counter(config.held), Levels(shared.value[0]), shared.value[1]

        def emit():
            keys, n = held.total()
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(n[i : i + 200_000])], ["key", "n"])

        for batch in batches:
            for cell in batch.column("coded"):
                _, learned, n, x = _decoded(cell)
                x = x[np.repeat(learned, n)]
                if hot is None:
                    last = x
                    for before, own in levels.walk(x):
                        if own is not None:
                            last = own
                    at = np.flatnonzero((before >= 0) & (last >= 0))
                    before = before[at]
                else:
                    _, at, before = levels.hottest(hot, contexts(x, len(hot), none), none)
                if held.add(*np.unique((before << _BITS) | x[at], return_counts=True)):
                    yield from emit()
                    held = _Counter(config.held)
        yield from emit()

    return coded.select("coded").mapInArrow(K.tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tree:
    levels: Levels
    root: np.ndarray  # log10 of each symbol's probability
    listed: list[np.ndarray]  # of each sequence: log10 of its last symbol's probability after the others
    other: list[np.ndarray]  # of each context: log10 of what its unlisted symbols' probabilities at the parent are multiplied by; NaN if it is no state
    hot: list[np.ndarray] | None = None  # of each context: whether the tree has its next symbols; None if it has all there are

    def score(self, x: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol of a sequence."""
        out = self.root[x]
        for level, (before, own) in enumerate(self.levels.walk(x)):
            if level == len(self.listed):
                break
            state = before >= 0
            weight = np.full(len(x), np.nan)
            weight[state] = self.other[level][before[state]]
            out = np.where(np.isnan(weight), out, out + weight)
            hit = np.flatnonzero(~np.isnan(weight) & (own >= 0))
            out[hit] = self.listed[level][own[hit]]
        return out


    def climb(self, x: np.ndarray, cs: list[np.ndarray], hot: np.ndarray):
        """Of symbols `x` after contexts of which the shortest `hot` are hot: (log10 of the probability after
        these, the share of the symbol after the longest of them, or its probability at the root)."""
        out = self.root[x]
        share = 10.0**out
        for level in range(len(cs)):
            at = np.flatnonzero(hot > level)
            if not len(at):
                break
            before = self.levels.number([c[at] for c in cs[: level + 1]])
            own = self.levels.find(level, before, x[at])
            weight, hit = self.other[level][before], np.flatnonzero(own >= 0)
            value = np.where(np.isnan(weight), out[at], out[at] + weight)
            listed = self.listed[level][own[hit]].astype(np.float64)
            value[hit] = np.where(np.isnan(weight[hit]), value[hit], listed)
            out[at] = value
            share[at] = 0.0
            share[at[hit]] = 10.0**listed
        return out, share


def build(alphabet: Alphabet, levels: Levels, counts: list[np.ndarray], config: Config, hot: list[np.ndarray] | None = None) -> Tree:
    """The tree from the counts of the sequences of two symbols and more; contexts in `hot` are states without a test."""
    root = (alphabet.count + 0.5) / (alphabet.count.sum() + 0.5 * alphabet.size)
    listed, parents, weight, keep, nearest = [], [], [], [], []
    for level, keys in enumerate(levels.keys):
        total = (counts[level - 1] if level else alphabet.count).astype(np.float64)  # of each context
        of, n = keys >> _BITS, counts[level].astype(np.float64)
        share = (n - config.discount) / total[of]
        # the same symbol after the parent: the sequence without its oldest symbol, which is listed there
        own = levels.spelled(level)
        if level:
            shorter = own[:, 1]
            for k in range(2, level + 2):
                shorter = levels.find(k - 2, shorter, own[:, k])
            up = listed[level - 1][shorter]
        else:
            up = root[own[:, 1]]
        size = len(total)
        mass, up_mass = np.bincount(of, n, size), np.minimum(np.bincount(of, up, size), 1 - 1e-9)
        kinds = np.bincount(of, minlength=size)
        safe = np.maximum(total, 1)
        rest, up_rest = np.maximum(safe - mass, 0), 1 - up_mass
        gain = np.bincount(of, n * np.log(n / total[of] / up), size) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / safe / up_rest), 0)
        passes = (kinds > 0) & (gain > config.price * (kinds + 1) * np.log(np.maximum(total, 2)))
        parent = np.zeros(size, np.int64)
        if level == 1:
            parent = levels.keys[0] & ((1 << _BITS) - 1)
        elif level:
            own = levels.spelled(level - 1)
            parent = own[:, 1]
            for k in range(2, level + 1):
                parent = levels.find(k - 2, parent, own[:, k])
        left = 1 - np.bincount(of, share, size)
        listed.append(share)
        weight.append(np.log10(np.maximum(left, 1e-12) / up_rest))
        keep.append(passes)
        parents.append(parent)
    for level in range(len(keep) - 1, 0, -1):  # with a state its suffixes
        keep[level - 1][parents[level][keep[level]]] = True
    if hot is not None:
        keep = [(np.bincount(keys >> _BITS, minlength=len(h)) > 0) & h for keys, h in zip(levels.keys, hot, strict=True)]
    other = [np.where(k, w, np.nan).astype(np.float32) for k, w in zip(keep, weight, strict=True)]
    return Tree(levels, np.log10(root), [np.log10(x).astype(np.float32) for x in listed], other, hot)


def contexts(x: np.ndarray, depth: int, none: int) -> list[np.ndarray]:
    """The symbol before each symbol, the one before that and so on; `none` before the start of a text."""
    out = [np.concatenate([[0], x[:-1]]) if len(x) else x]
    for _ in range(depth - 1):
        longer = np.concatenate([[none], out[-1][:-1]]) if len(x) else x
        longer[out[0] == 0] = none
        out.append(longer)
    return out


def rest(coded: DataFrame, tree: Tree, alphabet: Alphabet, config: Config, buckets: int) -> DataFrame:
    """(rid, score) of all rows by the whole tree: log10 probability of its symbols.

    Positions all of whose contexts are hot are scored where their text is. The others go, with
    `depth` symbols before them, to the bucket of their shortest context that is not hot; there all
    occurrences of that context and of the longer ones meet, so the part of the tree below it is
    counted, tested and used in one task. What comes back is a sum for each row that the bucket saw."""
    rank = np.empty(alphabet.size + 1, np.int32)  # frequent symbols are small numbers, which take less room
    rank[np.argsort(-np.append(alphabet.count, -1), kind="stable")] = np.arange(alphabet.size + 1)
    shared, none, depth = coded.sparkSession.sparkContext.broadcast((tree, rank)), alphabet.size, config.depth

    def answer(rid: np.ndarray, value: np.ndarray):
        """Sums by row, packed by the partition that the rows came from; rows are in order."""
        order = np.argsort(rid, kind="stable")
        rid, value = rid[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else np.zeros(0, np.int64)
        rid, value = rid[first], (np.add.reduceat(value, first) if len(first) else value).astype(np.float32)
        cuts = np.flatnonzero(np.diff(rid >> 33)) + 1
        for own, v in zip(np.split(rid, cuts), np.split(value, cuts), strict=True):
            if len(own):
                yield int(own[0] >> 33), pack([own[:1], np.diff(own), v.view(np.uint32).astype(np.int64)])

    def deal(batches):
        tree, rank = shared.value
        kept, size = [], 0

        def emit():
            rid, learned, start, x, bucket, *cs = (np.concatenate(z) for z in zip(*kept, strict=True))
            order = np.lexsort((rid, bucket)) if np.any(np.diff(rid) < 0) else np.argsort(bucket, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[i:j]
                yield int(bucket[at[0]]), pack([rid[at[:1]], np.diff(rid[at]), learned[at], start[at], x[at], *(c[at] for c in cs)])

        def rows(made):
            made = list(made)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([v for _, v in made], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for cell in batch.column("coded"):
                rid, learned, n, x = _decoded(cell)
                row = K.row_of(n)
                if tree.hot is None:
                    sums = np.bincount(row, tree.score(x), len(rid))
                else:
                    cs = contexts(x, depth, none)
                    start, here, _ = tree.levels.hottest(tree.hot, cs, none)
                    far = np.ones(len(x), bool)
                    far[here] = False
                    for level in range(1, depth):  # texts that begin before a longer context
                        far &= ~((start == level) & (cs[level] == none))
                    here, far = np.flatnonzero(~far), np.flatnonzero(far)
                    sums = np.bincount(row[here], tree.climb(x[here], [c[here] for c in cs], start[here])[0], len(rid))
                    if len(far):
                        start = start[far]
                        h = np.zeros(len(far), np.uint64)
                        for level, c in enumerate(cs):
                            at = start >= level
                            h = np.where(at, K.mix(h * np.uint64(0x9E3779B97F4A7C15) + c[far].astype(np.uint64) + np.uint64(1)), h)
                        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32)
                        kept.append((rid[row[far]], learned[row[far]], start.astype(np.int8), rank[x[far]], bucket, *(rank[c[far]] for c in cs)))
                        size += len(far)
                yield rows((-1 - k, blob) for k, blob in answer(rid, sums))
                if size > config.dealt:
                    yield rows(emit())
                    kept, size = [], 0
        if kept:
            yield rows(emit())

    def solve(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            made = [(-1 - bucket, v.as_py()) for v in table.column("blob")]
        else:
            tree, rank = shared.value
            parts = [unpack(v.as_buffer()) for v in table.column("blob")]
            rid = np.concatenate([np.concatenate([p[0], p[0] + np.cumsum(p[1])]) for p in parts])
            learned, start, x, *cs = (np.concatenate(z) for z in zip(*(p[2:] for p in parts), strict=True))
            del parts
            made = list(answer(rid, subtrees(tree, np.argsort(rank), config, learned, start, x, cs)))
        return pa.table([pa.array([k for k, _ in made], pa.int64()), pa.array([v for _, v in made], pa.binary())], ["src", "blob"])

    def gather(table: pa.Table) -> pa.Table:
        sums, src = np.zeros(0), table.column("src")[0].as_py() << 33
        for blob in table.column("blob"):  # each has a row once
            first, steps, value = unpack(blob.as_buffer())
            own = np.concatenate([first, first + np.cumsum(steps)]) - src
            if own[-1] >= len(sums):
                sums = np.concatenate([sums, np.zeros(max(len(sums), int(own[-1]) + 1 - len(sums)))])
            sums[own] += value.astype(np.uint32).view(np.float32)
        at = np.flatnonzero(sums)  # every row has its end mark, whose probability is under one
        return pa.table([pa.array(at + src), pa.array(sums[at])], ["rid", "score"])

    dealt = coded.select("coded").mapInArrow(K.tidy(deal), "bucket long, blob binary")
    return dealt.groupBy("bucket").applyInArrow(solve, "src long, blob binary").groupBy("src").applyInArrow(gather, "rid long, score double")


def subtrees(tree: Tree, symbol: np.ndarray, config: Config, learned: np.ndarray, start: np.ndarray, x: np.ndarray, cs: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each symbol `x` after the contexts `cs`, all as ranks, newest first.

    Of each the shortest context that is not hot has `start` + 1 symbols; all its occurrences are here."""
    none, depth = len(symbol) - 1, len(cs)
    bits = max(1, int(none).bit_length())
    absent = int(np.flatnonzero(symbol == none)[0])
    # distinct windows: contexts in order, the newest symbol first
    if bits * (depth + 1) < 64:
        key = cs[0]
        for c in (*cs[1:], x):
            key = (key << bits) | c
        order = np.argsort(key)
        del key
    else:
        order = np.lexsort((x, *cs[::-1]))
    cs, x = [c[order] for c in cs], x[order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    step = []
    for c in cs:
        new[1:] |= c[1:] != c[:-1]
        step.append(new.copy())
    new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    n = np.bincount(of, learned, len(first))
    start, x = start[order[first]], x[first]
    cs = [c[first] for c in cs]
    groups = [(np.cumsum(each) - 1)[first] for each in step]
    del order, new, step, first, learned
    # of the hot contexts: what the tree has
    out, up = tree.climb(symbol[x], [symbol[c] for c in cs], start)
    # counts, divergence and weights of the others, a level at a time
    found = []
    for level in range(depth):
        g, here = groups[level], (start <= level) & (cs[level] != absent)
        size = int(g[-1]) + 1
        total = np.bincount(g, n, size)
        rep = np.flatnonzero(here)  # a window of each sequence
        of_seq = np.arange(len(rep))
        if level < depth - 1:
            key = (g[rep] << bits) | x[rep]
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            of_seq[order] = np.cumsum(new) - 1
            count = np.bincount(of_seq, n[rep])
            rep, windows = rep[order[new]], rep
        else:
            count, windows = n[rep], rep
        listed = count >= config.fewest
        own = g[rep]
        share = np.where(listed, (count - config.discount) / np.maximum(total[own], 1), 0.0)
        of_window = np.zeros(len(g))
        of_window[windows] = share[of_seq]
        rep, own, c, s = rep[listed], own[listed], count[listed], share[listed]
        u = up[rep]
        mass, up_mass = np.bincount(own, c, size), np.minimum(np.bincount(own, u, size), 1 - 1e-9)
        kinds, safe = np.bincount(own, minlength=size), np.maximum(total, 1)
        left_over, up_rest = np.maximum(safe - mass, 0), 1 - up_mass
        gain = np.bincount(own, c * np.log(c / safe[own] / u), size) + np.where(left_over > 0, left_over * np.log(np.maximum(left_over, 1e-300) / safe / up_rest), 0)
        keep = (kinds > 0) & (gain > config.price * (kinds + 1) * np.log(np.maximum(total, 2)))
        weight = np.log10(np.maximum(1 - np.bincount(own, s, size), 1e-12) / up_rest)
        found.append((here, keep, weight, of_window))
        up = np.where(here, of_window, up)
    for level in range(depth - 1, 0, -1):  # with a state its suffixes
        here, keep = found[level][:2]
        found[level - 1][1][groups[level - 1][here & keep[groups[level]]]] = True
    for level, (here, keep, weight, share) in enumerate(found):
        g = groups[level]
        state = here & keep[g]
        out = np.where(state, np.where(share > 0, np.log10(np.where(share > 0, share, 1)), out + weight[g]), out)
    return out[of]


def _alphabet(words: DataFrame, texts: int, least: int) -> Alphabet:
    often = words.where(F.col("n") >= least).select("key", "n").toArrow()  # at most 1 / floor rows
    keys, n = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(keys)
    classes = words.where(F.col("n") < least).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    own = classes.where(F.col("n") >= least).toArrow()  # at most 1 / floor rows
    rest = classes.where(F.col("n") < least).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    by = np.argsort(own.column("ending").to_numpy())
    column = lambda name: own.column(name).to_numpy()[by].astype(np.int64)
    count = np.concatenate([[texts], n[order], column("n"), [rest["n"]]]).astype(np.int64)
    kinds = np.concatenate([np.zeros(1 + len(keys)), column("kinds"), [rest["kinds"]]]).astype(np.int64)
    return Alphabet(keys[order], column("ending"), count, kinds)


def score(docs: DataFrame, usable: Column, config: Config = WHOLE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    `usable` says which rows the model learns from."""
    spark = docs.sparkSession
    learned = docs.where(usable)
    counts = checkpoint(count_words(learned, config))
    words = counts.where(F.col("kind") == WORD)
    size = {r["kind"]: (r["n"], r["kinds"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    texts = size.get(TEXT, (0, 0))[0] or 0
    total = (size.get(WORD, (0, 0))[0] or 0) + texts
    vocabulary = (size.get(WORD, (0, 0))[1] or 0) + (texts > 0)
    base = total + 0.5 * (vocabulary + 1)

    least = config.threshold(total)
    alphabet = _alphabet(words, texts, least)

    # counts of the frequent words, as many as may be broadcast, and those of the tree
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted((r["level"], r["c"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect())
    room, lowest = config.known_words, None
    for at, c in reversed(sizes):
        if c > room:
            break
        room, lowest = room - c, at
    frequent = words.where((F.col("n") >= least) | (level >= lowest if lowest is not None else F.lit(False))).select("key", "n").toArrow()
    known, held = frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(known)
    known, held = known[order], held[order]
    del frequent
    pa.default_memory_pool().release_unused()
    shared = spark.sparkContext.broadcast((alphabet, known, held))
    log_base = float(np.log10(base))
    end_value = float(np.log10(texts + 0.5))
    names = ["rid", "doc_id", "word", "unseen", "n_tokens", "hits", "plain", "score", "coded"]

    def run(batches):
        alphabet, known, held = shared.value
        plain_value, own_value = np.log10(held + 0.5), np.log10(held - config.discount)
        # of each class: its words together, and a word of it that was not seen
        whole = np.log10(np.maximum(alphabet.count, 1))
        unseen = np.where(alphabet.kinds > 0, np.log10(np.maximum(config.discount * alphabet.kinds, 1e-300)), 0.0)
        for batch in batches:
            rid, ids = batch.column("rid"), batch.column("doc_id")
            numbers, learned = rid.to_numpy(), batch.column("learned").to_numpy(zero_copy_only=False)
            raw, offsets, _ = K.buffers(batch.column("text"))
            rows = batch.num_rows
            n_tokens, hits, plain, full = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
            for i, j in K.slices(offsets):
                h, ending, n = tokens(raw, offsets[i : j + 1])
                n_tokens[i:j] = n + 1
                row = K.row_of(n)
                sym = alphabet.symbols(h, ending)
                in_class = alphabet.is_class(sym)
                full[i:j] = -np.bincount(row[in_class], whole[sym[in_class]], j - i)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                seen = known[at] == h if len(known) else np.zeros(len(h), bool)
                hits[i:j] = np.bincount(row[seen], minlength=j - i)
                plain[i:j] = np.bincount(row[seen], plain_value[at[seen]], j - i)
                both = np.flatnonzero(seen & in_class)
                full[i:j] += np.bincount(row[both], own_value[at[both]], j - i)
                rare = np.flatnonzero(~seen)
                if len(rare):
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(row[rare] + i)), pa.nulls(len(rare), pa.int64()), pa.array(h[rare].view(np.int64)), pa.array(unseen[sym[rare]]), *[pa.nulls(len(rare), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())] + [pa.array([_coded(numbers[i:j], learned[i:j], n, sym)], pa.binary())], names)
            yield pa.RecordBatch.from_arrays([rid, ids, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.float64()), pa.array(n_tokens), pa.array(hits), pa.array(plain), pa.array(full), pa.nulls(rows, pa.binary())], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(usable, F.lit(False)).alias("learned"))
    # read back more than once: the numbers of the rows must stay the same
    both = checkpoint(numbered.mapInArrow(K.tidy(run), "rid long, doc_id long, word long, unseen double, n_tokens long, hits long, plain double, score double, coded binary"))

    # the tree, a level at a time: with `fewest` only below the hot contexts, the rest is made where it is used
    coded = both.where("coded is not null").select("coded")
    levels, found, hot = Levels([]), [], None
    if config.fewest:
        hot = [alphabet.count >= max(config.hot(total), 1)]
    for level in range(config.depth):
        made = count_sequences(coded, levels, config, hot).where(F.col("n") >= (config.fewest or least)).toArrow()
        keys, n = made.column("key").to_numpy(), made.column("n").to_numpy()
        order = np.argsort(keys)
        levels, found = Levels([*levels.keys, keys[order]]), [*found, n[order]]
        del made
        if hot and level < config.depth - 1:
            hot.append((found[-1] >= config.hot(total)) & (levels.keys[-1] & ((1 << _BITS) - 1) != 0))
    tree = build(alphabet, levels, found, config, hot)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // config.bucket))
    treed = rest(coded, tree, alphabet, config, buckets)
    rare = both.where("word is not null").select("word", "rid", "unseen")
    looked = rare.hint("merge").join(words.select(F.col("key").alias("word"), F.col("n").alias("c")).hint("merge"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    nothing = F.lit(None)
    # words that are not broadcast are in classes
    own = F.when(c > 0, F.log10(c - config.discount)).otherwise(F.col("unseen"))
    added = looked.select("rid", nothing.cast("long"), nothing.cast("long"), (c > 0).cast("long"), F.log10(c + 0.5), own)
    scored = both.where("rid is not null and word is null").select("rid", "doc_id", "n_tokens", "hits", "plain", "score")
    parts = treed.select("rid", nothing.cast("long"), nothing.cast("long"), nothing.cast("long"), nothing.cast("double"), "score")
    merged = scored.union(added).union(parts).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("hits").alias("hits"), F.sum("plain").alias("plain"), F.sum("score").alias("score"))
    plain = F.col("plain") + F.lit(end_value) - F.col("n_tokens") * F.lit(log_base)
    return merged.select("doc_id", "n_tokens", (F.col("hits") + int(texts > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), plain.alias("base_score"), "score")
