"""Order-preserving packing of token streams into sequences of at most `length` tokens.

Documents are tokenised and laid end to end in the order of their partition. A dynamic
programme picks the cuts: candidates are document ends, sentence ends and, at a price, points
inside long sentences; its cost is padding plus a penalty for each document or sentence that a
cut truncates. For a window ending at p, the best start is the least of (cost(i) + position(i))
over the last `length` tokens, which a monotone queue gives in constant time; sequences whose
size is a power of two need no padding; they are looked up by position, in the tail of a partition. Each partition packs by
itself: nothing is shuffled or gathered, memory holds one stretch of `stretch` tokens plus the
open document, and a lost task is simply run again.

A stretch is closed at its cheapest late cut and the rest is carried on, so only the end of a
partition has a tail: its last `length` tokens, where every token is a candidate and sizes that are
powers of two are tried.

Defined cases: a null or empty text is its end id alone; texts of any length span as many
sequences as they need; repeated rows are packed each by itself; an empty table gives no piece;
further columns are ignored.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm import kernels as K

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Config:
    vocabulary: str = ""  # path of the tokenizer's file on every executor; empty: that of the installed word_bpe_49k.json
    length: int = 4096
    end_id: int = 2
    stretch: int = 1 << 17
    sentence_penalty: float = 0.25  # a document cut at a sentence end
    token_penalty: float = 2.0  # a cut inside a sentence
    inner: int = 16  # tokens between candidates inside a sentence
    cache: int = 400_000  # words whose ids are kept

    def path(self) -> str:
        if self.vocabulary:
            return self.vocabulary
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters alone are looked up one by one: for them the tokenizer's own
#: normalisation is lower-casing, and no token crosses white space.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]{1,256}")
#: White space to Python but not to the tokenizer.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the bytes of plain characters: printable Latin-1 bytes as themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 0x250)}


class _Numbers(dict):
    """Numbers words as they come up; `new` has those without ids."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class Words:
    """The tokenizer's ids, with a bounded memory of words.

    A word of letters alone, or of marks alone, is one unit to the tokenizer and goes to its model
    directly; a word that ends in marks is its stem and the marks; others go through the whole tokenizer."""

    def __init__(self, config: Config):
        from tokenizers import Tokenizer

        self.config, self.tokenizer = config, Tokenizer.from_file(config.path())
        self.model = self.tokenizer.model
        stop = {token for token in (".", "!", "?", "...", "!!", "??", "?!", ".\"", ".)", "!!!", "???", "..")}
        vocabulary = self.tokenizer.get_vocab()
        self.stops = np.zeros(max(vocabulary.values()) + 1, bool)
        self.stops[[i for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4] in stop]] = True
        self.special = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.lo, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)  # n is -1 where the text goes through the whole tokenizer
        self.used = 0

    def _store(self, numbers, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.lo[numbers] = self.used + np.cumsum(counts) - counts
        self.n[numbers] = counts
        self.used += len(ids)

    def _gather(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.lo[k] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def learn(self) -> None:
        """Finds the ids of all words that have a number but no ids yet."""
        index, new = self.index, self.index.new
        single, joined, stems, odd = [], [], [], []
        for w in new:  # grows by stems and marks
            if w.isascii() and w.isalpha() and len(w) <= 256:
                single.append(w)
            elif not _PLAIN.fullmatch(w) or not unicodedata.is_normalized("NFC", w) or any(x in w for x in self.special):
                odd.append(w)
            elif w.isalpha():
                single.append(w)
            else:
                stem = w.rstrip(string.punctuation)
                if not stem:
                    single.append(w)
                elif len(stem) < len(w) and stem[-1].isalnum():
                    stems.append((index[w], index[stem], index[w[len(stem) :]]))
                else:
                    joined.append(w)
        while len(index) > len(self.n):
            self.lo, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lo, self.n))
        flat: list[int] = []
        counts = []
        tokenize, letters = self.model.tokenize, self.letters
        for w in single:
            own = [t.id for t in tokenize(w if w.isascii() else w.translate(letters))]
            flat += own
            counts.append(len(own))
        self._store([index[w] for w in single], np.array(flat, np.uint32), np.array(counts, np.int64))
        for i in range(0, len(joined), 4096):
            words = joined[i : i + 4096]
            coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
            owner = np.searchsorted(begins, [a for a, _ in coded.offsets], "right") - 1
            self._store([index[w] for w in words], np.array(coded.ids, np.uint32), np.bincount(owner, minlength=len(words)))
        self.n[[index[w] for w in odd]] = -1
        if stems:
            whole, parts = np.array(stems)[:, 0], np.array(stems)[:, 1:].ravel()
            n = self.n[parts]
            self._store(whole, self._gather(parts, n), n.reshape(-1, 2).sum(1))
        new.clear()

    def words(self, texts: list[str]) -> list[np.ndarray | None]:
        """The numbers of each text's words, all of them learned; None where the text goes through the whole tokenizer."""
        if len(self.index) > self.config.cache:
            self.clear()
        number = self.index.__getitem__
        lists: list = []
        for t in texts:
            own = None if any(x in t for x in _NOT_SPACE) else t.lower().split()
            lists.append(own if own is None else np.fromiter(map(number, own), np.int64, len(own)))
        if self.index.new:
            self.learn()
        return lists

    def ids(self, text: str, words: np.ndarray | None) -> np.ndarray:
        if words is not None:
            n = self.n[words]
            if not len(n) or n.min() >= 0:
                return self._gather(words, n)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, config: Config, final: bool) -> list[int]:
    """Ends of the sequences of one stretch, increasing. Unless `final`, tokens after the last one are left over."""
    size, length = len(ids), config.length
    if not size:
        return []
    is_end = np.zeros(size + 1, bool)
    is_end[doc_ends[doc_ends <= size]] = True
    price = np.full(size + 1, config.token_penalty)
    sentence = np.flatnonzero(stops[ids]) + 1
    price[sentence] = config.sentence_penalty
    price[is_end] = 0.0
    price[0] = price[size] = 0.0
    good = price < config.token_penalty
    at = np.flatnonzero(good)
    gaps = np.diff(at)
    long = np.flatnonzero(gaps > config.inner)
    if len(long):
        n = (gaps[long] - 1) // config.inner
        inner = np.repeat(at[long], n) + config.inner * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        good[inner] = True
    if final:
        good[max(0, size - length) :] = True
    at = np.flatnonzero(good)
    positions, prices = at.tolist(), price[at].tolist()
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    index = {p: i for i, p in enumerate(positions)}
    tail = max(0, size - length)
    cost, back = [0.0] * len(positions), [0] * len(positions)
    queue: deque = deque([(0.0, 0, 0)])  # (cost + position, position, candidate), increasing in both
    for j in range(1, len(positions)):
        p = positions[j]
        low = p - length
        while queue[0][1] < low:
            queue.popleft()
        key, at_i, i = queue[0]
        best = key + length - p
        if final and p > tail:
            for w in powers:
                k = index.get(p - w)
                if k is not None and cost[k] < best:
                    best, i = cost[k], k
        elif at_i == low:
            best = min(best, cost[i])
        best += prices[j]
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    if final:
        j = len(positions) - 1
    else:  # the cheapest state of the last window, padding counted to its end
        first = int(np.searchsorted(at, size - length))
        j = min(range(first, len(positions)), key=lambda k: cost[k] + positions[k] * 1e-6)
    out = []
    while j:
        out.append(positions[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs the documents of one partition, in order."""

    def __init__(self, words: Words, config: Config, part: int):
        self.words, self.config = words, config
        self.sequence = part << 40
        self.held: list = []  # [doc_id, ids not packed yet, tokens before them, tokens of the document]
        self.size = 0

    def add(self, doc_id, text: str, words: np.ndarray | None):
        ids = np.append(self.words.ids(text, words), np.uint32(self.config.end_id))
        for lo in range(0, len(ids), self.config.stretch):
            part = ids[lo : lo + self.config.stretch]
            self.held.append([doc_id, part, lo, len(ids)])
            self.size += len(part)
            if self.size >= self.config.stretch:
                yield from self.pack(False)

    def pack(self, final: bool):
        if not self.held:
            return
        ids = np.concatenate([x[1] for x in self.held])
        lengths = np.cumsum([len(x[1]) for x in self.held])
        closes = np.array([x[2] + len(x[1]) == x[3] for x in self.held])
        ends = cuts(ids, lengths[closes], self.words.stops, self.config, final)
        bounds = np.unique(np.concatenate([[0], ends, lengths]).astype(np.int64))
        last = ends[-1] if ends else 0
        bounds = bounds[bounds <= last]
        ends_at = np.array(ends, np.int64)
        begins = lengths - [len(x[1]) for x in self.held]
        raw = ids.astype("<u4")
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            d = int(np.searchsorted(lengths, lo, "right"))
            q = int(np.searchsorted(ends_at, lo, "right"))
            doc = self.held[d]
            yield doc[0], doc[2] + lo - int(begins[d]), hi - lo, zlib.crc32(raw[lo:hi].tobytes()), doc[3], self.sequence + q, lo - (ends[q - 1] if q else 0)
        self.sequence += len(ends)
        rest = []
        for d, doc in enumerate(self.held):
            cut = max(0, last - int(begins[d]))
            if cut < len(doc[1]):
                rest.append([doc[0], doc[1][cut:], doc[2] + cut, doc[3]])
        self.held, self.size = rest, len(ids) - last


_WORDS: dict[Config, Words] = {}  # one for each Python worker


def pack(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        if config not in _WORDS:
            _WORDS.clear()
            _WORDS[config] = Words(config)
        packer = Packer(_WORDS[config], config, TaskContext.get().partitionId())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list = []

        def flush():
            columns = zip(*rows, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)
            rows.clear()
            return made

        for batch in batches:
            ids, cells = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in K.slices(K.buffers(cells)[1]):
                texts = [x or "" for x in cells.slice(i, j - i).to_pylist()]
                for doc_id, text, words in zip(ids[i:j], texts, packer.words.words(texts), strict=True):
                    rows.extend(packer.add(doc_id, text, words))
                if len(rows) > 20_000:
                    yield flush()
        rows.extend(packer.pack(True))
        if rows:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(K.tidy(run), SCHEMA)
