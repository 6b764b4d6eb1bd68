"""License scans: where texts carry license notices, and how much of a notice.

The word k-grams of the templates make an inverted index, which is all that is broadcast; k is the
run of words that is sure to stay whole when as many of a template's words are replaced or left out
as `coverage` allows, but `gram` at most. The k-grams are winnowed (in each window of consecutive
ones the least hash is kept) only where that run spans a whole window, so no such notice is without
a hit. A text's k-grams are looked up; hits of one template on near diagonals form a candidate. A
candidate is confirmed by a banded local alignment of the template's words with the text's words
around it, which gives the matched words, their share of the template and the span; what lies
before and after a match is aligned again, as notices may follow each other closely. Of matches
that overlap the one with more matched words is reported, of equal numbers that of the shorter template.

Words are runs of letters, digits and non-ASCII bytes, in lower case. Spans are in code points.
Defined cases: null, empty and wordless texts have no match; repeated rows are scanned each by
itself; ties between templates go to the one that sorts first; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import kernels as K
from tidemark.llm.notices import TEMPLATES

SCHEMA = "doc_id long, license string, template int, matched_words int, coverage double, start long, end long"

_CLASSES = np.where(K.WORD_MARK == 1, 1, 0).astype(np.uint8)


@dataclass(frozen=True)
class Config:
    gram: int = 3
    window: int = 3
    band: int = 8  # words that an alignment may drift from its diagonal, an eighth of a template's words if that is more
    coverage: float = 0.75  # least matched share of a template's words


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window; the last of equals. At least one if there is any."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    g = h
    for i in range(1, k):
        g = K.pair(g[:-1], h[i:]) if len(h) > i else np.zeros(0, np.uint64)
    return g


def _sure_run(n: int, coverage: float) -> int:
    """Words that stay side by side however the replaced or missing words of a match lie in a template of n words."""
    matched = next(m for m in range(n + 1) if m >= coverage * n)
    return -(-matched // (n - matched + 1))


class Index:
    """Fingerprints of the templates by gram length: sorted hashes, each with its template and position."""

    def __init__(self, templates: list[tuple[str, str]], config: Config):
        self.words, self.bands = [], []
        rows: dict[int, list] = {}
        for t, (_, text) in enumerate(templates):
            b = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
            h = K.hashes(b, *K.runs(b, np.array([0, len(b)], np.int64), _CLASSES))
            self.words.append(h)
            self.bands.append(max(config.band, len(h) // 8))
            run = _sure_run(len(h), config.coverage)
            k = max(1, min(config.gram, run))
            g = _grams(h, k)
            kept = winnow(g, config.window) if run >= k + config.window - 1 else range(len(g))
            rows.setdefault(k, []).extend((int(g[p]), t, int(p)) for p in kept)
        self.grams = {}
        for k, own in rows.items():
            own.sort()
            self.grams[k] = np.array([r[0] for r in own], np.uint64), np.array([r[1] for r in own], np.int64), np.array([r[2] for r in own], np.int64)

    def hits(self, h: np.ndarray):
        """(position in the text, template, position in the template) of every pair of equal k-grams."""
        out = []
        for k, (keys, template, position) in self.grams.items():
            g = _grams(h, k)
            lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            at = np.flatnonzero(hi > lo)
            n = (hi - lo)[at]
            entry = np.repeat(lo[at], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            out.append((np.repeat(at, n), template[entry], position[entry]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def hit_at(self, h: np.ndarray) -> np.ndarray:
        """Positions of words where a k-gram of some template begins."""
        return np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(np.isin(_grams(h, k), keys)) for k, (keys, _, _) in self.grams.items())])


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int):
    """Best local alignment within `band` of the diagonal text = template + shift: (matched words, first, last) or None.

    Match +1, replaced word or gap -1; ties prefer the longer match."""
    width = 2 * band + 1
    previous: list = [(0, 0, -1, -1)] * (width + 2)  # score, matched, first, last; cell d is text position i + shift - band + d
    best = (0, 0, -1, -1)
    for i, word in enumerate(template):
        row: list = [(0, 0, -1, -1)] * (width + 2)
        for d in range(width):
            j = i + shift - band + d
            if 0 <= j < len(text):
                s, m, a, z = previous[d]
                if text[j] == word:
                    cell = (s + 1, m + 1, a if a >= 0 else j, j)
                else:
                    cell = (s - 1, m, a, z)
                for other in (previous[d + 1], row[d - 1] if d else (0, 0, -1, -1)):  # a word of the template or of the text left out
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                # at 0 what matched so far stays, since it makes the match longer
                row[d] = cell if cell[0] >= 0 else (0, 0, -1, -1)
                if (cell[0], cell[1]) > best[:2]:
                    best = cell
        previous = row
    return best[1:] if best[0] > 0 else None


def matches(h: np.ndarray, index: Index, config: Config) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) of a text with word hashes h."""
    at, template, position = index.hits(h)
    if not len(at):
        return []
    diagonal = at - position
    order = np.lexsort((diagonal, template))
    found = []
    begin = 0
    for k in range(1, len(order) + 1):
        if k < len(order) and template[order[k]] == template[order[begin]] and diagonal[order[k]] - diagonal[order[begin]] <= index.bands[template[order[begin]]]:
            continue
        t, shift = int(template[order[begin]]), int(diagonal[order[begin]])
        own, band = index.words[t], index.bands[t]
        least = config.coverage * len(own)
        open_ = [(max(0, shift - band), min(len(h), shift + len(own) + 2 * band))]
        while open_:
            lo, hi = open_.pop()
            # too few of the template's words are there for a match
            if hi - lo < least or np.isin(own, h[lo:hi]).sum() < least:
                continue
            got = align(own, h[lo:hi], shift - lo, band)
            if got and got[0] >= least:
                found.append((t, got[0], lo + got[1], lo + got[2]))
                open_ += [(lo, lo + got[1]), (lo + got[2] + 1, hi)]
        begin = k
    found.sort(key=lambda x: (-x[1], len(index.words[x[0]]), x[0], x[2]))
    kept: list = []
    taken: dict[int, bool] = {}
    for x in found:
        if not any(w in taken for w in range(x[2], x[3] + 1)):
            kept.append(x)
            taken.update(dict.fromkeys(range(x[2], x[3] + 1), True))
    return sorted(kept, key=lambda x: x[2])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, config: Config = Config()) -> DataFrame:
    """doc_id, license, template, matched_words, coverage, start, end of every match."""
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        index = Index(templates, config)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw, offsets, _ = K.buffers(batch.column("text"))
            rows: list = []
            for i, j in K.slices(offsets):
                h, counts = K.words(raw, offsets[i : j + 1], _CLASSES)
                ends = np.cumsum(counts)
                for r in np.unique(np.searchsorted(ends, index.hit_at(h), "right")):
                    own = h[ends[r] - counts[r] : ends[r]]
                    got = matches(own, index, config)
                    if not got:
                        continue
                    text = raw[offsets[i + r] : offsets[i + r + 1]]
                    s, e = K.runs(text, np.array([0, len(text)], np.int64), _CLASSES)
                    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((text & 0xC0) != 0x80)])
                    rows += [(ids[i + r], templates[t][0], t, n, n / len(index.words[t]), int(points[s[a]]), int(points[e[z]])) for t, n, a, z in got]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(K.tidy(run), SCHEMA)
