"""Substring dedup: hashing of lines and of the parts that content cuts them into.

Lines are units. Inside a line a unit also begins at a sentence, and in a long sentence at words
that the words around them pick: a word whose hash is the least among its `reach` neighbours on
both sides. Cuts depend on nothing but the words close by, so a passage that two texts share, wherever
it begins in their lines and sentences, is cut alike but for its first and last few words. Of
sentences that begin within `short` words of each other the least hash decides as well, so a unit
inside a line has `short` words at least.

A unit is normalised (A-Z lower, white space of any length equal) and hashed. Digests are grouped
over the whole table: the smallest doc_id that holds one owns it. A unit is a repeat where another
document owns its digest or where it came up earlier in the same text. A run of repeats is removed
if it has at least `min_words` words, so passages that recur go as a whole while lines and sentences
that recur by chance stay; with `min_words` 1 every later occurrence of a unit goes. Units of under
`short` words decide nothing and go with a run around them, unless `min_words` is below that.

Spans are in code points of the original text. Defined cases: null texts stay null and have no
unit; empty texts are returned as they are; rows that repeat a doc_id count as one document for
ownership, so each keeps what that id owns; rows with null doc_id own nothing, so what only they
hold stays in all of them; further columns pass through untouched, whatever they are called, but for
one named removed_spans, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import checkpoint

SPAN = "array<struct<start:long,end:long,first_doc_id:long>>"


@dataclass(frozen=True)
class Config:
    min_words: int = 20
    short: int = 3
    reach: int = 5  # words on both sides that a cut inside a sentence is the least of

    @property
    def deciding(self) -> int:
        """Least words of a unit that can be a repeat."""
        return min(self.short, self.min_words)


_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?"]] = True


def _least(h: np.ndarray, group: np.ndarray, reach: int, among: np.ndarray) -> np.ndarray:
    """Which words of `among` have the least hash of all words of `among` within `reach` in the same group, the first of equals."""
    top = np.uint64(2**64 - 1)
    own = np.where(among, h, top)
    found = among.copy()
    for k in range(1, reach + 1):
        same = group[k:] == group[:-k]
        found[k:] &= ~(same & among[:-k] & (own[:-k] <= own[k:]))
        found[:-k] &= ~(same & among[k:] & (own[k:] < own[:-k]))
    return found


def _near(marks: np.ndarray, reach: int) -> np.ndarray:
    """Words with a marked one at under `reach` words' distance."""
    out = marks.copy()
    for k in range(1, reach):
        out[k:] |= marks[:-k]
        out[:-k] |= marks[k:]
    return out


def units(b: np.ndarray, offsets: np.ndarray, config: Config):
    """(row, digest, first byte, end byte, words) of the units of all rows, given in lower case."""
    s, e = K.runs(b, offsets, K.WORD)
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, none
    h = K.hashes(b, s, e)
    row = np.searchsorted(offsets, s, "right") - 1
    breaks = np.cumsum(b == 10)
    line = np.ones(len(s), bool)
    line[1:] = (row[1:] != row[:-1]) | (breaks[s[1:]] != breaks[s[:-1]])
    of_line = np.cumsum(line)
    ends_soon = np.zeros(len(s), bool)  # too close to the end of its line
    ends_soon[: -config.short + 1 or None] = of_line[: -config.short + 1 or None] != of_line[config.short - 1 :]
    ends_soon[len(s) - config.short + 1 :] = True
    opens = np.zeros(len(s), bool)
    opens[1:] = _STOP[b[e[:-1] - 1]]
    # a line's own beginning goes before all others near it
    cuts = line | _least(np.where(line, np.uint64(0), h | np.uint64(1)), of_line, config.short - 1, (opens & ~ends_soon) | line)
    cuts |= _least(h, of_line, config.reach, np.ones(len(s), bool)) & ~_near(cuts, config.short) & ~ends_soon
    first = np.flatnonzero(cuts)
    last = np.append(first[1:], len(s))
    up, down = K.powers(len(s) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    digest = K.mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return row[first], digest, s[first], e[last - 1], last - first


def _slices(column, config: Config):
    """(first row, bytes, offsets, units) of the texts of a column, a slice at a time."""
    raw, offsets, _ = K.buffers(column)
    for i, j in K.slices(offsets):
        own, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, own, off, units(K.LOWER[own], off, config)


def digests(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, row, digest): the distinct units of each row that can decide; `row` is a hash of id and text."""
    names = ["doc_id", "row", "digest"]

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row")
            for i, _, _, (row, digest, _, _, n) in _slices(batch.column("text"), config):
                keep = n >= config.deciding
                row, digest = row[keep], digest[keep]
                order = np.lexsort((digest, row))
                row, digest = row[order], digest[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
                at = pa.array(row[new] + i)
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(digest[new].view(np.int64))], names)

    return docs.mapInArrow(K.tidy(run), "doc_id long, row long, digest long")


def removals(digest: np.ndarray, n: np.ndarray, repeat: np.ndarray, config: Config) -> list[tuple[int, int]]:
    """(first, last) units of the runs of repeats of one text that are long enough."""
    decides = n >= config.deciding
    out, i = [], 0
    for i in np.flatnonzero(repeat & ~np.concatenate([[False], repeat[:-1]])).tolist():
        if out and i <= out[-1][1]:
            continue
        j = last = i
        while j < len(digest) and (repeat[j] or not decides[j]):
            last = j if repeat[j] else last
            j += 1
        if n[i : last + 1].sum() >= config.min_words:
            out.append((i, last))
    return out


def _span(own: np.ndarray, lo: int, hi: int, after: int) -> tuple[int, int]:
    """Bytes lo to hi of a text, with the white space up to `after` where they are whole lines."""
    before = own[:lo][::-1]
    blank = K.IS_SPACE[before]
    gap = len(before) if blank.all() else int(np.argmin(blank))
    opens = gap == len(before) or (own[lo - gap : lo] == 10).any()
    closes = after == len(own) or (own[hi:after] == 10).any()
    return (lo, after) if opens and closes else (lo, hi)


def dedup(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The columns of `docs` with repeats taken from `text`, and `removed_spans` of the original text."""
    docs = docs.drop("removed_spans")
    names = docs.columns
    whole = F.struct(*[F.col(f"`{k}`") for k in names]).alias("doc")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    held = checkpoint(digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text").where(F.col("text").isNotNull()), config))
    owners = held.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("holders")).where((F.col("holders") > 1) & F.col("owner").isNotNull())
    # one digest may be in a third of all documents: its holders are split by the skew join, which needs plain exchanges on both sides
    taken = held.hint("merge").join(owners.select("digest", "owner").hint("merge"), "digest").where(~F.col("owner").eqNullSafe(F.col("doc_id")))
    # a set of distinct units of one text, however often its row is repeated; of like hashes of other rows the owner tells
    per_row = taken.groupBy("row").agg(F.collect_set(F.struct("digest", "owner")).alias("taken"))
    both = docs.select(whole, row.alias("row")).hint("merge").join(per_row.hint("merge"), "row", "left").select("doc", "taken")

    def run(batches):
        for batch in batches:
            doc, lists = batch.column("doc"), batch.column("taken")
            columns = {k: doc.field(i) for i, k in enumerate(names)}
            ids = columns["doc_id"].to_pylist()
            texts, spans = list(columns["text"]), [[] for _ in ids]
            starts, entries = lists.offsets.to_numpy(), lists.values
            codes, of = (entries.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            for i, own, off, (row, digest, lo, hi, n) in _slices(columns["text"], config):
                cut = np.searchsorted(row, np.arange(len(off)))
                code = digest.view(np.int64)
                order = np.lexsort((code, row))
                again = np.zeros(len(code), bool)
                again[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
                seen = np.bincount(row[again], minlength=len(off) - 1) > 0
                for r in np.flatnonzero(seen | there[i : i + len(off) - 1]):
                    x = slice(cut[r], cut[r + 1])
                    mine = slice(starts[i + r], starts[i + r + 1]) if there[i + r] else slice(0, 0)
                    foreign = {d: o for d, o in zip(codes[mine].tolist(), of[mine].tolist(), strict=True) if o != ids[i + r]}
                    has = np.isin(code[x], np.fromiter(foreign, np.int64, len(foreign)))
                    repeat = (again[x] | has) & (n[x] >= config.deciding)
                    gone = removals(digest[x], n[x], repeat, config)
                    if not gone:
                        continue
                    text = own[off[r] : off[r + 1]]
                    begins, finish = lo[x] - off[r], hi[x] - off[r]
                    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((text & 0xC0) != 0x80)])
                    kept, at = [], 0
                    for a, z in gone:
                        owner = next((foreign[int(code[x][k])] for k in range(a, z + 1) if has[k]), ids[i + r])
                        p, q = _span(text, int(begins[a]), int(finish[z]), int(begins[z + 1]) if z + 1 < len(begins) else len(text))
                        spans[i + r].append({"start": int(points[p]), "end": int(points[q]), "first_doc_id": owner})
                        kept.append(text[at:p].tobytes())
                        at = q
                    texts[i + r] = b"".join([*kept, text[at:].tobytes()]).decode()
            columns["text"] = pa.array([x if isinstance(x, str) else x.as_py() for x in texts], columns["text"].type)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(spans, kind)], [*names, "removed_spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"removed_spans {SPAN}"])
    return both.mapInArrow(K.tidy(run), schema)
