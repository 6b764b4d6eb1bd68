"""SentencePiece encoding, decoding and sampling of segmentations without replacement.

`encode` and `decode` use a given SentencePiece model as it is. `sample` draws, for each text, `k`
distinct segmentations of its whole lattice with Gumbel top-k: a segmentation's perturbed
log-probability is its log-probability plus Gumbel noise, and the k largest are a sample without
replacement. They are found by perturbed A-star search: the search holds sets of segmentations
with the largest perturbed value of each set, takes the best set, emits that set's best
segmentation and splits what is left of the set at every word. The largest value of a part is a
Gumbel variable cut off at its parent's, so nothing but the emitted segmentations is written out,
and all splits of one set are drawn in one vector operation.

Lattice: a text is what stands between blanks; every word begins with the blank's mark, and no piece
crosses a word. The segmentations of words of up to `unit` characters are listed. A longer word has
nodes and edges instead: sums over all ways to its end, made backwards, give the chance of each edge
at its node, so that segmentations are drawn edge by edge, all words of all texts side by side.
Pieces that the vocabulary has not are their characters' bytes. A BPE vocabulary has ranks instead of probabilities, so the weight of
a piece is by Zipf's law, 1 / (rank + offset), raised to `sharpness`.

The inclusion score of a sample is 1 - exp(-exp(log_p - kappa)), kappa being the perturbed value of
the sample that would come next (the k+1-th): the chance that the segmentation is among those above.

Randomness comes from the row key and the seed alone, so equal keys give equal samples wherever
they run. Defined cases: null and empty texts have one segmentation, of no piece, with inclusion
score 1; fewer than k samples are returned if the lattice has fewer; texts
with line ends or other control characters keep them as byte pieces; rows with null keys use key 0;
repeated rows give repeated samples; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import kernels as K

SCHEMA = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_p double, perturbed double, inclusion double, round_trip boolean"


@dataclass(frozen=True)
class Config:
    model: str = ""  # path of the model on every executor; empty: that of the installed piece_bpe_32k.model
    k: int = 3
    seed: int = 17
    unit: int = 6  # most characters of a word, its mark included, whose segmentations are listed
    offset: float = 2.7
    sharpness: float = 1.0
    cache: int = 450_000  # words whose segmentations or edges are kept

    def path(self) -> str:
        if self.model:
            return self.model
        import public_tokenizers

        return public_tokenizers.path("piece_bpe_32k.model")


MARK = "▁"
#: Stands for a mark that the text itself holds; no valid text holds this code unit.
_OWN_MARK = "\udc81"


#: Longer words have their edges worked out one by one, as they would take as many turns over all others.
_VERY_LONG = 256

#: No piece.
_NONE = -(1 << 40)

#: Bytes of texts that are drawn side by side; their numbers stay in a processor's cache.
_SLICE = 1 << 18

#: Words whose edges are worked out at once.
_TOGETHER = 4096


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of strings that go on with one more character."""
    return K.mix(h + (code + K.U64(1)) * K.U64(0x9E3779B97F4A7C15))


def _utf8(character: str) -> bytes:
    return (MARK if character == _OWN_MARK else character).encode()


class _Words:
    """Numbers words by their hashes as they come up; `new` has those without segmentations."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[str] = []

    def __len__(self) -> int:
        return len(self.keys)

    def number(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words b[start:end]."""
        h = K.hashes(b, starts, ends)
        order = np.argsort(h)  # look-ups in order stay in the processor's cache
        h = h[order]
        at = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == h[inside]
        found = np.zeros(len(h), np.int64)
        found[known] = self.numbers[at[known]]
        other = np.flatnonzero(~known)
        if len(other):
            fresh = np.ones(len(other), bool)
            fresh[1:] = h[other[1:]] != h[other[:-1]]
            first = other[fresh]
            keys, numbers = h[first], len(self) + np.arange(len(first))
            found[other] = numbers[np.cumsum(fresh) - 1]
            data = b.tobytes()
            for s, e in zip(starts[order[first]].tolist(), ends[order[first]].tolist(), strict=True):
                word = data[s:e].decode()
                self.new.append(MARK + (word.replace(MARK, _OWN_MARK) if MARK in word else word))
            spot = at[first]
            self.keys, self.numbers = np.insert(self.keys, spot, keys), np.insert(self.numbers, spot, numbers)
        out = np.empty(len(h), np.int64)
        out[order] = found
        return out


class _Column:
    """An array that grows, of numbers or of rows of `width` numbers."""

    def __init__(self, kind=np.float64, width: int = 0):
        self.data, self.size = np.zeros((1024, width) if width else 1024, kind), 0

    def room(self, n: int) -> np.ndarray:
        """The next `n` places, for the caller to fill."""
        if self.size + n > len(self.data):
            grown = np.empty((max(2 * len(self.data), self.size + n), *self.data.shape[1:]), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.size += n
        return self.data[self.size - n : self.size]

    def add(self, values) -> None:
        self.room(len(values))[:] = values

    @property
    def used(self) -> np.ndarray:
        return self.data[: self.size]


class Lattice:
    """Segmentations of single words (units) with their log-probabilities, and the pieces' ids."""

    def __init__(self, config: Config):
        import sentencepiece

        self.config = config
        self.model = sentencepiece.SentencePieceProcessor(model_file=config.path())
        size = self.model.get_piece_size()
        self.names = [self.model.id_to_piece(i) for i in range(size)]
        self.ids, self.bytes = {}, {}
        for i, name in enumerate(self.names):
            if self.model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                self.ids[name] = i
        first = min(self.ids.values(), default=0)
        rank = np.maximum(np.arange(size) - first, 0)
        weight = -config.sharpness * np.log(rank + config.offset)
        self.weight = weight - np.log(np.exp(weight[sorted(self.ids.values())]).sum())
        self._weights = self.weight.tolist()
        self._by_length: dict = {}
        self.longest = max(map(len, self.ids), default=1)
        self.texts = [b""] * size
        for b, i in self.bytes.items():
            self.texts[i] = bytes([b])
        for name, i in self.ids.items():
            self.texts[i] = name.replace(MARK, " ").encode()
        self.text_size = np.array([len(x) for x in self.texts], np.int64)
        self.text_first = np.cumsum(self.text_size) - self.text_size
        self.text_bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.index = _Words()
        self.first, self.count = _Column(np.int64), _Column(np.int64)  # of each unit: its first segmentation, how many
        # of each segmentation: log-probability, that of all others, cumulative probability plus the unit's number, end of its pieces
        self.log_p, self.others, self.cumulative, self.end = _Column(), _Column(), _Column(), _Column(np.int64)
        self.pieces = _Column(np.uint32)
        self.root = _Column(np.int64)  # of each unit: its first node, -1 where segmentations are listed
        self.edge, self.edges = _Column(np.int64), _Column(np.int64)  # of each node: its first edge, how many
        # of each edge, the likeliest of a node first: cumulative probability plus the node's number, log-probability,
        # probability of the node's others, node after it or -1, side by side as they are read together
        self.step = _Column(width=4)
        self.edge_piece = _Column(np.int32)  # piece or -1 less the number of a run of bytes
        self.byte_runs: dict[str, int] = {}
        self.byte_first, self.byte_count, self.byte_pieces = _Column(np.int64), _Column(np.int64), _Column(np.uint32)
        self.marks = None
        self.path, self.path_end = _Column(np.int64), _Column(np.int64)  # edges of drawn segmentations

    def forget(self) -> None:
        """Drops the segmentations that were drawn."""
        if self.marks:
            self.log_p.size, self.pieces.size = self.marks
            self.others.size = self.end.size = self.marks[0]
        self.path.size = self.path_end.size = 0
        self.marks = self.log_p.size, self.pieces.size

    def _listed(self, units: list[str], n: int):
        """All segmentations of units of n characters: (unit, unnormalised log-weight, pieces in a row, filled up with _NONE)."""
        code = _code_points("".join(units)).reshape(-1, n)
        piece, weight = {}, {}
        for i in range(n):
            h = np.zeros(len(units), np.uint64)
            for size in range(1, min(n - i, self.longest) + 1):
                h = _longer(h, code[:, i + size - 1])
                own, w = np.full(len(units), _NONE), np.zeros(len(units))
                at, k = self._found(h, size)
                own[at], w[at] = k, self.weight[k]
                if size == 1:
                    bare = np.flatnonzero(own == _NONE)
                    own[bare], w[bare] = self._bare(code[bare, i])
                piece[i, size], weight[i, size] = own, w
        of, total, found = [], [], []
        for cuts in range(1 << (n - 1)):
            ends = [k + 1 for k in range(n - 1) if cuts >> k & 1] + [n]
            spans = [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            if any(x not in piece for x in spans):
                continue
            some = np.flatnonzero(np.logical_and.reduce([piece[x] != _NONE for x in spans]))
            own = np.full((len(some), n), _NONE)
            for k, x in enumerate(spans):
                own[:, k] = piece[x][some]
            of.append(some)
            total.append(sum(weight[x][some] for x in spans))
            found.append(own)
        return np.concatenate(of), np.concatenate(total), np.concatenate(found)

    def _found(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes of n characters are pieces, those pieces)."""
        keys, values, filled, _ = self._pieces_of(n)
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(filled[h >> K.U64(44)])
        spot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        hit = keys[spot] == h[at]
        return at[hit], values[spot[hit]]

    def _bare(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(-1 less the number of the run of bytes, log-weight) of characters that are no pieces."""
        kinds, which = np.unique(code, return_inverse=True)
        runs = np.array([self._bytes_of(chr(int(c))) for c in kinds], np.int64)
        heavy = np.array([sum(self._weights[self.bytes[b]] for b in _utf8(chr(int(c)))) for c in kinds])
        return -1 - runs[which], heavy[which]

    def _flat(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces with runs of bytes written out, how many each was)."""
        if not (piece < 0).any():
            return piece, np.ones(len(piece), np.int64)
        runs = np.maximum(-1 - piece, 0)
        n = np.where(piece < 0, self.byte_count.data[runs], 1)
        upto = np.cumsum(n)
        place = np.arange(upto[-1]) - np.repeat(upto - n, n)
        flat = np.repeat(piece, n)
        byte = flat < 0
        flat[byte] = self.byte_pieces.data[(np.repeat(self.byte_first.data[runs], n) + place)[byte]]
        return flat, n

    def _grow(self, units: list[str]) -> np.ndarray:
        """Adds nodes and edges of units; their first nodes."""
        ids, weight, exp, longest = self.ids, self._weights, math.exp, self.longest
        roots, first, count = [], [], []
        cumulative, log_p, others, to, piece = [], [], [], [], []
        node, edges = self.edge.size, self.step.size
        for unit in units:
            n = len(unit)
            ways = [0.0] * (n + 1)  # log of the sum over all ways to the end
            made: list = [None] * n
            for i in range(n - 1, -1, -1):
                own = []
                for j in range(i + 1, min(n, i + longest) + 1):
                    k = ids.get(unit[i:j])
                    if k is not None:
                        own.append((weight[k] + ways[j], j, k))
                    elif j == i + 1:  # a character that is no piece: its bytes
                        k = self._bytes_of(unit[i])
                        own.append((sum(weight[self.bytes[b]] for b in _utf8(unit[i])) + ways[j], j, -1 - k))
                if len(own) > 1:
                    own.sort(reverse=True)
                    top = own[0][0]
                    ways[i] = top + math.log(sum(exp(w - top) for w, _, _ in own))
                else:
                    ways[i] = own[0][0]
                made[i] = own
            roots.append(node)
            for i, own in enumerate(made):
                first.append(edges + len(to))
                count.append(len(own))
                if len(own) == 1:
                    _, j, k = own[0]
                    cumulative.append(node + i + 1.0)
                    log_p.append(0.0)
                    others.append(0.0)
                    to.append(node + j if j < n else -1)
                    piece.append(k)
                    continue
                p = [exp(w - ways[i]) for w, _, _ in own]
                upto = 0.0
                for x, (w, j, k) in zip(p, own, strict=True):
                    upto += x
                    cumulative.append(node + i + min(upto, 1.0))
                    log_p.append(w - ways[i])
                    others.append(1.0 - x)
                    to.append(node + j if j < n else -1)
                    piece.append(k)
                others[-len(p)] = sum(p[1:])  # of the likeliest without rounding residue
            node += n
        self.edge.add(first)
        self.edges.add(count)
        self.step.add(np.column_stack([cumulative, log_p, others, to]))
        self.edge_piece.add(piece)
        return np.array(roots, np.int64)

    def _grow_all(self, units: list[str]) -> np.ndarray:
        """As `_grow`, all units at once."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        code = _code_points("".join(units))
        size = len(code)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(size)  # characters from each node to its unit's end
        src, length, piece, weight = [], [], [], []
        begin, h = np.arange(size), np.zeros(size, np.uint64)  # where a piece may go on, and the hash of its characters so far
        for n in range(1, min(self.longest, int(sizes.max())) + 1):
            if n > 1:
                inside = left[begin] >= n
                begin, h = begin[inside], h[inside]
            h = _longer(h, code[begin + (n - 1)])
            hit, k = self._found(h, n)
            at = begin[hit]
            go = self._pieces_of(n)[3][h >> K.U64(44)]
            begin, h = begin[go], h[go]
            if n == 1:  # characters that are no pieces: their bytes
                bare = np.ones(size, bool)
                bare[at] = False
                bare = np.flatnonzero(bare)
                if len(bare):
                    src.append(bare)
                    length.append(np.ones(len(bare), np.int64))
                    for column, values in zip((piece, weight), self._bare(code[bare]), strict=True):
                        column.append(values)
            src.append(at)
            length.append(np.full(len(at), n))
            piece.append(k)
            weight.append(self.weight[k])
            if not len(begin):
                break
        src, length, piece, value = (np.concatenate(x) for x in (src, length, piece, weight))
        # sums over all ways to the end, the nodes next to it first
        order = np.argsort(left[src] * (size + 1) + src)
        src, length, piece, value = src[order], length[order], piece[order], value[order]
        ends = length == left[src]
        to = np.where(ends, size, src + length)
        ways = np.zeros(size + 1)
        cuts = np.searchsorted(left[src], np.arange(1, int(sizes.max()) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = src[lo:hi]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            value[lo:hi] += ways[to[lo:hi]]
            top = np.maximum.reduceat(value[lo:hi], begin)
            n = np.diff(np.append(begin, hi - lo))
            ways[own[begin]] = top + np.log(np.add.reduceat(np.exp(value[lo:hi] - np.repeat(top, n)), begin))
        # at each node the likeliest edge first
        log_p = value - ways[src]
        order = np.argsort(2.0 * src - np.exp(log_p))
        src, piece, to, log_p = src[order], piece[order], to[order], log_p[order]
        count = np.bincount(src, minlength=size)
        begin = np.cumsum(count) - count
        p = np.exp(log_p)
        upto = np.cumsum(p)
        upto = np.minimum(upto - np.repeat(upto[begin] - p[begin], count), 1.0)
        rest, top = 1.0 - p, p.copy()
        top[begin] = 0.0
        rest[begin] = np.add.reduceat(top, begin)
        node, edges = self.edge.size, self.step.size
        steps = self.step.room(len(src))
        self.edge.add(edges + begin)
        self.edges.add(count)
        for column, values in enumerate((upto + node + src, log_p, rest, np.where(to < size, node + to, -1))):
            steps[:, column] = values
        self.edge_piece.add(piece)
        return node + np.cumsum(sizes) - sizes

    def _pieces_of(self, n: int):
        """Of the pieces of n characters: sorted hashes, pieces, which leading bits of hashes there are; and the leading bits of the first n characters of longer pieces."""
        if n not in self._by_length:
            own = [(x, i) for x, i in self.ids.items() if len(x) == n]
            longer = {x[:n] for x in self.ids if len(x) > n}

            def hashes(texts):
                code = _code_points("".join(texts)).reshape(-1, n)
                h = np.zeros(len(code), np.uint64)
                for k in range(n):
                    h = _longer(h, code[:, k])
                return h

            def leading(h):
                filled = np.zeros(1 << 20, bool)
                filled[h >> K.U64(44)] = True
                return filled

            h = hashes([x for x, _ in own])
            order = np.argsort(h)
            self._by_length[n] = h[order], np.array([i for _, i in own], np.int64)[order], leading(h), leading(hashes(sorted(longer)))
        return self._by_length[n]

    def _bytes_of(self, character: str) -> int:
        k = self.byte_runs.get(character)
        if k is None:
            k = self.byte_runs[character] = len(self.byte_runs)
            own = [self.bytes[b] for b in _utf8(character)]
            self.byte_first.add([self.byte_pieces.size])
            self.byte_count.add([len(own)])
            self.byte_pieces.add(own)
        return k

    def learn(self) -> None:
        """The segmentations or edges of all units that have a number but none yet."""
        self.forget()
        new = self.index.new
        roots = np.full(len(new), -1)
        letters = np.fromiter(map(len, new), np.int64, len(new))
        long = np.flatnonzero(letters > self.config.unit)
        long = long[np.argsort(letters[long], kind="stable")]
        very = np.searchsorted(letters[long], _VERY_LONG, "right")
        for lo in range(0, very, _TOGETHER):  # words of like lengths, few enough for a processor's cache
            own = long[lo : min(very, lo + _TOGETHER)]
            roots[own] = self._grow_all([new[k] for k in own])
        if very < len(long):
            roots[long[very:]] = self._grow([new[k] for k in long[very:]])
        owner, weights, pieces = [], [], []
        for n in range(1, self.config.unit + 1):
            own = np.flatnonzero(letters == n)
            if len(own):
                of, w, found = self._listed([new[k] for k in own], n)
                owner.append(own[of])
                weights.append(w)
                pieces.append(np.pad(found, ((0, 0), (0, self.config.unit - n)), constant_values=_NONE))
        at = self.first.size
        new.clear()
        self.root.add(roots)
        if not owner:
            self.count.add(np.zeros(len(roots), np.int64))
            self.first.add(np.zeros(len(roots), np.int64))
            return
        owner, w, pieces = np.concatenate(owner), np.concatenate(weights), np.concatenate(pieces)
        sizes = np.bincount(owner, minlength=len(roots))
        self.count.add(sizes)
        # within a unit the likeliest first
        order = np.lexsort((-w, owner))
        owner, w, pieces = owner[order], w[order], pieces[order]
        begin = np.cumsum(sizes) - sizes
        p = np.exp(w - w[begin[owner]])
        listed = np.flatnonzero(sizes)
        total = np.ones(len(sizes))
        total[listed] = np.add.reduceat(p, begin[listed])
        p /= total[owner]
        sums = np.concatenate([[0.0], np.cumsum(p)])
        upto = np.minimum(sums[1:] - sums[begin][owner], 1.0)
        self.first.add(np.where(sizes > 0, self.log_p.size + begin, 0))
        self.log_p.add(w - (w[begin[owner]] + np.log(total)[owner]))
        # of the likeliest by the sum of the others, so that nearly certain ones leave no rounding residue
        rest = 1.0 - p
        top = p.copy()
        top[begin[listed]] = 0.0
        rest[begin[listed]] = np.add.reduceat(top, begin[listed])
        rest[begin[sizes == 1]] = 0.0
        with np.errstate(divide="ignore"):
            self.others.add(np.log(np.maximum(rest, 0.0)))
        self.cumulative.add(upto + at + owner)
        there = pieces != _NONE
        flat, n = self._flat(pieces[there])
        self.end.add(self.pieces.size + np.cumsum(n)[np.cumsum(there.sum(1)) - 1])
        self.pieces.add(flat)
        self.marks = self.log_p.size, self.pieces.size

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the units of all rows in order, units of each row); `learn` must follow before they are used."""
        b, off = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        blank = np.flatnonzero(b == 32)
        some = np.diff(off) > 0
        starts = np.sort(np.concatenate([off[:-1][some], blank + 1]))
        ends = np.sort(np.concatenate([off[1:][some], blank]))
        return self.index.number(b, starts, ends), np.diff(np.searchsorted(blank, off)) + some

    def draw(self, root: np.ndarray, base: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Draws a segmentation from each root; their numbers."""
        first, many, steps = self.edge.used, self.edges.used, self.step.used
        total, missed = np.zeros(len(root)), np.zeros(len(root))
        live, node = np.arange(len(root)), root
        which, taken, step = [], [], 0
        while len(live):
            if step % 2:
                u = spare  # noqa: F821
            else:
                u, spare = _uniform(K.mix(base + K.U64((step + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))), count)
            e, n = first[node], many[node]
            target = node + u
            at = steps.take(e, axis=0)
            far, k = np.flatnonzero((target > at[:, 0]) & (n > 1)), 1
            while len(far):  # few are further down
                e[far] += 1
                at[far] = further = steps.take(e[far], axis=0)
                far, k = far[(target[far] > further[:, 0]) & (k < n[far] - 1)], k + 1
            so_far = total[live]
            missed[live] += np.exp(so_far) * at[:, 2]
            total[live] = so_far + at[:, 1]
            which.append(live)
            taken.append(e)
            node = at[:, 3].astype(np.int64)
            go = node >= 0
            live, node, base, count, spare, step = live[go], node[go], base[go], count[go], spare[go], step + 1
        if not which:
            return np.zeros(0, np.int64)
        of = np.concatenate(which)
        order = np.argsort(of * len(which) + np.repeat(np.arange(len(which)), [len(x) for x in which]))
        return self._keep(np.concatenate(taken)[order], np.bincount(of, minlength=len(root)), total, missed)

    def _keep(self, edges: np.ndarray, sizes: np.ndarray, total: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """Adds drawn segmentations, given by their edges; their numbers."""
        at = self.log_p.size
        self.log_p.add(total)
        with np.errstate(divide="ignore"):
            self.others.add(np.log(missed))
        piece = self.edge_piece.data[edges]
        ends = np.cumsum(sizes)
        self.path_end.add(self.path.size + ends)
        self.path.add(edges)
        if (piece < 0).any():
            piece, n = self._flat(piece)
            ends = np.cumsum(n)[ends - 1]
        self.end.add(self.pieces.size + ends)
        self.pieces.add(piece)
        return np.arange(at, self.log_p.size)

    def draw_without(self, root: int, without: tuple[int, ...], seed: int) -> tuple[list[int], float, float, float]:
        """A segmentation from `root` that is none of the drawn ones `without`: its edges, its log-probability, the
        probability of all others, and the log-probability of all that are then left."""
        first, many, path, end = (x.data for x in (self.edge, self.edges, self.path, self.path_end))
        log_p, others, to = self.step.data.T[1:]
        chance = random.Random(seed).random
        tree: dict = {}

        def exclude(edges):
            at = tree
            for e in edges:
                at = at.setdefault(e, {})

        def left() -> dict[int, tuple[list[int], list[float], float]]:
            """By the part of the tree: edges, their probabilities without what is excluded, and the sum. Only sums, so that nothing cancels."""
            every, k = [(tree, root)], 0
            while k < len(every):
                at, node = every[k]
                every += [(x, int(to[e])) for e, x in at.items() if to[e] >= 0]
                k += 1
            found: dict = {}
            for at, node in reversed(every):
                edges = list(range(int(first[node]), int(first[node] + many[node])))
                p = np.exp(log_p[edges[0] : edges[-1] + 1]).tolist()
                for i, e in enumerate(edges):
                    if e in at:
                        p[i] *= found[id(at[e])][2] if to[e] >= 0 else 0.0
                found[id(at)] = edges, p, sum(p)
            return found

        for k in without:
            k -= self.marks[0]
            exclude(path[end[k - 1] if k else 0 : end[k]].tolist())
        found = left()
        at, node, own = tree, root, []
        total = missed = 0.0
        while node >= 0:
            if at is not None:
                edges, p, mass = found[id(at)]
            else:
                edges = range(int(first[node]), int(first[node] + many[node]))
                p = np.exp(log_p[edges[0] : edges[-1] + 1]).tolist()
                mass = sum(p)
            u = chance() * mass
            pick = None
            for e, x in zip(edges, p, strict=True):
                if x > 0:
                    pick, u = e, u - x
                    if u < 0:
                        break
            own.append(pick)
            missed += math.exp(total) * float(others[pick])
            total += float(log_p[pick])
            at, node = at.get(pick) if at is not None else None, int(to[pick])
        exclude(own)
        mass = left()[id(tree)][2]
        return own, total, missed, math.log(mass) if mass > 0 else -math.inf

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the pieces, the end of each)."""
        n = self.text_size[ids]
        ends = np.cumsum(n)
        return self.text_bytes[np.repeat(self.text_first[ids] - (ends - n), n) + np.arange(n.sum())], ends

    def decode(self, ids) -> str:
        """The text of a segmentation that `sample` made."""
        return b"".join(map(self.texts.__getitem__, ids))[1:].decode()


def _uniform(base: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers inside (0, 1) for each counter, by hashing; of 32 bits each."""
    h = K.mix(base + (count.astype(np.uint64) + K.U64(1)) * K.U64(0x9E3779B97F4A7C15))
    return ((h >> K.U64(32)).astype(np.float64) + 0.5) * 2.0**-32, ((h & K.U64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32


class _Part:
    """Segmentations of a text that agree with `choice` before unit `at` and there have none of `without`."""

    __slots__ = ("at", "choice", "value", "without")

    def __init__(self, value: float, choice: np.ndarray | None, at: int, without: tuple[int, ...]):
        self.value, self.choice, self.at, self.without = value, choice, at, without

    def __lt__(self, other):  # the heap's first is the largest
        return self.value > other.value


def top_k(lattice: Lattice, units: np.ndarray, sizes: np.ndarray, k: int, keys: list[int]):
    """Of each text (its units in a row with all others', and how many): ([(choice of each unit, log-probability, perturbed value)] of at most
    k distinct segmentations, value of the next one or None). Texts are drawn independently, side by side."""
    lattice.forget()
    first, count, cumulative, root = (x.used for x in (lattice.first, lattice.count, lattice.cumulative, lattice.root))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    row = K.row_of(sizes)
    place = np.arange(len(units)) - starts[row]
    begin, ways, root = first[units], count[units], root[units]
    long = root >= 0
    base = K.mix(np.array(keys, np.uint64))
    each = base[row]
    roots = -np.log(-np.log(_uniform(base, np.zeros(len(sizes)))[0]))
    heaps = [[_Part(float(g), None, 0, ())] for g in roots]
    out: list = [[] for _ in keys]
    for turn in range(k):
        parts = [heapq.heappop(h) if h else None for h in heaps]
        live = np.array([x is not None for x in parts])
        if not live.any():
            break
        lo = np.array([x.at if x else 0 for x in parts])
        bound = np.array([x.value if x else 0.0 for x in parts])
        # each part's best segmentation is a draw from its distribution; before its first open unit nothing is drawn
        free = np.flatnonzero(live[row] & (place >= lo[row]))
        counter = 1 + place[free] + turn * (1 << 40)
        u, noise = _uniform(each[free], counter)
        choice = begin.copy()
        target, other, many = units[free] + u, begin[free], ways[free]
        far, step = np.flatnonzero((many > 1) & (target > cumulative[other])), 1
        while len(far):  # few are further down
            other[far] += 1
            far, step = far[(target[far] > cumulative[other[far]]) & (step < many[far] - 1)], step + 1
        choice[free] = other
        drawn = np.flatnonzero(long[free])
        choice[free[drawn]] = lattice.draw(root[free[drawn]], each[free[drawn]], counter[drawn])
        left_mass, again = np.full(len(sizes), -np.inf), []
        for r in np.flatnonzero(live & (sizes > 0)):
            part, at = parts[r], starts[r] + lo[r]
            if part.choice is not None:
                choice[starts[r] : at] = part.choice[: lo[r]]
            if part.without and long[at]:
                *drawn, left_mass[r] = lattice.draw_without(int(root[at]), part.without, int(each[at]) << 64 | int(place[at]) + turn * (1 << 40))
                again.append((at, *drawn))
            elif part.without:
                log_p = lattice.log_p.data
                p = np.exp(log_p[begin[at] : begin[at] + ways[at]])
                p[np.array(part.without) - begin[at]] = 0
                c = np.cumsum(p)
                pick = min(int(np.searchsorted(c, u[np.searchsorted(free, at)] * c[-1], "right")), int(np.flatnonzero(p)[-1]))
                choice[at] = begin[at] + pick
                p[pick] = 0
                total = p.sum()
                left_mass[r] = np.log(total) if total > 0 else -np.inf
            else:
                left_mass[r] = lattice.others.data[choice[at]]
        if again:
            spots, edges, total, missed = zip(*again, strict=True)
            choice[list(spots)] = lattice._keep(np.concatenate(edges), np.array([len(x) for x in edges]), np.array(total), np.array(missed))
        # of texts that have no part left nothing is drawn or used
        choice[long & ~live[row]] = 0
        log_p, others = lattice.log_p.data, lattice.others.data
        own = log_p[choice]
        so_far = np.concatenate([[0.0], np.cumsum(own)])
        # what is left of each part, split at every unit from its first open one on
        rest = others[choice[free]]
        some = live & (sizes > 0)
        rest[np.searchsorted(free, (starts + lo)[some])] = left_mass[some]
        mass = so_far[free] - so_far[starts[row[free]]] + rest
        value = np.full(len(units), -np.inf)
        with np.errstate(divide="ignore"):
            value[free] = np.where(np.isfinite(mass), mass - np.log(np.exp(mass - bound[row[free]]) - np.log(noise)), -np.inf)
        for r in np.flatnonzero(live):
            x = slice(starts[r], ends[r])
            mine = choice[x].copy()
            out[r].append((mine, float(so_far[ends[r]] - so_far[starts[r]]), float(bound[r])))
            v, most = value[x], k - turn  # so many parts can still come up, the value after the last sample among them
            if most == 1:
                best = [v.argmax()] if len(v) else []
            else:
                best = np.argpartition(v, len(v) - most)[-most:] if len(v) > most else range(len(v))
            for j in best:
                if v[j] > -np.inf:
                    without = (*parts[r].without, int(mine[j])) if j == lo[r] else (int(mine[j]),)
                    heapq.heappush(heaps[r], _Part(float(v[j]), mine, int(j), without))
    return [(o, h[0].value if h else None) for o, h in zip(out, heaps, strict=True)]


def ids_of(lattice: Lattice, choices: list[np.ndarray]) -> list[np.ndarray]:
    """Piece ids of segmentations."""
    every = np.concatenate([np.zeros(0, np.int64), *choices])
    end = lattice.end.data
    lo = np.where(every > 0, end[every - 1], 0)
    n = end[every] - lo
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = lattice.pieces.data[np.repeat(lo - ends[:-1], n) + np.arange(ends[-1])]
    cut = ends[np.cumsum([0, *map(len, choices)])]
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def samples(lattice: Lattice, raw: np.ndarray, offsets: np.ndarray, keys: list[int]):
    """Of each row [(ids, log-probability, perturbed value, inclusion score)]."""
    if len(lattice.index) > lattice.config.cache or lattice.step.size > 32 * lattice.config.cache:
        lattice.clear()
    units, sizes = lattice.units(raw, offsets)
    lattice.learn()
    found = top_k(lattice, units, sizes, lattice.config.k, keys)
    ids = iter(ids_of(lattice, [c for own, _ in found for c, _, _ in own]))
    return [[(next(ids), p, g, 1.0 if after is None else float(-np.expm1(-np.exp(p - after)))) for _, p, g in own] for own, after in found]


def round_trips(lattice: Lattice, coded: list[np.ndarray], texts: list[np.ndarray]) -> list[bool]:
    """Whether each segmentation spells its text (bytes) after a blank; so many at once as make a slice."""
    out, i = [], 0
    while i < len(coded):
        j, n = i + 1, len(texts[i])
        while j < len(coded) and n + len(texts[j]) <= _SLICE:
            n += len(texts[j])
            j += 1
        spelled, ends = lattice.spell(np.concatenate(coded[i:j]))
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, coded[i:j])])]
        for a, b, text in zip(ends[:-1], ends[1:], texts[i:j], strict=True):
            own = spelled[a:b]
            out.append(bool(len(own) == len(text) + (len(text) > 0) and (not len(own) or own[0] == 32) and np.array_equal(own[1:], text)))
        i = j
    return out


_LATTICES: dict[Config, Lattice] = {}  # one for each Python worker


def _lattice(config: Config) -> Lattice:
    if config not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[config] = Lattice(config)
    return _LATTICES[config]


def sample(docs: DataFrame, config: Config = Config(), with_ids: bool = False) -> DataFrame:
    """SCHEMA rows of every text's samples, best perturbed value first; `with_ids` adds the piece ids."""
    seed = int(K.mix(np.array([config.seed], np.uint64))[0])

    def run(batches):
        lattice = _lattice(config)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw, offsets, _ = K.buffers(batch.column("text"))
            for i, j in K.slices(offsets, _SLICE):
                keys = [((x or 0) & (2**64 - 1)) ^ seed for x in ids[i:j]]
                found = [(r, s, own) for r, row in enumerate(samples(lattice, raw, offsets[i : j + 1], keys), i) for s, own in enumerate(row)]
                coded = [own[0] for _, _, own in found]
                trips = round_trips(lattice, coded, [raw[offsets[r] : offsets[r + 1]] for r, _, _ in found])
                rows = [(ids[r], s, len(codes), zlib.crc32(codes.astype("<u4").tobytes()), p, g, share, same) for (r, s, (codes, p, g, share)), same in zip(found, trips, strict=True)]
                coded = [x.astype(np.int32) for x in coded] if with_ids else []
                yield _made(rows, coded, names, kinds, with_ids)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(K.tidy(run), SCHEMA + ", ids array<int>" * with_ids)


def _made(rows, coded, names, kinds, with_ids):
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    if with_ids:
        return pa.RecordBatch.from_arrays([*columns, pa.array(coded, pa.list_(pa.int32()))], [*names, "ids"])
    return pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id and `ids`, the model's own segmentation of every text."""

    def run(batches):
        model = _lattice(config).model
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.encode(texts, num_threads=1), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(K.tidy(run), "doc_id long, ids array<int>")


def decode(coded: DataFrame, config: Config = Config(), sampled: bool = False) -> DataFrame:
    """doc_id and `text` of (doc_id, ids): of the model's own segmentations or of sampled ones."""

    def run(batches):
        lattice = _lattice(config)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [lattice.decode(x) if sampled else lattice.model.decode(x) for x in (y or [] for y in lists)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(K.tidy(run), "doc_id long, text string")
