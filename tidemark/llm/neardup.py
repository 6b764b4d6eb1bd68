"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find by joins.

1. Each text becomes the set of its distinct word shingles (64-bit hashes). Texts with equal
   sets form one class, so exact copies cost one row however many there are.
2. A class gets a SuperMinHash signature. Element x gives register i the value
   rank + fraction, where an element's ranks are a keyed permutation of all registers; levels
   of ranks are worked off together and a set stops once no register can fall further.
3. `bands` bands of `rows` registers put classes into buckets. With the defaults a pair at the
   threshold shares none with probability (1 - 0.8**7)**48 = 9e-6, and less above it.
4. In a bucket each class is paired with the smallest id and with its neighbour in the order of
   sizes (inside parts of about `part` classes, so that no task holds a hot bucket); pairs are confirmed on full shingle sets, and components are labelled by
   alternating minimum joins with checkpoints.
5. Buckets that then still hold several components get the rest: every class outside the
   bucket's largest component against every class of another component. A bound that no similar
   pair exceeds (the parity bits of two sets differ in at most as many places as the sets in
   elements) drops pairs before they are formed; the others are confirmed on full sets. So no
   link between components is lost, and no pair inside a component is spelled out.
6. A bucket where that would be more than `part` ** 2 pairs is joined by rare shingles instead: in
   any order of all shingles, here by their frequency, similar sets share one of their first
   n - ceil(0.8 n) + 1, so only sets that share one of those become pairs. That is exact too.

Defined cases: null, empty and white-space texts have an empty set, n_shingles 0, and are linked
with nothing; a text with fewer words than a shingle is one shingle; of rows that repeat a doc_id
the one with the largest set counts (of equal sizes the one whose set's digest sorts first), and the
others get its component; rows with null doc_id are returned with component_id null and kept true;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import kernels as K
from tidemark.llm.common import checkpoint


#: 64-bit words of the parity bits of a set.
ODD = 16


@dataclass(frozen=True)
class Config:
    width: int = 5  # words in a shingle
    percent: int = 80  # least similarity, as 100 * intersection >= percent * union
    bands: int = 48
    rows: int = 7
    part: int = 4096  # classes of a hot bucket that one task puts in order, and the root of the pairs that a bucket may be joined to

    @property
    def registers(self) -> int:
        n = 1
        while n < self.bands * self.rows:
            n *= 2
        return n


def shingle_sets(raw, offsets, width: int):
    """(sorted distinct shingle hashes of all rows, count of each row), a bounded slice of rows at a time."""
    for i, j in K.slices(offsets):
        h, n = K.words(raw, offsets[i : j + 1])
        s, per = K.shingles(h, n, width)
        rows = K.row_of(per)
        order = np.lexsort((s, rows))
        s, rows = s[order], rows[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (rows[1:] != rows[:-1])
        yield i, j, s[new], np.bincount(rows[new], minlength=j - i)


def superminhash(s: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m, uint32) of consecutive sets. m: a power of two.

    A register holds rank * 2**22 + fraction. At level j every live element offers rank j to
    one register, p(j) under its own permutation of the registers; a set is done after the
    level at which all its registers hold a rank that is not above it."""
    n = len(counts)
    low = np.uint32(m - 1)
    sig = np.full(n * m, 0xFFFFFFFF, np.uint32)
    rows = K.row_of(counts)
    live = np.flatnonzero(counts > 0)
    shift = np.uint32(max(1, (m.bit_length() - 1) // 2))
    seed = K.mix(s ^ K.U64(0x2545F4914F6CDD1D))
    a, b, c = (seed & K.U64(0xFFFFFFFF)).astype(np.uint32), (seed >> K.U64(32)).astype(np.uint32), K.mix(seed)
    odd, odd2, add = (a | np.uint32(1)), ((b >> np.uint32(7)) | np.uint32(1)), (c & K.U64(0xFFFFFFFF)).astype(np.uint32)
    base = rows.astype(np.int64) * m
    for j in range(m):
        x = (np.uint32(j) * odd + add) & low
        x ^= x >> shift
        x = (x * odd2 + b) & low
        x ^= x >> shift
        fraction = (K.mix(c + K.U64(j)) >> K.U64(42)).astype(np.uint32)
        np.minimum.at(sig, base + x, (np.uint32(min(j, 1022)) << np.uint32(22)) | fraction)
        done = sig.reshape(n, m)[live].max(1) >> np.uint32(22) <= j
        if done.any():
            live = live[~done]
            if not len(live):
                break
            on = np.zeros(n, bool)
            on[live] = True
            keep = on[rows]
            rows, base, odd, odd2, add, b, c = (v[keep] for v in (rows, base, odd, odd2, add, b, c))
    return sig.reshape(n, m)


def _digest(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def sketch(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, n_shingles, digest of the set and the band hashes of every row; the last two are null for an empty set."""

    def run(batches):
        up, _ = K.powers(config.rows + 1)
        for batch in batches:
            raw, offsets, _ = K.buffers(batch.column("text"))
            sizes = np.zeros(batch.num_rows, np.int64)
            digests: list = [None] * batch.num_rows
            bands: list = [None] * batch.num_rows
            for i, j, s, n in shingle_sets(raw, offsets, config.width):
                sizes[i:j] = n
                ends = np.cumsum(n)
                for lo in range(0, j - i, 256):  # a bounded number of registers at once
                    hi = min(j - i, lo + 256)
                    sig = superminhash(s[ends[lo] - n[lo] : ends[hi - 1]], n[lo:hi], config.registers)
                    sig = sig[:, : config.bands * config.rows].astype(np.uint64)
                    h = (K.mix(sig).reshape(hi - lo, config.bands, config.rows) * up[: config.rows]).sum(2, dtype=np.uint64)
                    h = K.mix(h + np.arange(1, config.bands + 1, dtype=np.uint64)).view(np.int64)
                    for r in range(lo, hi):
                        if n[r]:
                            digests[i + r] = _digest(s[ends[r] - n[r] : ends[r]].tobytes())
                            bands[i + r] = h[r - lo]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.tidy(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def odd_bits(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * ODD cells: whether it holds an odd number of the set's elements.

    Two sets differ in at least as many elements as their bits differ in places."""
    cells = 64 * ODD
    at = K.row_of(counts) * cells + (K.mix(s) >> K.U64(64 - cells.bit_length() + 1)).astype(np.int64)
    bits = np.bincount(at, minlength=len(counts) * cells).astype(np.uint8) & 1
    return np.packbits(bits.reshape(len(counts), cells), axis=1, bitorder="little").view("<i8")


def set_bytes(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id and the sorted shingle set, as little-endian 64-bit numbers, of the rows (doc_id, digest, text) whose set has that digest."""

    def run(batches):
        for batch in batches:
            raw, offsets, _ = K.buffers(batch.column("text"))
            wanted = batch.column("digest").to_pylist()
            sets: list = []
            odd: list = []
            for i, j, s, n in shingle_sets(raw, offsets, config.width):
                ends = np.cumsum(n)
                sets += [s[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                for lo in range(0, j - i, 4096):
                    hi = min(j - i, lo + 4096)
                    odd += list(odd_bits(s[ends[lo] - n[lo] : ends[hi - 1]], n[lo:hi]))
            own = pa.array([_digest(x) == w for x, w in zip(sets, wanted, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary()), pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "members", "odd"]).filter(own)

    return docs.select("doc_id", "digest", "text").mapInArrow(K.tidy(run), "doc_id long, members binary, odd array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, config: Config) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r, (a, b) in enumerate(zip(batch.column("set_u"), batch.column("set_v"), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[r] = 100 * common >= config.percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))

    # the hub of a large group is u: that join comes last, with plain exchanges on both sides, so that skewed partitions are split
    one = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("members").alias("set_v")).hint("merge"), "v")
    two = one.join(sets.select(F.col("doc_id").alias("u"), F.col("members").alias("set_u")).hint("merge"), "u")
    return two.select("u", "v", "set_u", "set_v").mapInArrow(K.tidy(run), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (u, v): component is the least node reachable.

    Each turn takes the least label of the neighbours and then the label of that label, so
    turns grow with the logarithm of the longest chain. Only a sum goes to the driver."""
    both = checkpoint(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")))
    total = None
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("component")).hint("merge"), "v").select(F.col("u").alias("node"), "component")
        labels = checkpoint(near.union(labels).groupBy("node").agg(F.min("component").alias("component")))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = checkpoint(labels.hint("merge").join(up.hint("merge"), "component").select("node", F.col("root").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def sharing_rare(nodes: DataFrame, sets: DataFrame, config: Config) -> DataFrame:
    """(u, v) of `nodes` (node, n, component) of unlike components that share one of the rarest shingles, which every similar pair does."""

    def run(batches):
        for batch in batches:
            for node, n, part, cell in zip(*(batch.column(k) for k in ("node", "n", "component", "members")), strict=True):
                members = np.frombuffer(cell.as_buffer(), "<i8")
                for i in range(0, len(members), 200_000):
                    own = members[i : i + 200_000]
                    columns = [pa.array(np.full(len(own), x.as_py())) for x in (node, n, part)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(own)], ["node", "n", "component", "shingle"])

    held = nodes.hint("merge").join(sets.select(F.col("doc_id").alias("node"), "members").hint("merge"), "node").dropDuplicates(["node"])
    every = checkpoint(held.select("node", "n", "component", "members").mapInArrow(K.tidy(run), "node long, n long, component long, shingle long"))
    often = every.groupBy("shingle").agg(F.count("*").alias("often"))
    by_rarity = Window.partitionBy("node").orderBy("often", "shingle")  # one set
    first = F.col("n") - F.ceil(F.col("n") * config.percent / 100) + 1
    rare = every.hint("merge").join(often.hint("merge"), "shingle").withColumn("_rank", F.row_number().over(by_rarity)).where((F.col("_rank") <= first) & (F.col("often") > 1))
    rare = checkpoint(rare.select("shingle", "node", "n", "component"))
    other = rare.select("shingle", F.col("node").alias("v"), F.col("n").alias("m"), F.col("component").alias("apart"))
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * config.percent
    both = rare.hint("merge").join(other.hint("merge"), "shingle").where((F.col("node") < F.col("v")) & (F.col("component") != F.col("apart")) & alike)
    return both.select(F.col("node").alias("u"), "v").distinct()


def groups(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`."""
    marks = checkpoint(sketch(docs, config))
    full = marks.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # the set that counts for each id; maps send one row of an id
    order = Window.partitionBy("doc_id").orderBy(F.desc("n_shingles"), "digest")
    ids = checkpoint(full.select("doc_id", "n_shingles", "digest").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank"))
    classes = checkpoint(ids.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")))

    # buckets of at least two classes, each class with the bucket's least id and the one before it
    own = full.where(F.col("bands").isNotNull()).select("digest", "doc_id", "bands")
    own = own.join(classes.withColumnRenamed("node", "doc_id").hint("merge"), ["doc_id", "digest"])
    reps = checkpoint(own.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "n", "bands"))
    rows = reps.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("held")).where("held > 1")
    shared = rows.hint("merge").join(buckets.hint("merge"), "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / config.part)))
    beside = Window.partitionBy("bucket", "part").orderBy("n", "node")
    shared = checkpoint(shared.repartition("bucket", "part").select("node", "n", "bucket", "hub", F.lag("node").over(beside).alias("before")))

    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * config.percent
    wanted = shared.select("node").distinct().hint("merge").join(classes.select("node", "digest").hint("merge"), "node").select(F.col("node").alias("doc_id"), "digest")
    sets = checkpoint(set_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").hint("merge").join(wanted.hint("merge"), "doc_id"), config))

    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    near = shared.groupBy("node").agg(F.min("hub").alias("hub"), F.min("before").alias("before"))
    first = near.select("node", F.explode(F.array("hub", "before")).alias("other")).where(F.col("other").isNotNull() & (F.col("other") != F.col("node")))
    first = checkpoint(first.select(*ordered("node", "other")).distinct())
    edges = checkpoint(confirm(first, sets, config))
    labels = components(edges)

    # what the first pairs left apart inside a bucket
    placed = shared.select("node", "n", "bucket").hint("merge").join(labels.hint("merge"), "node", "left").select("node", "n", "bucket", F.coalesce("component", "node").alias("component"))
    placed = checkpoint(placed)
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("held")).where("parts > 1")
    hot = F.col("held").cast("double") * (F.col("held") - F.col("top.size")) > config.part**2
    most = most.select("bucket", F.col("top.component").alias("main"), hot.alias("hot"))
    split = placed.hint("merge").join(checkpoint(most).hint("merge"), "bucket")
    # similar sets of n and m elements differ in at most (n + m) * (100 - percent) / (100 + percent) elements, hence in no more parity bits
    bits = sets.select(F.col("doc_id").alias("node"), *[F.col("odd")[k].alias(f"x{k}") for k in range(ODD)])
    split = checkpoint(split.hint("merge").join(bits.hint("merge"), "node"))
    crowded = split.where("hot").select("node", "n", "component").distinct()
    split = split.where("not hot")
    minor = split.where(F.col("component") != F.col("main")).select("bucket", F.col("node").alias("a"), F.col("n").alias("m"), F.col("component").alias("apart"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(ODD)])
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(ODD)])
    close = differ * (100 + config.percent) <= (F.col("n") + F.col("m")) * (100 - config.percent)
    rest = split.hint("merge").join(minor.hint("merge"), "bucket").where((F.col("component") != F.col("apart")) & alike & close)
    rest = rest.select(*ordered("node", "a"))
    if crowded.take(1):
        rest = rest.union(sharing_rare(crowded, sets, config))
    rest = rest.distinct().join(first, ["u", "v"], "left_anti")
    more = checkpoint(confirm(checkpoint(rest), sets, config))
    named = classes.hint("merge").join(labels.hint("merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    if more.take(1):  # these links join whole components: a small graph of its own
        for end in ("u", "v"):
            at = labels.select(F.col("node").alias(end), "component")
            more = more.join(at, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        upper = components(more.select("u", "v").where("u <> v"))
        named = named.join(upper.withColumnRenamed("node", "component_id"), "component_id", "left").select("digest", F.coalesce("component", "component_id").alias("component_id"))
    placed = ids.select("doc_id", "digest").hint("merge").join(checkpoint(named).hint("merge"), "digest").select("doc_id", "component_id")
    linked = full.select("doc_id", "n_shingles").hint("merge").join(placed.hint("merge"), "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = marks.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
