"""Approximate nearest neighbours by cosine, with additive quantisation.

Vectors are scaled to length one and coded as sums of one codeword from each of `books`
full-dimensional codebooks. Codebooks start from k-means on residuals over a bounded sample
(`Config.sample`) and are refitted jointly by least squares; encoding is a beam search over the
books. The length of each decoded vector is stored, so a lookup-table sum of the query's products
with the codewords, divided by it, estimates the cosine. Every vector is coded, none left out.

Queries come in blocks and so do codes; each pair of blocks keeps the best `rerank` of every query,
the best of all blocks are then scored exactly, in double precision, on the original vectors. The
stated queries meet all codes: codes (a byte for each book) are moved once for each `query_block`
queries and the work is their product. Coarse lists would not lessen it where neighbours are far
apart: on the embeddings of the 0.1 GB tables 32 of 128 k-means lists hold 0.77 of the true five nearest.
Equal vectors are one entry, with their `top` + 1 smallest ids, which is exact however many they are.

Defined cases: vectors that are null, all zero, of another length than most, or hold null or
non-finite components take no part; a row given twice counts once; with fewer candidates than
`top` all are returned; ties go to the smaller id; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint


@dataclass(frozen=True)
class Config:
    books: int = 24
    words: int = 256  # codewords of a book
    beam: int = 4
    sample: int = 8192
    rounds: int = 2  # joint refits
    rerank: int = 192
    top: int = 5
    code_block: int = 32768  # most codes of a block
    query_block: int = 16384  # most queries of a block: so many share one reading of all codes
    spread: int = 32  # tasks for each block of queries
    tasks: int = 8  # blocks of queries at least, if each has `few` queries
    few: int = 128


@dataclass(frozen=True)
class Books:
    words: np.ndarray  # books x words x dimensions, float32

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # first to a common size: squares of extreme values would overflow
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray, books: Books, beam: int) -> np.ndarray:
    """Codes of the rows of x, by beam search."""
    out = np.empty((len(x), len(books.words)), np.int64)
    norms = (books.words**2).sum(2)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024].astype(np.float32)
        n = len(part)
        rest = part[:, None, :]
        error = (part**2).sum(1)[:, None]
        path = np.zeros((n, 1, 0), np.int64)
        for m, words in enumerate(books.words):
            width = rest.shape[1]
            cost = error[:, :, None] + norms[m] - 2 * (rest.reshape(-1, rest.shape[2]) @ words.T).reshape(n, width, -1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            of, word = best // len(words), best % len(words)
            row = np.arange(n)[:, None]
            path = np.concatenate([path[row, of], word[:, :, None]], axis=2)
            rest = rest[row, of] - words[word]
            error = np.take_along_axis(flat, best, 1)
        out[lo : lo + n] = path[:, 0]
    return out


def refit(x: np.ndarray, codes: np.ndarray, books: Books, ridge: float = 0.1, steps: int = 12) -> Books:
    """All codewords at once, by least squares towards x; conjugate gradients on the normal equations."""
    order = [np.argsort(codes[:, m], kind="stable") for m in range(codes.shape[1])]
    bounds = [np.searchsorted(codes[o, m], np.arange(books.words.shape[1] + 1)) for m, o in enumerate(order)]

    def gather(v: np.ndarray) -> np.ndarray:
        out = np.zeros(books.words.shape)
        for m, (o, b) in enumerate(zip(order, bounds, strict=True)):
            some = np.flatnonzero(b[1:] > b[:-1])
            out[m, some] = np.add.reduceat(v[o], b[some])
        return out

    w = books.words.astype(np.float64)
    r = gather(x - Books(w).decode(codes))
    p, size = r.copy(), (r * r).sum()
    for _ in range(steps):
        if size < 1e-12:
            break
        q = gather(Books(p).decode(codes)) + ridge * p
        a = size / (p * q).sum()
        w, r = w + a * p, r - a * q
        size, old = (r * r).sum(), size
        p = r + size / old * p
    return Books(w.astype(np.float32))


def train(x: np.ndarray, config: Config) -> Books:
    """Fit on unit vectors."""
    random = np.random.default_rng(3)
    x = x.astype(np.float32)
    k = max(1, min(config.words, len(x)))
    words, rest = [], x.copy()
    for _ in range(config.books):
        centre = rest[random.permutation(len(rest))[:k]].copy()
        for _ in range(8):
            at = ((centre**2).sum(1) - 2 * rest @ centre.T).argmin(1)
            total = np.zeros_like(centre)
            np.add.at(total, at, rest)
            n = np.bincount(at, minlength=k)
            centre[n > 0] = total[n > 0] / n[n > 0, None]
        at = ((centre**2).sum(1) - 2 * rest @ centre.T).argmin(1)
        rest -= centre[at]
        words.append(centre)
    books = Books(np.array(words))
    for _ in range(config.rounds):
        books = refit(x, encode(x, books, config.beam), books)
    return books


def leading(entries: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the `most` entries of the largest value, ties to the smaller entry, in that order."""
    if near.shape[1] > most:  # all that reach the last place's value, then in order
        least = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
        width = int((near >= least[:, None]).sum(1).max())
        at = np.argpartition(-near, min(width, near.shape[1]) - 1, axis=1)[:, :width]
        entries, near = np.take_along_axis(entries, at, 1), np.take_along_axis(near, at, 1)
    order = np.lexsort((entries, -near), axis=1)[:, :most]
    return np.take_along_axis(entries, order, 1), np.take_along_axis(near, order, 1)


def _matrix(column, dimensions: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding as doubles) of the rows that take part, and their dimensions."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = most[0]["d"] if most else 1
    return rows.where(F.size("embedding") == d), d


def search(vectors: DataFrame, is_query, config: Config = Config(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest other vectors of every row for which `is_query` holds."""
    rows, d = valid(vectors, vec_id, embedding)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("_rank", F.dense_rank().over(same)).where(F.col("_rank") <= config.top + 1)
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))  # at most top + 1 ids
    entries = checkpoint(entries.select(F.col("ids")[0].alias("entry"), "ids", "embedding"))
    queries = checkpoint(rows.where(is_query).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))
    n, nq = entries.count(), queries.count()
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    if not n or not nq:
        return spark.createDataFrame([], out)

    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(config.sample).select("embedding").toArrow()
    shared = spark.sparkContext.broadcast(train(unit(_matrix(sample.column("embedding"), d)), config))

    def code(batches):
        for batch in batches:
            x = unit(_matrix(batch.column("embedding"), d))
            codes = encode(x, shared.value, config.beam)
            length = np.sqrt((shared.value.decode(codes).astype(np.float64) ** 2).sum(1))
            packed = [c.tobytes() for c in codes.astype(np.uint8 if config.words <= 256 else np.uint16)]
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(packed, pa.binary()), pa.array(length)], ["entry", "code", "length"])

    def code_block(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("entry").to_numpy())
        table = table.take(pa.array(order))
        made = [table.column("entry").to_numpy().astype("<i8").tobytes(), b"".join(table.column("code").to_pylist()), table.column("length").to_numpy().astype("<f8").tobytes()]
        return pa.table([table.column("block").slice(0, 1), *[pa.array([x], pa.binary()) for x in made]], names=["block", "entries", "codes", "lengths"])

    def query_block(table: pa.Table) -> pa.Table:
        x = unit(_matrix(table.column("query"), d)).astype("<f4")
        return pa.table([table.column("part").slice(0, 1), pa.array([table.column("query_id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["part", "queries", "vectors"])

    def best(batches):
        # the best so far of each block of queries, over all blocks of codes that this task meets
        words, kept = shared.value.words, {}
        for batch in batches:
            for r in batch.to_pylist():
                entries = np.frombuffer(r["entries"], "<i8")
                codes = np.frombuffer(r["codes"], np.uint8 if config.words <= 256 else np.uint16).reshape(len(entries), -1).astype(np.int64)
                length = np.maximum(np.frombuffer(r["lengths"], "<f8"), 1e-12)
                x = np.frombuffer(r["vectors"], "<f4").reshape(-1, d)
                found, near = [], []
                for lo in range(0, len(x), 32):
                    table = np.einsum("qd,mkd->mqk", x[lo : lo + 32], words, optimize=True)
                    score = np.zeros((len(x[lo : lo + 32]), len(entries)))
                    for m in range(len(words)):
                        score += table[m][:, codes[:, m]]
                    score /= length
                    f, n = leading(np.broadcast_to(entries, score.shape), score, config.rerank)
                    found.append(f)
                    near.append(n)
                found, near = np.concatenate(found), np.concatenate(near)
                if r["part"] in kept:
                    ids, old, old_near = kept[r["part"]]
                    found, near = leading(np.concatenate([old, found], 1), np.concatenate([old_near, near], 1), config.rerank)
                kept[r["part"]] = np.frombuffer(r["queries"], "<i8"), found, near
        for ids, found, near in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.shape[1])), pa.array(found.ravel()), pa.array(near.ravel())], ["query_id", "entry", "near"])

    blocks = -(-n // config.code_block)
    parts = max(-(-nq // config.query_block), min(config.tasks, -(-nq // config.few)))
    coded = entries.select("entry", "embedding").mapInArrow(code, "entry long, code binary, length double")
    coded = coded.withColumn("block", F.pmod(F.xxhash64("entry"), F.lit(blocks))).groupBy("block").applyInArrow(code_block, "block long, entries binary, codes binary, lengths binary")
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).groupBy("part").applyInArrow(query_block, "part long, queries binary, vectors binary")
    # every block of codes meets every block of queries, over `spread` tasks for each of the latter
    left = coded.withColumn("spread", F.pmod("block", F.lit(config.spread))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = asked.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(blocks, config.spread) - 1).cast("long"))))
    near = left.join(right, ["part", "spread"]).select("part", "entries", "codes", "lengths", "queries", "vectors").mapInArrow(best, "query_id long, entry long, near double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("near"), "entry")
    near = near.withColumn("_rank", F.row_number().over(by_query)).where(F.col("_rank") <= config.rerank).select("query_id", "entry")

    def exact(batches):
        for batch in batches:
            x, y = _matrix(batch.column("query"), d), _matrix(batch.column("embedding"), d)
            score = (unit(x) * unit(y)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array(score)], ["query_id", "ids", "score"])

    full = near.join(entries, "entry").join(queries, "query_id").select("query_id", "query", "embedding", "ids").mapInArrow(exact, "query_id long, ids array<long>, score double")
    each = full.select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= config.top).select("query_id", "rank", "vec_id", "score")
