"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points: letters and the marks that combine with them, in Unicode lower case;
all others count as a blank, and blanks in a row as one. Training counts the n-grams of a bounded
number of rows of each language (`Config.per_class`, chosen by a hash of the id, or of the text
where there is no id) on the executors, which also work out each language's log-probabilities. The
matrix (2**bits floats for each language) is broadcast and has at most `Config.cells` floats: all
languages are learned, and the more there are, the fewer buckets each has. Texts are scored in
numpy by sparse gathers, a bounded slice at a time, however long a text is.

Defined cases: a null or empty text, or one without any letter, is `und` with score 0;
if no language could be learned every row is `und`; ties go to the language that sorts
first; repeated rows are scored each by itself; further input columns are ignored; n-grams that
span one of the cuts that texts of over a megabyte are read with do not count.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels as K

UNDETERMINED = "und"


@dataclass(frozen=True)
class Config:
    bits: int = 15  # of the buckets; fewer where languages times buckets would exceed `cells`
    orders: tuple[int, ...] = (1, 2, 3)
    per_class: int = 3000  # most rows of a language that training reads
    cells: int = 1 << 22  # most floats of the matrix, for up to half as many languages
    alpha: float = 0.5  # added to every count


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    logp: np.ndarray  # language x bucket
    prior: np.ndarray
    config: Config


@lru_cache(1)
def folding() -> np.ndarray:
    """What each code point counts as: lower case of letters, combining marks as they are, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] in "LM":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _characters(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, blanks in a row once; the row of each)."""
    codes = np.frombuffer(b.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = (b & 0xC0) != 0x80
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum(first)])[offsets]
    c, rows = folding()[codes], K.row_of(np.diff(points))
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (rows[1:] != rows[:-1])
    return c[keep], rows[keep]


def _buckets(b: np.ndarray, offsets: np.ndarray, config: Config):
    """(buckets, rows) for each order; no n-gram spans rows."""
    c, rows = _characters(b, offsets)
    g = np.zeros(len(c), np.uint32)
    for k in range(max(config.orders)):
        g = (g[: len(c) - k] if k else g) * np.uint32(0x01000193) + c[k:] + np.uint32(1) if len(c) > k else np.zeros(0, np.uint32)
        if k + 1 in config.orders:
            h = g ^ (g >> np.uint32(15))
            h = h * np.uint32(0x85EBCA6B + 2 * k)
            same = rows[: len(g)] == rows[k:] if k else slice(None)
            yield (h[same] >> np.uint32(32 - config.bits)).astype(np.int32), rows[: len(g)][same]


def count(docs: DataFrame, config: Config) -> DataFrame:
    """(lang, bucket, n) of the given rows."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets, _ = K.buffers(batch.column("text"))
            names, codes = np.unique(np.array(batch.column("lang").to_pylist(), str), return_inverse=True)
            for i, j, b, off in K.segments(raw, offsets):
                for bucket, rows in _buckets(b, off, config):
                    at, n = np.unique((codes[i:j][rows].astype(np.int64) << config.bits) | bucket, return_counts=True)
                    own = at >> config.bits
                    for k in np.unique(own):
                        lang = str(names[k])
                        if lang not in sums:
                            sums[lang] = np.zeros(1 << config.bits, np.int64)
                        mine = slice(*np.searchsorted(own, (k, k + 1)))
                        sums[lang][at[mine] & ((1 << config.bits) - 1)] += n[mine]
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(K.tidy(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, usable: Column, config: Config = Config()) -> Model:
    """Fit on rows with a language for which `usable` holds, about `config.per_class` of each."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    # a row for each language, here and in what is broadcast: no more than the model itself has
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    total = {r["lang"]: r["n"] for r in sizes.collect()}
    config = replace(config, bits=max(1, min(config.bits, (config.cells // max(1, len(total))).bit_length() - 1)))
    if not total:
        return Model((), np.zeros((0, 1 << config.bits), np.float32), np.zeros(0), config)
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, int(min(1.0, config.per_class / n) * (1 << 30))) for k, n in sorted(total.items())], "lang string, _share long")
    ticket = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(11))).otherwise(F.xxhash64("doc_id", F.lit(11))), F.lit(1 << 30))
    drawn = known.join(F.broadcast(share), "lang").where(ticket < F.col("_share"))

    def logs(table: pa.Table) -> pa.Table:  # one language, 2**bits rows at most
        n = np.full(1 << config.bits, config.alpha)
        n[table.column("bucket").to_numpy()] += table.column("n").to_numpy()
        return pa.table([table.column("lang").slice(0, 1), pa.array([np.log(n / n.sum()).astype("<f4").tobytes()], pa.binary())], names=["lang", "logp"])

    got = sorted((r["lang"], bytes(r["logp"])) for r in count(drawn, config).groupBy("lang").applyInArrow(logs, "lang string, logp binary").collect())
    labels = tuple(k for k, _ in got)
    logp = np.array([np.frombuffer(x, "<f4") for _, x in got]).reshape(len(got), 1 << config.bits)
    prior = np.log(np.array([total[x] for x in labels], float) / max(1, sum(total[x] for x in labels)))
    return Model(labels, logp, prior, config)


def log_likelihood(raw, offsets, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each row under each language, n-grams of each row)."""
    out = np.zeros((len(model.labels), len(offsets) - 1))
    n = np.zeros(len(offsets) - 1)
    for i, j, b, off in K.segments(raw, offsets):
        for bucket, rows in _buckets(b, off, model.config):
            per = np.bincount(rows, minlength=j - i)
            n[i:j] += per
            for k in range(len(model.labels)):
                out[k, i:j] += K.row_sums(model.logp[k][bucket], per)
    return out, n


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`keep` columns, `lang_pred` and `score`, its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        names = np.array([*m.labels, UNDETERMINED], object)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            raw, offsets, _ = K.buffers(text)
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, p = np.full(batch.num_rows, len(m.labels)), np.zeros(batch.num_rows)
            if m.labels:
                ll, _ = log_likelihood(raw, offsets, m)
                ll += m.prior[:, None]
                at = ll.argmax(0)
                q = 1 / np.exp(ll - ll.max(0)).sum(0)
                best[lettered], p[lettered] = at[lettered], q[lettered]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(p)], [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string, score double"])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(K.tidy(run), schema)
