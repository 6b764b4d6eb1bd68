"""Bloom filters on Spark's own sketch. The handle is only reachable through the session's JVM, so all of that stays here."""

from __future__ import annotations

import io
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key, by double hashing."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in (0, 1))
    return F.array_distinct(F.array(*[F.pmod(a + b * k, F.lit(bits)) for k in range(hashes)]))


def sizes(expected: int, error: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) of a filter."""
    n = max(1, expected)
    bits = math.ceil(-n * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))


def filled(rows: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """(word, bits): a filter as a table of its 64-bit words that are not zero, so nothing of it meets in one place."""
    bit = rows.select(F.explode(_places(F.col(column), bits, hashes)).alias("bit"))
    one = F.expr("shiftleft(cast(1 as bigint), cast(bit % 64 as int))")
    return bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(one).alias("bits"))


def union(*filters: DataFrame) -> DataFrame:
    """The filter of everything that any of `filters` (of one size) holds."""
    return reduce(DataFrame.unionByName, filters).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probe(keys: DataFrame, held: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """`keys` (distinct) and `maybe`: whether the filter may hold them."""
    asked = keys.select(column, F.explode(_places(F.col(column), bits, hashes)).alias("bit")).withColumn("word", F.expr("bit div 64"))
    hit = F.expr("coalesce((shiftright(bits, cast(bit % 64 as int)) & 1) = 1, false)")
    return asked.join(held, "word", "left").groupBy(column).agg(F.bool_and(hit).alias("maybe"))


def probed(keys: DataFrame, rows: DataFrame, column: str, expected: int, error: float = 0.01) -> DataFrame:
    """`keys` (distinct) and `maybe`: whether a filter of `rows` may hold them."""
    size = sizes(expected, error)
    return probe(keys, filled(rows, column, *size), column, *size)


class BloomFilter:
    def __init__(self, handle, gateway):
        self._handle, self._gateway = handle, gateway

    @classmethod
    def of(cls, rows: DataFrame, column: str, expected: int = 1000, error: float = 0.01) -> BloomFilter:
        """Built on the executors, partition by partition; no false negatives."""
        return cls(rows._jdf.stat().bloomFilter(column, expected, error), rows.sparkSession._jvm)

    def may_contain(self, value) -> bool:
        return self._handle.mightContain(value)

    @property
    def bits(self) -> int:
        return self._handle.bitSize()

    @property
    def error(self) -> float:
        return self._handle.expectedFpp()

    def union(self, other: BloomFilter) -> BloomFilter:
        """Both must have the same size and number of hashes."""
        return BloomFilter(self._handle.mergeInPlace(other._handle), self._gateway)

    def to_bytes(self) -> bytes:
        out = self._gateway.java.io.ByteArrayOutputStream()
        self._handle.writeTo(out)
        return bytes(out.toByteArray())

    @classmethod
    def from_bytes(cls, data: bytes, rows: DataFrame) -> BloomFilter:
        jvm = rows.sparkSession._jvm
        return cls(jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(jvm.java.io.ByteArrayInputStream(bytearray(io.BytesIO(data).getvalue()))), jvm)
