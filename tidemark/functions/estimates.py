"""Sizes and error rates of Bloom filters, ratios without division by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bloom_bits(n: Column, p: Column) -> Column:
    return F.ceil(-n * F.ln(p) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))).cast("long")


def bloom_hashes(bits: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.round(bits / n * F.ln(F.lit(2.0)), 0)).cast("int")


def bloom_error(hashes: Column, n: Column, bits: Column) -> Column:
    return F.pow(1.0 - F.exp(-hashes * n / bits), hashes)


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or nothing was counted."""
    return F.when(b.isNull() | (b == 0), 0.0).otherwise(a.cast("double") / b)
