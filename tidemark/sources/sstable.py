"""Sorted tables in their binary form: blocks of prefix-shared entries, an index block, a footer.

An entry is three 4-byte numbers (bytes shared with the key before, own key bytes, value bytes), the
own key bytes and the value. A block ends with restart points (entry numbers) and their count. The
index block has the last key of each data block and its handle (offset and size, 8 bytes each). The
footer is the filter's handle, the index block's handle and a magic number. All big-endian.
"""

from __future__ import annotations

import bisect
import os
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = 0xDB4775248B80FB57
FOOTER = struct.Struct(">qqqqQ")
_ENTRY = struct.Struct(">iii")
RESTART, BLOCK, FULL = 16, 4096, 0.85


class Corrupt(ValueError):
    pass


def encode_block(entries: Iterable[tuple[bytes, bytes]], restart: int = RESTART) -> bytes:
    out, before, n = [], b"", 0
    for key, value in entries:
        shared = len(os.path.commonprefix([before, key]))
        out.append(_ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value)
        before, n = key, n + 1
    restarts = [0, *range(0, n, restart)] if n else []
    return b"".join(out) + b"".join(struct.pack(">i", r) for r in restarts) + struct.pack(">i", len(restarts))


def decode_block(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if len(data) < 4:
        raise Corrupt("a block has a count of restart points")
    (restarts,) = struct.unpack_from(">i", data, len(data) - 4)
    end = len(data) - 4 - 4 * restarts
    if restarts < 0 or end < 0:
        raise Corrupt("bad restart points")
    at, key = 0, b""
    while at < end:
        if at + _ENTRY.size > end:
            raise Corrupt("cut entry")
        shared, own, size = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        if not 0 <= shared <= len(key) or own < 0 or size < 0 or at + own + size > end:
            raise Corrupt("bad entry")
        key = key[:shared] + data[at : at + own]
        yield key, data[at + own : at + own + size]
        at += own + size


def encode(entries: Iterable[tuple[bytes, bytes]], block: int = BLOCK) -> bytes:
    """A table of strictly ascending keys; without a filter."""
    out, index, held, size, before = bytearray(), [], [], 0, None

    def flush() -> None:
        nonlocal held, size
        if held:
            data = encode_block(held)
            index.append((held[-1][0], struct.pack(">qq", len(out), len(data))))
            out.extend(data)
            held, size = [], 0

    for key, value in entries:
        if before is not None and key <= before:
            raise ValueError("keys must ascend")
        need = _ENTRY.size + len(key) + len(value)
        if size + need > block:
            flush()
        held.append((key, value))
        size, before = size + need, key
        if size > FULL * block:
            flush()
    flush()
    data = encode_block(index)
    at = len(out)
    return bytes(out) + data + FOOTER.pack(at, 0, at, len(data), MAGIC)


class Table:
    """A table in memory whose blocks are decoded as they are needed."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise Corrupt("too short for a table")
        *_, at, size, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC or at < 0 or size < 0 or at + size > len(data):
            raise Corrupt("no table")
        self.data, self.decoded = data, 0
        self.last, self.handles = [], []  # of each block
        for key, handle in decode_block(data[at : at + size]):
            begin, length = struct.unpack(">qq", handle)
            if begin < 0 or length < 0 or begin + length > at:
                raise Corrupt("bad handle")
            self.last.append(key)
            self.handles.append((begin, length))

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        begin, length = self.handles[k]
        self.decoded += 1
        return decode_block(self.data[begin : begin + length])

    def scan(self, low: bytes | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Entries in order, from the first key that is not below `low`; blocks before it are not decoded."""
        first = 0 if low is None else bisect.bisect_left(self.last, low)
        for k in range(first, len(self.handles)):
            for key, value in self._block(k):
                if low is None or key >= low:
                    yield key, value

    def get(self, key: bytes) -> bytes | None:
        """The value of a key, from the one block that may hold it."""
        found = next(self.scan(key), None)
        return found[1] if found and found[0] == key else None


def decode(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """All entries, block by block through the index."""
    yield from Table(data).scan()


def encoded(rows: DataFrame, by: str, block: int = BLOCK) -> DataFrame:
    """(by, content): a table of each group's (key, value); a group is as large as one file may be."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        entries = sorted(zip(map(bytes, frame["key"]), map(bytes, frame["value"]), strict=True))
        return pd.DataFrame({by: frame[by].iloc[:1].to_numpy(), "content": [encode(entries, block)]})

    return rows.select(by, F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")).groupBy(by).applyInPandas(run, f"{by} {dict(rows.dtypes)[by]}, content binary")


def decoded(tables: DataFrame, by: str) -> DataFrame:
    """(by, key, value) of tables (by, content)."""

    def run(frames):
        for frame in frames:
            for name, data in zip(frame[by], frame["content"], strict=True):
                rows = [(name, k, v) for k, v in decode(bytes(data))]
                yield pd.DataFrame(rows, columns=[by, "key", "value"])

    return tables.select(by, "content").mapInPandas(run, f"{by} {dict(tables.dtypes)[by]}, key binary, value binary")


def lookups(tables: DataFrame, by: str) -> DataFrame:
    """(by, key, value, blocks) of tables with the keys to ask (by, content, keys): value null where there is none, blocks decoded for it."""

    def run(frames):
        for frame in frames:
            rows = []
            for name, data, keys in zip(frame[by], frame["content"], frame["keys"], strict=True):
                table = Table(bytes(data))
                for key in keys:
                    before = table.decoded
                    rows.append((name, bytes(key), table.get(bytes(key)), table.decoded - before))
            yield pd.DataFrame(rows, columns=[by, "key", "value", "blocks"])

    return tables.select(by, "content", F.transform("keys", lambda k: k.cast("binary")).alias("keys")).mapInPandas(run, f"{by} {dict(tables.dtypes)[by]}, key binary, value binary, blocks int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_number, key, value) of all tables at `path`; files are read side by side."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    number = F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1).cast("long")
    return decoded(found, "path").select("path", number.alias("file_number"), "key", "value")
