"""Client frames: type (1), key length (4), value length (4), key, value; big-endian, parts may arrive in any pieces."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = 9


class FrameReader:
    """Takes bytes as they come and gives whole commands."""

    def __init__(self):
        self._held = bytearray()

    def feed(self, data: bytes) -> list[tuple[int, bytes, bytes]]:
        self._held += data
        out, at = [], 0
        while len(self._held) - at >= HEADER:
            kind, k, v = struct.unpack_from(">Bii", self._held, at)
            if k < 0 or v < 0:
                raise ValueError("negative length")
            if len(self._held) - at < HEADER + k + v:
                break
            body = bytes(self._held[at + HEADER : at + HEADER + k + v])
            out.append((kind, body[:k], body[k:]))
            at += HEADER + k + v
        del self._held[:at]
        return out


def write(kind: int, key: bytes = b"", value: bytes = b"") -> bytes:
    return struct.pack(">Bii", kind, len(key), len(value)) + key + value


def written(commands: DataFrame) -> DataFrame:
    """(session, data): the frames that clients sent, of (session, ord, opcode, key, value) in order; a session's bytes are one row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("ord")
        data = b"".join(write(int(c), bytes(k or b""), bytes(v or b"")) for c, k, v in zip(rows["opcode"], rows["key"], rows["value"], strict=True))
        return pd.DataFrame({"session": frame["session"].iloc[:1].to_numpy(), "data": [data]})

    columns = ["session", "ord", "opcode", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")]
    return commands.select(*columns).groupBy("session").applyInPandas(run, f"session {dict(commands.dtypes)['session']}, data binary")


def parse(captures: DataFrame) -> DataFrame:
    """(session, ord, opcode, key, value) of (session, data); a session's bytes are one row."""

    def run(frames):
        for frame in frames:
            rows = [(s, i, *c) for s, data in zip(frame["session"], frame["data"], strict=True) for i, c in enumerate(FrameReader().feed(bytes(data)))]
            yield pd.DataFrame(rows, columns=["session", "ord", "opcode", "key", "value"])

    kind = dict(captures.dtypes)["session"]
    return captures.select("session", "data").mapInPandas(run, f"session {kind}, ord int, opcode int, key binary, value binary")
