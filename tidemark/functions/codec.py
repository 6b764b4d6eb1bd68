"""Encodings and hashes of keys, as column expressions without user functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETE, PUT = 0, 1
MAX_KEY_BYTES = 1024


def valid_key(key: Column) -> Column:
    """Keys are 1 to 1,024 bytes."""
    return key.isNotNull() & F.octet_length(key).between(1, MAX_KEY_BYTES)


def _byte(hex_text: Column, i: Column) -> Column:
    """Byte i (from 1) of a binary given as hexadecimal text, as an int."""
    return F.conv(F.substring(hex_text, 2 * i - 1, F.lit(2)), 16, 10).cast("int")


def signed_order(key: Column) -> Column:
    """A sort key by signed bytes: 0x80 to 0xff come before 0x00 to 0x7f; a prefix comes first.

    Spark orders binaries by unsigned bytes; for ASCII keys both orders agree and this is not needed."""
    text = F.hex(key)
    at = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: (_byte(text, i) - F.when(_byte(text, i) >= 128, 256).otherwise(0)).cast("tinyint"))


def encode_internal_key(key: Column, op: Column, seq: Column) -> Column:
    """User key, one byte of type, eight bytes of sequence, big-endian; as hexadecimal text."""
    return F.concat(F.hex(key.cast("binary")), F.lpad(F.hex(op.cast("long")), 2, "0"), F.lpad(F.hex(seq), 16, "0"))


def decode_internal_key(text: Column) -> tuple[Column, Column, Column]:
    """(user key as text, type, sequence) of an encoded internal key in hexadecimal."""
    n = F.length(text)
    number = lambda start, size: F.conv(F.substring(text, start, F.lit(size)), 16, 10)
    key = F.unhex(F.substring(text, F.lit(1), n - 18)).cast("string")
    return key, number(n - 17, 2).cast("int"), number(n - 15, 16).cast("long")


def record_bytes(key: Column, value: Column, op: Column) -> Column:
    """Bytes of one operation in a log record: type, key length, key, and for puts value length and value."""
    return 5 + F.octet_length(key) + F.when(op == PUT, 4 + F.octet_length(value)).otherwise(0)


def memory_bytes(key: Column, value: Column, op: Column) -> Column:
    """Accounted bytes of an entry in memory: key and value, the internal key (key + 9) and 16 of overhead."""
    return 2 * F.octet_length(key) + F.when(op == PUT, F.octet_length(value)).otherwise(0) + 25


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; 0 with null."""
    n = F.least(F.length(a), F.length(b))
    # the first place where they differ ends it
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(a.isNull() | b.isNull() | (n == 0), 0).when(F.size(differ) == 0, n).otherwise(F.array_min(differ) - 1).cast("int")


def polynomial_hash(text: Column) -> Column:
    """The 31-polynomial hash of a string of basic characters, as a signed 32-bit number."""
    letters = F.split(text, "")
    h = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def shard(text: Column, shards: int) -> Column:
    """Which of `shards` parts a key belongs to: its hash, high half folded in, sign dropped."""
    h = polynomial_hash(text)
    return (h.bitwiseXOR(F.shiftrightunsigned(h, 16)).bitwiseAND(F.lit(0x7FFFFFFF)) % shards).cast("int")


def glob(pattern: str) -> str:
    """The regular expression of a glob: * any text, ? one character, dots literal, all of the string."""
    return "^(?:" + pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".") + ")$"


def glob_match(text: Column, pattern: str) -> Column:
    return text.rlike(glob(pattern))


def block_key(table: Column, offset: Column, version: Column) -> Column:
    """The name of a block in a cache: another version of its file is another block."""
    return F.concat_ws(":", F.lit("block"), table, offset.cast("string"), version.cast("string"))


def _length(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 8, "0")


def text_reply(text: Column) -> Column:
    """A reply of one line of text: four bytes of length, the text and a line end, as hexadecimal text."""
    return F.concat(_length(F.octet_length(text) + 1), F.hex(text.cast("binary")), F.lit("0A"))


def value_reply(value: Column) -> Column:
    """A reply with a value: four bytes of length and the value; length -1 alone where there is none. As hexadecimal text."""
    return F.when(value.isNull(), F.lit("FFFFFFFF")).otherwise(F.concat(_length(F.octet_length(value)), F.hex(value.cast("binary"))))


def file_name(kind: str, number: Column) -> Column:
    """Names of logs, tables and manifests: six digits at least."""
    fixed = F.format_string("%06d", number)
    return F.concat(F.lit("MANIFEST-"), fixed) if kind == "manifest" else F.concat(fixed, F.lit({"log": ".log", "table": ".sst"}[kind]))


def file_kind(name: Column) -> Column:
    return F.when(name.endswith(".log"), "log").when(name.endswith(".sst"), "table").when(name.startswith("MANIFEST-"), "manifest").otherwise("unknown")


def file_number(name: Column) -> Column:
    """The number in the name of a log or table; null for other names."""
    digits = F.regexp_extract(name, r"^(?:.*/)?(\d+)\.(?:sst|log)$", 1)
    return F.when(digits != "", digits.cast("long"))


#: Opcodes of commands and types of log fragments.
OPCODES = {0x01: "PUT", 0x02: "DELETE", 0x03: "GET", 0x10: "BATCH_START", 0x11: "BATCH_COMMIT", 0x12: "BATCH_CANCEL"}
FRAGMENTS = {1: "FULL", 2: "FIRST", 3: "MIDDLE", 4: "LAST"}


def _named(code: Column, names: dict[int, str], other: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in names.items():
        out = out.when(code == k, v)
    return out.otherwise(other)


def command_name(code: Column) -> Column:
    return _named(code, OPCODES, F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")")))


def fragment_name(code: Column) -> Column:
    return _named(code, FRAGMENTS, F.lit(None).cast("string"))


def valid_command(code: Column, key_bytes: Column, value_bytes: Column) -> Column:
    """Puts need a key; gets and deletes a key and no value; batch commands neither."""
    control = code.isin(0x10, 0x11, 0x12) & (key_bytes == 0) & (value_bytes == 0)
    return ((code == 0x01) & (key_bytes > 0) & (value_bytes >= 0)) | (code.isin(0x02, 0x03) & (key_bytes > 0) & (value_bytes == 0)) | control


def checksum(data: Column) -> Column:
    """CRC-32 as a signed 32-bit number."""
    c = F.crc32(data.cast("binary"))
    return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c).cast("int")
