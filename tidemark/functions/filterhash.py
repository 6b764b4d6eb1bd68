"""The hash of filters inside binary tables: which bits of a filter a key has."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

#: The constants of 32-bit MurmurHash3, of Java's linear congruential generator, and the generator's seed.
_C1, _C2, _ADD, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_STEP, _PLUS = 0x5DEECE66D, 0xB
SEED = 0xDEAFBEEF - (1 << 32)

_MASK = (1 << 32) - 1


def _turn(x: int, by: int) -> int:
    x &= _MASK
    return (x << by | x >> (32 - by)) & _MASK


def _signed(x: int) -> int:
    return x - (1 << 32) if x >> 31 else x


def java_ints(seed: int) -> Iterator[int]:
    """The 32-bit numbers that Java's generator gives after `seed`."""
    state = (seed ^ _STEP) & ((1 << 48) - 1)
    while True:
        state = (state * _STEP + _PLUS) & ((1 << 48) - 1)
        yield _signed(state >> 16)


def murmur(data: bytes, seed: int, order: str = ">") -> int:
    """32-bit MurmurHash3 as a signed number, with blocks of four bytes read in `order`: big-endian here, little-endian in the usual form."""
    whole = len(data) // 4 * 4
    h = seed & _MASK
    for block in struct.unpack(f"{order}{whole // 4}I", data[:whole]):
        h = (_turn(h ^ _turn(block * _C1, 15) * _C2, 13) * 5 + _ADD) & _MASK
    if tail := data[whole:]:
        h ^= _turn(int.from_bytes(tail, "little") * _C1, 15) * _C2 & _MASK
    h ^= len(data)
    h = (h ^ h >> 16) * _F1 & _MASK
    h = (h ^ h >> 13) * _F2 & _MASK
    return _signed(h ^ h >> 16)


def places(key: bytes, bits: int, hashes: int, seed: int = SEED) -> list[int]:
    """The bits of a key in a filter of `bits` bits: the remainder, sign dropped, of a hash for each of the generator's first numbers."""
    return [abs(murmur(key, s)) % bits for s in islice(java_ints(seed), hashes)]
