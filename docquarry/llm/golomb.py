"""Golomb-Rice code of sorted 64-bit numbers: unary quotients and plain remainders of the gaps."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QBQ")


def encode(sorted_values: np.ndarray, universe: int) -> bytes:
    """Best for values spread evenly over range(universe); right for any sorted ones, repeats included."""
    n = len(sorted_values)
    if not n:
        return HEAD.pack(0, 0, 0)
    gaps = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, (max(1, universe) // n).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = np.empty((n, k), np.uint8)
    for j in range(k):
        rest[:, j] = (gaps >> np.uint64(j)).astype(np.uint8) & 1
    return HEAD.pack(n, k, len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def decode(blob: bytes) -> np.ndarray:
    n, k, bits = HEAD.unpack_from(blob)
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(blob, np.uint8, offset=HEAD.size)
    cut = (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[:cut], count=bits))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(raw[cut:], count=n * k).reshape(n, k)
        for j in range(k):
            gaps += rest[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps, dtype=np.uint64)
