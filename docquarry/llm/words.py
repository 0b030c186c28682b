"""White-space words of many texts at once, in numpy over Arrow's buffers: hashes instead of strings.

The hash of a word is folded over its bytes, eight at a time, each step a bijection of 64-bit numbers; words of more than
LONG bytes take a cryptographic digest. Words of one length up to eight bytes never share a hash; others do with a
probability near 2^-64 for a pair. Users that need certainty compare the bytes with same().
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20
LONG = 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_CACHE: dict[str, np.ndarray] = {}


_KEPT: dict[str, object] = {}


def kept(owner: str) -> dict:
    """What a worker keeps from task to task for one operator; whatever it kept for another one is dropped."""
    if _KEPT.get("owner") != owner:
        _KEPT.clear()
        _KEPT.update(owner=owner, things={})
    return _KEPT["things"]


def masks() -> np.ndarray:
    """For 0 to 8 bytes: the bits that a lane of so many bytes takes."""
    if not _CACHE:
        _CACHE["masks"] = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
    return _CACHE["masks"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * U(0x9E3779B97F4A7C15) + (b ^ U(0xD6E8FEB86659FD93)))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    lane, mask = lanes(data), masks()
    n = end - start
    h = mix(n.astype(U) + U(0x9E3779B97F4A7C15))
    long = n > LONG
    live = np.flatnonzero(~long & (n > 0))
    k = 0
    while len(live):
        h[live] = mix(h[live] ^ (lane[start[live] + k] & mask[np.minimum(n[live] - k, 8)]))
        k += 8
        live = live[n[live] > k]
    for i in np.flatnonzero(long).tolist():
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def same(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether each span of data has the same bytes as the span of other at its place."""
    a, b, mask = lanes(data), lanes(other), masks()
    n = end - start
    out = n == end2 - start2
    live = np.flatnonzero(out & (n > 0) & (n <= LONG))
    k = 0
    while len(live):
        equal = (a[start[live] + k] ^ b[start2[live] + k]) & mask[np.minimum(n[live] - k, 8)] == 0
        out[live[~equal]] = False
        live = live[equal]
        k += 8
        live = live[n[live] > k]
    for i in np.flatnonzero(out & (n > LONG)).tolist():
        out[i] = np.array_equal(data[start[i] : end[i]], other[start2[i] : end2[i]])
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and n + 1 offsets. A null text has no bytes."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off is not None and len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    hash: np.ndarray  #: uint64, one for each word
    doc: np.ndarray  #: int32, which text
    start: np.ndarray  #: int64, into the bytes
    end: np.ndarray
    counts: np.ndarray  #: words of each text

    def first(self) -> np.ndarray:
        """Index of the first word of each text."""
        return np.concatenate([[0], np.cumsum(self.counts)])[:-1]


def cuts(data: np.ndarray, offsets: np.ndarray, most: int) -> list[int]:
    """Ends of pieces of at most `most` bytes, which never split a word unless it is longer than that."""
    out, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data):
            back = data[max(at, end - 4096) : end]
            gaps = np.flatnonzero(SPACE[back])
            if len(gaps):
                end = end - len(back) + int(gaps[-1]) + 1
            else:
                k = int(np.searchsorted(offsets, end, "right")) - 1
                if offsets[k] > at:
                    end = int(offsets[k])
                else:  # a very long word: take all of it
                    rest = np.flatnonzero(SPACE[data[end:]])
                    stop = int(offsets[k + 1])
                    end = min(stop, end + int(rest[0]) + 1 if len(rest) else stop)
        out.append(end)
        at = end
    return out


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words are runs of bytes other than space and U+0009 to U+000D. lower: A-Z count as a-z."""
    at, parts = 0, []
    begins = np.unique(offsets[:-1])
    for end in cuts(data, offsets, PIECE):
        b = LOWER[data[at:end]] if lower else data[at:end]
        n = len(b)
        word = ~SPACE[b]
        edge = np.zeros(n + 1, bool)
        edge[begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at] = True
        edge[[0, n]] = True
        gap = np.empty(n + 1, bool)
        gap[0] = True
        gap[1:] = ~word
        s = np.flatnonzero(word & (gap[:-1] | edge[:-1]))
        after = np.empty(n, bool)
        after[:-1] = ~word[1:]
        after[-1:] = True
        e = np.flatnonzero(word & (after | edge[1:])) + 1
        parts.append((span_hashes(b, s, e), s + at, e + at))
        at = end
    if parts:
        h, s, e = (np.concatenate([p[k] for p in parts]) for k in range(3))
    else:
        h, s, e = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = (np.searchsorted(offsets, s, "right") - 1).astype(np.int32)
    return Words(h, doc, s, e, np.bincount(doc, minlength=len(offsets) - 1).astype(np.int64))


@lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library, which has no such call
        return None


def trim() -> None:
    """Gives memory that a worker has freed back to the system, instead of keeping it until the worker ends."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def batches(texts: pa.Array, most: int = 8 << 20):
    """Ranges of rows with at most `most` bytes of text each, or one row. What a range took is given back after it."""
    _, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        trim()
        i = j
