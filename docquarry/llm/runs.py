"""Periodic runs of words: the runs of a sequence over any ordered alphabet, found by its Lyndon arrays.

Every run has a root that is the longest Lyndon word at its place under the alphabet's order or under the reversed one,
so the roots are among the pairs of a place and its next smaller suffix. links() finds these pairs from left to right with
the length to which the two suffixes match. A match that has been read is never read again: a pair within a stretch that
is known to repeat an earlier one takes the earlier pair's length, and a pair whose two ends have both been held against
a third place takes the smaller of the two lengths. So reading and comparing are linear in the number of words; neither
suffix arrays nor hashes of substrings are used.

A run of the asked kind needs a pair that matches for at least reach() words. shallow() makes the same arrays for many
texts in lockstep and gives up texts in which a pair gets that far; only these go through links(), the others hold no
such run.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Runs that count: at least so many words, and so many periods.
LENGTH, EXPONENT = 6, 4
BATCH = 2 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def links(y: array) -> tuple[array, array]:
    """y: numbers >= 0, then -1. For each place the next smaller suffix, and how far both match."""
    n = len(y) - 1
    nss, ext, pss, back = (array("q", bytes(8 * (n + 1))) for _ in range(4))  # back: how far a place matches pss
    if n:
        pss[0] = -1
    lo = at = end = 0  # y[at:end] is what stands from lo on
    for r in range(1, n + 1):
        t, m, known = r - 1, 0, False
        while True:
            grow = True
            if at < r < end and t >= at:
                d = at - lo
                m = ext[t - d] if nss[t - d] == r - d else back[r - d]
                if r + m < end:
                    grow = False
                else:
                    m = end - r
            elif known:
                a = back[last]
                grow = a == m
                if a < m:
                    m = a
            if grow:
                a, b = t + m, r + m
                while y[a] == y[b]:
                    a += 1
                    b += 1
                m = b - r
                if b >= end:
                    lo, at, end = t, r, b
            if y[t + m] < y[r + m]:
                pss[r], back[r] = t, m
                break
            nss[t], ext[t], last, known = r, m, t, True
            t = pss[t]
            if t < 0:
                pss[r] = -1
                break
    return nss[:n], ext[:n]


def reach(length: int, exponent: int) -> int:
    """How far the suffixes of a run's first root and of the next one match, at least."""
    return min(max(length, exponent * p) - 2 * p + 1 for p in range(1, length + 2))


def found(y: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of y, numbers >= 0, by start and period. exponent: 2 or more."""
    out: set[tuple[int, int, int]] = set()
    n = len(y)
    for order in (y, y.max(initial=0) - y):
        nss, ext = (np.frombuffer(a, np.int64) if n else np.zeros(0, np.int64) for a in links(array("q", np.append(order, -1).tobytes())))
        i = np.arange(n)
        p = nss - i
        root = np.flatnonzero((2 * p + ext - 1 >= np.maximum(length, exponent * p)) & (ext > 0))
        before = root - p[root]  # the same root once more: then this one is not the first
        first = (before < 0) | (nss[before] != root) | (ext[before] < p[root])
        for k in root[first].tolist():
            q = int(p[k])
            size = min(k, q)
            differ = np.flatnonzero(y[k - size : k] != y[k + q - size : k + q])
            back = size - 1 - int(differ[-1]) if len(differ) else size
            whole = back + q + int(ext[k])
            if whole >= max(length, exponent * q):
                out.add((k - back, whole, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def shallow(y: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """y: the numbers of several texts, -1 after each, at ends. Whether no pair of a text's Lyndon arrays, in both orders,
    matches for depth words. All places move at once: a place whose next one is larger goes on to where that one got."""
    deep = np.zeros(len(ends), bool)
    word = y >= 0
    for order in (y, np.where(word, y.max(initial=0) - y, -1)):
        to = np.arange(1, len(y) + 1)
        live = np.flatnonzero(word)
        while len(live):
            j = to[live]
            a, b = order[live], order[j]
            less = b < a
            same = np.flatnonzero(a == b)
            for k in range(1, depth):
                if not len(same):
                    break
                a, b = order[live[same] + k], order[j[same] + k]
                less[same[b < a]] = True
                same = same[a == b]
            if len(same):
                deep[np.searchsorted(ends, live[same])] = True
            more = np.flatnonzero(~less)
            live, j = live[more], j[more]
            to[live] = to[j]
            if len(same):
                live = live[~deep[np.searchsorted(ends, live)]]
    return ~deep


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's words begin and end among them."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), before[offsets - offsets[0]]


def _runs(rows: Iterator[pa.RecordBatch], length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    depth = reach(length, exponent)
    for batch in rows:
        for lo, hi in words.batches(batch["text"], BATCH):
            part = batch.slice(lo, hi - lo)
            flat, offsets = tokens(part["text"])
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            y = np.insert(codes, offsets[1:], -1)
            quiet = shallow(y, offsets[1:] + np.arange(len(part)), depth)
            runs, gone = [], np.zeros(len(codes) + 1, np.int64)
            for k in range(len(part)):
                a, b = int(offsets[k]), int(offsets[k + 1])
                got = [] if quiet[k] else found(codes[a:b], length, exponent)
                for start, size, period in got:
                    gone[a + start + period] += 1
                    gone[a + start + size] -= 1
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
            stay = np.cumsum(gone[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stay)])[offsets]
            left = pa.LargeListArray.from_arrays(pa.array(kept), flat.filter(pa.array(stay)))
            collapsed = pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(runs, kind), collapsed], names=["doc_id", "runs", "collapsed"])


def text_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """One row for each row of docs: doc_id, runs (start, length and period in words, by start and period), collapsed (the
    words that no run holds after its first period, joined by one space).

    A run is a stretch of consecutive words with smallest period q, of max(length, exponent * q) words or more, that no
    neighbouring word extends. Words are what stands between spaces and U+0009 to U+000D; case counts. Null and empty
    texts have no words: no runs, an empty text. Runs may overlap; equal ones of different periods are one, with the
    smallest. Very long texts are taken whole. Each row stands for itself, so ids may repeat or be null. An empty table
    gives an empty result. Extra columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _runs(it, length, exponent), f"doc_id {kind}, runs {RUNS}, collapsed string")
