"""Codes of vectors: each part of a vector is replaced by the nearest entry of the part's codebook, which Lloyd's rounds
train on all vectors.

Vectors lie in blocks of whole numbers, written once in buckets. For each block and codebook entry there is a heap of the
parts that the entry holds, keyed by the lower bound of the distance to any other entry minus the upper bound of that to
this one, both as when the part was last scanned, plus the entry's drift until then. An entry's drift grows in each round by
the way that it moved and the longest way that another one moved. Parts whose key lies above the drift can't have changed
their entry, so a round pops the others from the heaps, scans all entries for them exactly, in whole numbers, and pushes
them again. What leaves and joins an entry goes to the driver as sums for each entry; heaps are written in the buckets of
their vectors, so no round shuffles either.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, materialise, shuffle_parts, small

#: Most bytes of a block's numbers, and about so many of a bucket's.
BLOCK, BUCKET = 8 << 20, 128 << 20
#: Rows that are held against all entries at a time.
SCAN = 2048
#: A label with at least this part of all rows is joined by broadcast: at most so many labels are.
HEAVY = 10_000

STATE = "block long, entries binary, keys binary, places binary, delta binary"


@dataclass(frozen=True)
class Books:
    """The codebooks as they stand: parts x entries x width; each entry's drift; what bounds may be off by rounding."""

    entry: np.ndarray
    drift: np.ndarray
    slack: float
    exact: bool  #: whether sums of squares are exact in floating point

    def moved(self, entry: np.ndarray) -> Books:
        way = np.sqrt(((entry - self.entry).astype(float) ** 2).sum(2))
        farthest = np.sort(np.pad(way, ((0, 0), (1, 0))), axis=1)[:, -2:]
        other = np.where(way == farthest[:, 1:], farthest[:, :1], farthest[:, 1:])  # the longest way of another one
        return Books(entry, self.drift + way + other, self.slack, self.exact)


def distances(x: np.ndarray, entry: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of rows to entries, without rounding; exact: all sums lie below 2 ** 53."""
    x, entry = (a.astype(float if exact else np.int64) for a in (x, entry))
    return (x * x).sum(1)[:, None] - 2 * (x @ entry.T) + (entry * entry).sum(1)


def nearest(x: np.ndarray, entry: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry, of equally near ones the first, and how much farther the next one is, unsquared."""
    which, gap = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), SCAN):
        d = distances(x[i : i + SCAN], entry, exact)
        at, rows = d.argmin(1), np.arange(len(d))
        first = np.sqrt(d[rows, at].astype(float))
        d[rows, at] = np.iinfo(np.int64).max
        which[i : i + SCAN] = at
        gap[i : i + SCAN] = np.sqrt(d.min(1).astype(float)) - first if len(entry) > 1 else np.inf
    return which, gap


class Block:
    """A block's parts, the entries that hold them, and the heaps."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x  # rows x parts x width
        self.entries: np.ndarray | None = None
        self.heaps: list[list[list[tuple[float, int]]]] = []

    def load(self, entries: bytes, keys: bytes, places: bytes, size: int) -> None:
        rows, parts, _ = self.x.shape
        self.entries = np.frombuffer(entries, np.uint8).reshape(parts, rows).astype(np.int64)
        keys, places = (np.frombuffer(a, kind).reshape(parts, rows) for a, kind in ((keys, "<f8"), (places, "<i4")))
        for k in range(parts):
            flat = list(zip(keys[k].tolist(), places[k].tolist(), strict=True))
            ends = np.cumsum(np.bincount(self.entries[k], minlength=size)).tolist()
            self.heaps.append([flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])

    def stored(self) -> tuple[bytes, bytes, bytes]:
        """Entries by row, and each part's heaps one after another, as they are laid out."""
        flat = [x for part in self.heaps for heap in part for x in heap]
        keys, places = (np.array([x[i] for x in flat], kind).tobytes() for i, kind in ((0, "<f8"), (1, "<i4")))
        return self.entries.astype(np.uint8).tobytes(), keys, places

    def assign(self, books: Books) -> np.ndarray:
        """Brings all parts to their nearest entries; what entries gained: (parts, entries, width + 1), counts last."""
        rows, parts, width = self.x.shape
        size = books.entry.shape[1]
        delta = np.zeros((parts, size, width + 1), np.int64)
        fresh = self.entries is None
        if fresh:
            self.entries = np.zeros((parts, rows), np.int64)
            self.heaps = [[[] for _ in range(size)] for _ in range(parts)]
        for k in range(parts):
            heaps, drift = self.heaps[k], books.drift[k].tolist()
            if fresh:
                due = np.arange(rows)
            else:
                popped = []
                for heap, far in zip(heaps, drift, strict=True):
                    most = far + books.slack * (1 + far)
                    while heap and heap[0][0] <= most:
                        popped.append(heapq.heappop(heap)[1])
                due = np.array(popped, np.int64)
            if not len(due):
                continue
            x = self.x[due, k]
            which, gap = nearest(x, books.entry[k], books.exact)
            full = np.column_stack([x.astype(np.int64), np.ones(len(x), np.int64)])
            went = np.ones(len(due), bool) if fresh else which != self.entries[k, due]
            np.add.at(delta[k], which[went], full[went])
            if not fresh:
                np.subtract.at(delta[k], self.entries[k, due[went]], full[went])
            self.entries[k, due] = which
            for e, key, i in zip(which.tolist(), (gap + books.drift[k][which]).tolist(), due.tolist(), strict=True):
                heapq.heappush(heaps[e], (key, i))
        return delta

    def errors(self, books: Books) -> np.ndarray:
        """Squared distances of the rows to their entries, summed over parts."""
        out = np.zeros(len(self.x), np.int64)
        for k in range(self.x.shape[1]):
            d = self.x[:, k].astype(np.int64) - books.entry[k][self.entries[k]]
            out += (d * d).sum(1)
        return out


def packed(scale: int, rows: int, kind: str) -> Callable:
    """Blocks of up to so many vectors, as whole numbers of a kind."""

    def block(key: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(parts).combine_chunks()
        n = len(both)
        x = np.floor(both["v"].chunk(0).flatten().to_numpy(zero_copy_only=False) * float(scale)).astype(kind) if n else np.zeros(0, kind)
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), both[c].chunk(0)) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *lists, pa.array([n]), pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "labels", "n", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while len(batch):
                take = batch.slice(0, rows - n)
                kept.append(take)
                n += len(take)
                batch = batch.slice(len(take))
                if n == rows:
                    yield block(key, kept)
                    key, kept, n = key + 1, [], 0
        if n:
            yield block(key, kept)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], kind: str, books: Books) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    parts, size, width = books.entry.shape
    for batch in batches:
        for i in range(len(batch)):
            block = Block(np.frombuffer(batch["x"][i].as_buffer(), kind).reshape(batch["n"][i].as_py(), parts, width))
            if "entries" in batch.schema.names:
                block.load(*(batch[c][i].as_py() for c in ("entries", "keys", "places")), size)
            yield batch, i, block


def step(kind: str, books: Books) -> Callable:
    """A round: blocks, with their heaps if there are any, to new heaps and what the entries gained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _blocks(batches, kind, books):
            delta = block.assign(books)
            at = np.flatnonzero(delta)
            cols = [batch["block"].slice(i, 1), *(pa.array([b], pa.binary()) for b in (*block.stored(), np.stack([at, delta.ravel()[at]]).astype("<i8").tobytes()))]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "entries", "keys", "places", "delta"])

    return run


def finish(kind: str, books: Books) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _blocks(batches, kind, books):
            block.assign(books)
            parts = block.entries.shape[0]
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(block.x), [None, pa.py_buffer(block.entries.T.astype(np.uint8).tobytes())]).cast(pa.binary())
            cols = [batch["ids"].slice(i, 1).flatten(), batch["labels"].slice(i, 1).flatten(), codes, pa.array(block.errors(books))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "code", "error"])

    return run


def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's deltas."""
    total: dict[int, int] = {}
    for batch in batches:
        for raw in batch["delta"]:
            at, n = np.frombuffer(raw.as_buffer(), "<i8").reshape(2, -1)
            for k, v in zip(at.tolist(), n.tolist(), strict=True):
                total[k] = total.get(k, 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["at", "n"])


def finite(v: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def with_totals(coded: DataFrame) -> DataFrame:
    """coded, a table, with label_error: the errors of a label's rows, nulls together. Labels with many rows are joined by
    broadcast, of which there are few; all others can't be skewed."""
    totals = materialise(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    rows = coded.count()
    heavy = F.broadcast(totals.where(F.col("n") * HEAVY >= rows).select(F.col("label").alias("l"), "label_error"))  # at most HEAVY rows
    few = totals.where(F.col("n") * HEAVY < rows).select(F.col("label").alias("l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("l"))
    often = coded.join(heavy, same).drop("l")
    if few.isEmpty():
        return often
    return often.union(coded.join(heavy, same, "left_anti").join(small(few, few.count(), 100), same).drop("l"))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """A row for each vector that is kept: vec_id, label, code (a byte for each part), error (squared distance between the
    numbers and their entries), label_error (errors summed over the rows of a label, null labels together); and the
    codebooks (parts x entries x numbers of a part).

    Kept are vectors without null or non-finite components whose length is the table's, that is the commonest (of equally
    common ones the longest), which has to be a multiple of parts. A component x becomes floor(scale * x). The codebooks
    begin with the vectors of the `entries` smallest ids (repeated ids by their vectors, null ids last), or of all where
    there are fewer. Each round brings every part to its nearest entry, of equally near ones the first, and then
    moves entries to floor(sum / count) of their parts; entries without parts stay. Repeated rows count as often as they
    are there. An empty table, or one without such vectors, gives no rows and empty codebooks. Extra columns are ignored.
    Components so large that squared distances pass 64 bits are an error.
    """
    spark = vectors.sparkSession
    ids, labels = (vectors.schema[c].dataType.simpleString() for c in (vec_id, label))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(finite(F.col("v")))
    largest = F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0.0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0.0)))))
    lengths = sorted(rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), largest.alias("most")).collect(), key=lambda r: (-r["n"], -r["size"]))
    if not lengths:
        none = spark.createDataFrame([], f"vec_id {ids}, label {labels}, code binary, error long, label_error long")
        return none, np.zeros((parts, 0, 0), np.int64)
    length, n = lengths[0]["size"], lengths[0]["n"]
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    width, most = length // parts, lengths[0]["most"] * scale + 1
    if length * (2 * most) ** 2 >= 2**63:
        raise ValueError("components are too large for distances of 64 bits")
    rows = rows.where(F.size("v") == length)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.floor(np.array([r["v"] for r in seeds], float) * scale).astype(np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    books = Books(start, np.zeros(start.shape[:2]), 1e-12 * (1 + 2 * most * length), width * (2 * most) ** 2 < 2**53)

    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    size = length * np.dtype(kind).itemsize
    buckets = max(shuffle_parts(spark), -(-n * size // BUCKET))
    held = max(1, min(BLOCK // max(size, 1), max(256, n // (2 * buckets))))
    made = rows.mapInArrow(packed(scale, held, kind), f"block long, ids array<{ids}>, labels array<{labels}>, n long, x binary")
    table = bucketed(made.repartition(buckets, "block"), "vectors", "block", buckets)

    state = None
    sums = np.zeros((*start.shape[:2], width + 1), object)
    for _ in range(rounds):
        numbers = table.select("block", "n", "x")
        joined = numbers if state is None else numbers.join(state.drop("delta").hint("shuffle_hash"), "block")
        state = bucketed(joined.mapInArrow(step(kind, books), STATE), "heaps", "block", buckets)
        # At most parts x entries x (width + 1) rows.
        for r in state.select("delta").mapInArrow(gains, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect():
            sums.reshape(-1)[r["at"]] += int(r["n"])
        used = sums[:, :, width] > 0
        moved = books.entry.copy()
        moved[used] = (sums[used][:, :width] // sums[used][:, width:]).astype(np.int64)
        books = books.moved(moved)
    joined = table if state is None else table.join(state.drop("delta").hint("shuffle_hash"), "block")
    coded = materialise(joined.mapInArrow(finish(kind, books), f"vec_id {ids}, label {labels}, code binary, error long"), "coded")
    return with_totals(coded), books.entry
