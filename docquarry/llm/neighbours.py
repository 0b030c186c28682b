"""Quality of texts by the votes of labelled neighbours in a latent semantic space.

A text's terms are its words, their shapes (runs of lower case, upper case, digits and each sign), pairs of shapes that
follow each other, and words that repeat the one before, by the power of two of the times, hashed to BUCKETS; a term
weighs (1 + log of its count) times the logarithm of its rarity among all documents. A truncated singular value decomposition of a bounded sample of labelled rows gives the
latent space; the sample's vectors in it, with their labels, are broadcast. Every document is held against every one of
them, in blocks of exact cosine products, and its nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import fold, materialise

U = np.uint64
BUCKETS = 1 << 13
#: Most labelled rows that are learnt from, and numbers of a latent vector: the broadcast is 4 * DIMS * (SAMPLE + BUCKETS) bytes.
SAMPLE, DIMS = 4000, 48
#: Votes: so many nearest rows, and those that are as near as the last of them. Similarities are told apart to 1 / STEPS.
NEIGHBOURS, STEPS = 15, 100_000
BATCH, ROWS = 1 << 20, 512

_KIND = np.arange(256, dtype=np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48


@dataclass(frozen=True)
class Neighbours:
    rarity: np.ndarray  #: of each bucket
    space: np.ndarray  #: buckets x dims
    known: np.ndarray  #: rows x dims, of length 1 or 0
    label: np.ndarray  #: of each row


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (words.mix(h ^ U(0x2545F4914F6CDD1D + kind)) % U(BUCKETS)).astype(np.int64)


def shapes(data: np.ndarray, w: words.Words) -> np.ndarray:
    """Hashes of the words' shapes: each run of bytes of a kind counts once."""
    kinds = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[w.start] = True
    before = np.concatenate([[0], np.cumsum(first)])
    return words.span_hashes(kinds[first], before[w.start], before[w.end])


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of all terms of the texts, by row and bucket."""
    data, offsets = words.buffers(texts)
    w = words.split(data, offsets)
    shape = shapes(data, w)
    follows = np.flatnonzero(w.doc[1:] == w.doc[:-1]) + 1
    again = follows[w.hash[follows] == w.hash[follows - 1]]
    fresh = np.flatnonzero(np.diff(again, prepend=-2) != 1)  # where a word is repeated for the first time
    times = again - np.repeat(again[fresh], np.diff(fresh, append=len(again))) + 1
    found = (
        (w.doc, _bucket(w.hash, 0)), (w.doc, _bucket(shape, 1)), (w.doc[follows], _bucket(words.pair(shape[follows - 1], shape[follows]), 2)),
        (w.doc[again], _bucket(np.log2(times).astype(U), 3)),
    )
    keys, counts = np.unique(np.concatenate([d.astype(np.int64) * BUCKETS + b for d, b in found]), return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, counts


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            yield batch.slice(i, j - i)


def _seen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each bucket is; their number stands at BUCKETS."""
    n = np.zeros(BUCKETS + 1, np.int64)
    for part in _parts(rows):
        _, bucket, _ = terms(part["text"])
        n[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        n[BUCKETS] += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(n)], names=["bucket", "n"])


def _drawn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(rows):
        row, bucket, count = terms(part["text"])
        ends = np.cumsum(np.bincount(row, minlength=len(part)))[:-1]
        lists = (pa.array([y.tobytes() for y in np.split(x.astype("<i4"), ends)], pa.binary()) for x in (bucket, count))
        yield pa.RecordBatch.from_arrays([part["place"], part["label"], *lists], names=["place", "label", "buckets", "counts"])


def latent(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int, rarity: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Vectors of n texts, of length 1, or 0 where nothing of a text is known to the space."""
    out = np.zeros((n, space.shape[1]), np.float32)
    weight = ((1 + np.log(count)) * rarity[bucket]).astype(np.float32)
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    if len(begin):
        out[row[begin]] = np.add.reduceat(space[bucket] * weight[:, None], begin, axis=0)
    length = np.sqrt((out.astype(float) ** 2).sum(1))[:, None]
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def decompose(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int, dims: int, rounds: int = 4) -> np.ndarray:
    """The first right singular vectors, buckets x dims, of a sparse matrix of n rows: subspace iteration over dense blocks."""

    def blocks() -> Iterator[np.ndarray]:
        for i in range(0, n, ROWS):
            a, b = np.searchsorted(row, (i, i + ROWS))
            dense = np.zeros((min(ROWS, n - i), BUCKETS), np.float32)
            dense[row[a:b] - i, bucket[a:b]] = weight[a:b]
            yield dense

    basis = np.random.default_rng(5).standard_normal((BUCKETS, min(dims + 16, max(n, 1)))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(sum((x.T @ (x @ basis) for x in blocks()), np.zeros_like(basis)))
    seen = np.concatenate([x @ basis for x in blocks()]) if n else np.zeros((0, basis.shape[1]), np.float32)
    _, size, turn = np.linalg.svd(seen, full_matrices=False)
    return basis @ turn[: min(dims, int((size > 1e-4 * max(size.max(initial=0), 1e-9)).sum()))].T


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dims: int = DIMS, seed: int = 23) -> Neighbours | None:
    """docs: doc_id, text; labels: doc_id, label. Rarities are counted on all docs. At most `sample` of the labelled rows
    make the space and vote: those with the smallest hashes of their ids. None if there are none."""
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    drawn = labels.where(part < min(1 << 30, (sample << 30) // max(n, 1))).groupBy("doc_id").agg(F.min("label").alias("label"))
    # At most about `sample` rows of two numbers, unless ids with several labels make it fewer.
    rows = docs.join(F.broadcast(drawn), "doc_id").select("text", "label", F.struct(part.alias("part"), F.xxhash64("text").alias("text")).alias("place"))
    found = materialise(rows.mapInArrow(_drawn, "place struct<part: bigint, text: bigint>, label int, buckets binary, counts binary"), "labelled")
    picked = found.orderBy("place", "label").limit(sample).collect()  # at most `sample` rows of at most BUCKETS numbers
    if not picked:
        return None
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in docs.select("text").mapInArrow(_seen, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows
        df[r["bucket"]] = r["n"]
    rarity = np.log((df[BUCKETS] + 1) / (df[:BUCKETS] + 1)).astype(np.float32)
    row = np.repeat(np.arange(len(picked)), [len(r["buckets"]) // 4 for r in picked])
    bucket, count = (np.concatenate([np.frombuffer(r[c], "<i4") for r in picked]).astype(np.int64) for c in ("buckets", "counts"))
    weight = ((1 + np.log(count)) * rarity[bucket]).astype(np.float32)
    length = np.sqrt(np.bincount(row, weight.astype(float) ** 2, len(picked)))
    space = decompose(row, bucket, weight / np.maximum(length, 1e-12).astype(np.float32)[row], len(picked), dims).astype(np.float32)
    return Neighbours(rarity, space, latent(row, bucket, count, len(picked), rarity, space), np.array([r["label"] for r in picked], float))


def votes(vectors: np.ndarray, model: Neighbours, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The part of the votes that are for label 1, weighted by similarity; 0 for a vector that is like no known one."""
    out = np.zeros(len(vectors))
    k = max(len(model.known) - neighbours, 0)
    for i in range(0, len(vectors), ROWS):
        near = np.maximum(np.rint((vectors[i : i + ROWS] @ model.known.T) * STEPS), 0)
        last = np.partition(near, k, axis=1)[:, k : k + 1]
        weight = np.where(near >= last, near, 0).astype(float)
        total = weight.sum(1)
        out[i : i + ROWS] = np.divide(weight @ model.label, total, out=np.zeros(len(total)), where=total > 0)
    return out


def _score(rows: Iterator[pa.RecordBatch], model: Neighbours | None, neighbours: int) -> Iterator[pa.RecordBatch]:
    for part in _parts(rows):
        score = np.zeros(len(part))
        if model is not None:
            score = votes(latent(*terms(part["text"]), len(part), model.rarity, model.space), model, neighbours)
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(np.minimum(score, 1.0))], names=["doc_id", "held_out", "score"])


def quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", label_id: str = "doc_id", folds: int = 5, threshold: float = 0.3,
    sample: int = SAMPLE, dims: int = DIMS, neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from the threshold on).

    Labels are learnt from rows whose crc32(doc_id as text) mod folds isn't 0; null labels and ids are left out, and an id
    with several labels counts as good only if all say so. Null and empty texts, and texts that are like no labelled one,
    score 0; so does all without labels. Of equally near neighbours all vote. Very long texts are scored whole. Ids may
    repeat or be null. An empty table gives an empty result. Extra columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), folds) == 0).alias("held_out"), F.col(text).alias("text"))
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where((fold(F.col("doc_id"), folds) != 0) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.select("doc_id", "text"), known, sample, dims))  # bounded by sample and dims
    return rows.mapInArrow(lambda it: _score(it, model.value, neighbours), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
