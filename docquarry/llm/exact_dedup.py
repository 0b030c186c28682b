"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every task sorts and codes the distinct fingerprints of the texts that it scans, some at a time (a chunk), with a bit
   for each that tells whether the chunk has it more than once, and sends one blob to each owner of a range of them.
   So a text that makes up a third of all rows is one fingerprint of each chunk.
2. An owner merges the blobs it gets, and answers each with a bitmap of the fingerprints that were seen twice or more.
   Blobs are a written table: the bitmaps meet them there, and fingerprints are never shuffled plain.
3. Only texts with such a fingerprint are suspects. They are compared byte by byte: grouped by the whole normalised
   text, aggregated in each task before anything is shuffled, so that a group with a third of all rows costs one row
   from each task.

Fingerprints may collide: that only makes a suspect more. Texts themselves are never moved unless suspected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golomb
from .shared import SPACES, materialise, shuffle_parts, small

#: Fingerprints are below 2 ** BITS.
BITS = 48
#: Fingerprints that a task codes at once, and that an owner gets, on average.
SENT, OWNED = 500_000, 3_000_000


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    return ((values.astype(np.uint64) >> np.uint64(BITS - 32)) * np.uint64(owners)) >> np.uint64(32)


def _bounds(owner: int, owners: int) -> tuple[int, int]:
    lo = -(-(owner << 32) // owners) << (BITS - 32)
    return lo, (-(-((owner + 1) << 32) // owners) << (BITS - 32)) - lo


def _flags(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _set(flags: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)


def send(owners: int, sent: int = SENT):
    def coded(chunk: int, fps: list[np.ndarray]) -> pa.RecordBatch:
        fp, times = np.unique(np.concatenate(fps).astype(np.uint64), return_counts=True)
        which, first = np.unique(owner_of(fp, owners), return_index=True)
        blobs, repeated = [], []
        for o, part, n in zip(which, np.split(fp, first[1:]), np.split(times, first[1:]), strict=True):
            lo, width = _bounds(int(o), owners)
            blobs.append(golomb.encode(part - np.uint64(lo), width))
            repeated.append(_flags(n > 1))
        cols = [pa.array(np.full(len(which), chunk, np.int64)), pa.array(which.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(repeated, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["chunk", "owner", "blob", "repeated"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, kept = TaskContext.get().partitionId() << 32, []
        for batch in rows:
            kept.append(batch["fp"].to_numpy(zero_copy_only=False))
            if sum(map(len, kept)) >= sent:
                yield coded(chunk, kept)
                chunk, kept = chunk + 1, []
        if sum(map(len, kept)):
            yield coded(chunk, kept)

    return run


def answer(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
    """A bit for each fingerprint of a blob: set if another row, of this chunk or another, has it too."""
    parts = [golomb.decode(b) for b in blobs["blob"]]
    own = [p[_set(r, len(p))] for p, r in zip(parts, blobs["repeated"], strict=True)]
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    twice = np.union1d(values[counts > 1], np.concatenate(own))
    bitmaps = [_flags(np.isin(p, twice)) for p in parts]
    return pd.DataFrame({"chunk": blobs["chunk"], "owner": blobs["owner"], "bitmap": bitmaps})


def pick(owners: int):
    """The fingerprints of blobs whose bits their owners have set."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for o, blob, bitmap in zip(*(batch[c].to_pylist() for c in ("owner", "blob", "bitmap")), strict=True):
                fp = golomb.decode(blob)
                fp = fp[_set(bitmap, len(fp))] + np.uint64(_bounds(o, owners)[0])
                yield pa.RecordBatch.from_arrays([pa.array(fp.astype(np.int64))], names=["fp"])

    return run


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owners: int | None = None, sent: int = SENT) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Equal are texts that agree after runs of white space became one space; null counts as empty, and empty texts are
    equal to each other. The smallest id stays (null ids never do if another is there; rows that repeat the smallest id
    all stay). Very long texts are compared whole. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text))
    texts = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    texts = texts.withColumn("fp", F.xxhash64("norm").bitwiseAND(F.lit((1 << BITS) - 1)))
    light = materialise(texts.select("doc_id", "fp", F.sha2("norm", 256).alias("text_sha256")), "fingerprints")
    owners = owners or max(shuffle_parts(spark), -(-light.count() // OWNED))
    blobs = materialise(light.select("fp").mapInArrow(send(owners, sent), "chunk long, owner int, blob binary, repeated binary"), "coded")
    answers = blobs.groupBy("owner").applyInPandas(answer, "chunk long, owner int, bitmap binary")
    found = blobs.drop("repeated").join(answers, ["chunk", "owner"]).select("owner", "blob", "bitmap").mapInArrow(pick(owners), "fp long")
    suspects = materialise(found.distinct(), "suspects")
    n = suspects.count()
    groups = (
        texts.join(small(suspects, n, 16), "fp", "left_semi").groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return light.join(small(groups, n, 120), "text_sha256", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())).alias("kept"), "text_sha256",
    )
