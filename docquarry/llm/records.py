"""Token ids as length-delimited binary records, with a separate offset index.

A record file `part-NNNNN.rec` is a row of frames, each one serialized sequence:

    uint64 length | uint32 masked crc32 of those 8 bytes | payload | uint32 masked crc32 of the payload

The payload is an int64 (little-endian, as all numbers here), uint8 flags, and the token ids as uint16, or uint32 where
the vocabulary needs it (flag 2). The int64 is the doc_id; flag 1 says that the id is null, flag 4 that it is no whole
number: then the int64 is the length of its UTF-8 text, which follows the flags. `part-NNNNN.idx` holds, for each record,
uint64 offset of its frame and uint64 number of tokens in all records of the file before it, so that readers can fetch
records in any order. Files are named by their place in ascending order of doc_id. They are written under a name of
their own and moved into place when whole, so that a task that is run again leaves the same files.

Texts are tokenised word by word: the tokenizer's normalizer and pre-tokenizer never look across white space, so the ids
of a text are those of its white-space words one after another. A worker keeps the ids of words it has seen, up to a
number of bytes and until it turns to another operator. It finds them by a hash and compares the words' bytes as well.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import words
from .shared import lean, shuffle_parts, store, work_dir

LENGTH, CRC, HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
INDEX = np.dtype([("offset", "<u8"), ("before", "<u8")])
#: Bytes of words and their ids that a worker keeps; beyond that it starts anew.
KEPT_BYTES = 48 << 20
#: Bytes of text for each file, on average.
FILE_BYTES = 64 << 20
#: Words that the tokenizer gets at a time as one text, with MARK between them. Words near one of more than words.LONG
#: bytes, or near one with a mark's first character, go alone.
GROUP, MARK = 128, "\x00|word|\x00"
NULL, WIDE, TEXT = 1, 2, 4  #: flags of a record


def masked(data: bytes) -> int:
    """A rotated crc32 plus a constant: a checksum of data that itself holds checksums stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = LENGTH.pack(len(payload))
    return head + CRC.pack(masked(head)) + payload + CRC.pack(masked(payload))


def frames(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each frame; raises ValueError where a checksum or the length is wrong."""
    while at < len(data):
        head = data[at : at + 8]
        if len(head) < 8 or len(data) < at + 12 or CRC.unpack_from(data, at + 8)[0] != masked(head):
            raise ValueError(f"bad length at byte {at}")
        n = LENGTH.unpack(head)[0]
        payload = data[at + 12 : at + 12 + n]
        if len(data) < at + 16 + n or CRC.unpack_from(data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"bad record at byte {at}")
        yield at, payload
        at += 16 + n


class WordIds:
    """Ids of the distinct words of a batch, from those kept or from the tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import AddedToken, Tokenizer

        self.load = lambda: Tokenizer.from_file(path)
        self.plain, self.tokenizer = None, self.load()
        self.tokenizer.no_truncation()  # whole texts, and nothing else
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.tokenizer.add_special_tokens([AddedToken(MARK, special=True, normalized=False)])
        self.mark = self.tokenizer.token_to_id(MARK)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n, self.start, self.end = (np.zeros(0, np.int32) for _ in range(4))
        self.pool, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def kept(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.n, self.start, self.end, self.pool, self.bytes))

    def tokenised(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ids of spans of data to the pool; where they begin, and how many they are. Words go to the tokenizer in
        groups with MARK between them: what stands between marks is a text of its own for it, and their id ends a word."""
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        alone = end - start > words.LONG
        for i in range(0, len(start), 4096):
            texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start[i : i + 4096].tolist(), end[i : i + 4096].tolist(), strict=True)]
            marked = any(MARK[0] in t for t in texts)
            group = 1 if marked or alone[i : i + 4096].any() else GROUP
            if marked and self.plain is None:  # rarely needed, so that a worker seldom holds two
                self.plain = self.load()
                self.plain.no_truncation()
                self.plain.no_padding()
            joined = [MARK.join(texts[k : k + group]) for k in range(0, len(texts), group)]
            ids += [np.array([*x.ids, self.mark], np.uint32) for x in (self.plain if marked else self.tokenizer).encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(ids)
        mark = flat == self.mark
        ends = np.flatnonzero(mark) - np.arange(int(mark.sum()))  # ids before each mark
        n = np.diff(ends, prepend=0)
        if len(n) != len(start):
            raise ValueError("the tokenizer lost a mark between words")
        at = ends - n + len(self.pool)
        self.pool = np.concatenate([self.pool, flat[~mark]])
        return at, n

    def look_up(self, data: np.ndarray, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word: where its ids begin in self.pool, and how many they are."""
        uniq, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if self.kept() > KEPT_BYTES:
            self.clear()
        place = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == uniq[inside]
        if not known.all():
            where = first[~known]
            s, e = w.start[where], w.end[where]
            at, n = self.tokenised(data, s, e)
            size = e - s
            begin = np.cumsum(size) - size
            flat = data[np.repeat(s - begin, size) + np.arange(int(size.sum()))]
            keys = np.concatenate([self.keys, uniq[~known]])
            order = np.argsort(keys, kind="stable")
            begin = begin + len(self.bytes)
            self.bytes = np.concatenate([self.bytes, flat])
            self.keys = keys[order]
            for name, new in (("at", at), ("n", n), ("start", begin), ("end", begin + size)):
                setattr(self, name, np.concatenate([getattr(self, name), new.astype(np.int32)])[order])
            place = np.searchsorted(self.keys, uniq)
        place = place[back]
        at, n = self.at[place].astype(np.int64), self.n[place].astype(np.int64)
        other = np.flatnonzero(~words.same(data, w.start, w.end, self.bytes, self.start[place], self.end[place]))
        if len(other):  # words that share a hash with one that is kept
            at[other], n[other] = self.tokenised(data, w.start[other], w.end[other])
        return at, n


def word_ids(path: str) -> WordIds:
    things = words.kept("records")
    if path not in things:
        things[path] = WordIds(path)
    return things[path]


def encode(texts: pa.Array, ids_of: WordIds | str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and how many each has, the end id included. Null is empty. ids_of: what
    the worker keeps, or a tokenizer's path."""
    ids_of = word_ids(ids_of) if isinstance(ids_of, str) else ids_of
    data, offsets = words.buffers(texts)
    w = words.split(data, offsets, lower=False)
    at, n = ids_of.look_up(data, w)
    end = 0 if end_id is None else 1
    each = np.bincount(w.doc, n, minlength=len(offsets) - 1).astype(np.int64) + end
    out = np.empty(int(each.sum()), np.uint32)
    total = int(n.sum())
    begin = np.cumsum(n) - n
    taken = ids_of.pool[np.repeat(at - begin, n) + np.arange(total)]
    if end:
        last = np.cumsum(each) - 1
        mask = np.ones(len(out), bool)
        mask[last] = False
        out[mask] = taken
        out[last] = end_id
    else:
        out = taken
    return out, each


def _head(doc: int | str | None, wide: bool) -> bytes:
    flags = WIDE * wide | NULL * (doc is None) | TEXT * isinstance(doc, str)
    name = doc.encode() if isinstance(doc, str) else b""
    return HEAD.pack(len(name) if name or isinstance(doc, str) else doc or 0, flags) + name


def _record(payload: bytes) -> tuple[int | str | None, np.ndarray]:
    """doc_id and token ids of a record."""
    doc, flags = HEAD.unpack_from(payload)
    at = HEAD.size
    if flags & TEXT:
        at += doc
        doc = payload[HEAD.size : at].decode()
    return None if flags & NULL else doc, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=at).astype("<u4")


def _write(rows: Iterator[pa.RecordBatch], base: str, tokenizer_path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    fs, root = store(base)
    tmp, part, before, at, n = uuid4().hex, None, 0, 0, 0
    index: list[np.ndarray] = []
    out = ids_of = None
    for batch in rows:
        for i, j in words.batches(batch["text"], 4 << 20):
            if out is None:
                part = batch["part"][0].as_py()
                out, ids_of = fs.open_output_stream(f"{root}/{tmp}.rec"), word_ids(tokenizer_path)
                wide = max(ids_of.size - 1, end_id or 0) >= 1 << 16
            ids, each = encode(batch["text"].slice(i, j - i), ids_of, end_id)
            ids = ids.astype("<u4" if wide else "<u2")
            start = 0
            block, places = [], []
            for doc, k in zip(batch["doc_id"][i:j].to_pylist(), each.tolist(), strict=True):
                block.append(x := frame(_head(doc, wide) + ids[start : start + k].tobytes()))
                places.append((at, before))
                at, before, start, n = at + len(x), before + k, start + k, n + 1
            out.write(b"".join(block))
            index.append(np.array(places, INDEX))
    if out is not None:
        out.close()
        with fs.open_output_stream(f"{root}/{tmp}.idx") as f:
            f.write(np.concatenate(index).tobytes())
        for kind in ("idx", "rec"):
            fs.move(f"{root}/{tmp}.{kind}", f"{root}/part-{part:05d}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": part, "records": n, "tokens": before, "bytes": at}], schema=pa.schema([("part", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))


def write_records(docs: DataFrame, base: str, tokenizer_path: str, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id", files: int | None = None) -> list[dict]:
    """Writes docs below base, a folder that driver and executors share, and returns the manifest, which is a row for
    each file: part, records, tokens, bytes, start (the number of tokens in the files before it), and text_ids.

    Null texts count as empty: such a record holds the end id alone. Rows that repeat an id stand next to each other,
    null ids come first. Ids that aren't whole numbers are written and ordered as text. A text of any length is one
    record. An empty table gives no file. Extra columns are ignored.
    """
    spark = docs.sparkSession
    fs, root = store(base)
    fs.create_dir(root, recursive=True)
    named = not isinstance(docs.schema[doc_id].dataType, IntegralType)
    rows = docs.select(F.col(doc_id).cast("string" if named else "long").alias("doc_id"), F.col(text).alias("text"))
    if files is None:
        size = docs.select(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0
        files = max(shuffle_parts(spark), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    # A row for each file of FILE_BYTES.
    with lean(spark):
        done = ordered.mapInArrow(lambda it: _write(it, base, tokenizer_path, end_id), "part int, records long, tokens long, bytes long").collect()
    manifest, start = [], 0
    for r in sorted(done, key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"start": start, "text_ids": named})
        start += r["tokens"]
    return manifest


def _read(parts: Iterator[pa.RecordBatch], base: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    fs, root = store(base)
    types = {"doc_id": kind, "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
    for batch in parts:
        for row in batch.to_pylist():
            with fs.open_input_stream(f"{root}/part-{row['part']:05d}.idx") as f:
                index = np.frombuffer(f.read(), INDEX)
            with fs.open_input_file(f"{root}/part-{row['part']:05d}.rec") as f:
                ends = np.append(index["offset"][1:], np.uint64(f.size())).astype(np.int64)
                i = 0
                while i < len(ends):  # a few MB of whole records at a time
                    lo = int(index["offset"][i])
                    j = max(i + 1, int(np.searchsorted(ends, lo + (4 << 20), "right")))
                    f.seek(lo)
                    got: list[tuple] = []
                    for k, (at, payload) in zip(range(i, j), frames(f.read(int(ends[j - 1]) - lo)), strict=True):
                        if at + lo != int(index["offset"][k]):
                            raise ValueError(f"the index of part {row['part']} doesn't fit record {k}")
                        doc, ids = _record(payload)
                        raw = ids.tobytes()
                        got.append((doc, row["start"] + int(index["before"][k]), len(ids), zlib.crc32(raw), raw))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True), types.values(), strict=True)], names=list(types))
                    i = j


def read_records(spark: SparkSession, base: str, manifest: list[dict]) -> DataFrame:
    """A row for each record of the files: doc_id, start, n_tokens, ids_crc32, ids (little-endian uint32). Each frame's
    checksums are verified. Files are read in tasks of their own, and no task holds more than a few MB of records."""
    rows = [(m["part"], m["start"]) for m in manifest]
    named = any(m["text_ids"] for m in manifest)
    parts = spark.createDataFrame(rows, "part int, start long").repartition(max(1, len(rows)), "part")
    return parts.mapInArrow(lambda it: _read(it, base, pa.string() if named else pa.int64()), f"doc_id {'string' if named else 'long'}, start long, n_tokens long, ids_crc32 long, ids binary")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes docs as records in the shared folder and returns what the files hold, without the ids themselves. Odd rows
    are treated as write_records() says."""
    spark = docs.sparkSession
    base = work_dir(spark, "records")
    manifest = write_records(docs, base, tokenizer_path, end_id)
    return read_records(spark, base, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
