"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

A model is a folder in the shared store:

    words-S.hash   sorted uint64 hashes of the training tokens in the S-th range of hashes; a token's id is its place
                   among all ranges
    words-S.count  int64 counts; words-S.stat: four uint32 arrays, n1 n2 n3 (continuations that follow the token once,
                   twice, more often) and a (distinct tokens before it)
    pairs-S.key    sorted uint64 keys (id << 32 | id) of the bigrams whose mixed key is in the S-th range; pairs-S.count

Counting is an exchange of blocks: a task counts a batch in numpy and sends each owner of a range one Golomb-coded
block, so that a common token or bigram costs one entry from each batch. Owners merge their blocks and write arrays.
The number of ranges follows the input, so an owner's arrays have a bounded size. All documents count; nothing is cut
off or pruned. The driver holds one row for each range and a few totals.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb, words
from .shared import fold, shuffle_parts, store, work_dir

U = np.uint64
END = U(0xE5D0F7A3C1B29684)  #: hash of the token after a text's last word
#: Bytes of text for each range, on average.
RANGE_BYTES = 16 << 20
BATCH = 6 << 20


@dataclass(frozen=True)
class Model:
    base: str
    ranges: int
    first: tuple[int, ...]  #: id of the first token of each range, and the number of ids
    tokens: int  #: N
    docs: int
    pairs: int
    d_pair: tuple[float, float, float]
    d_word: tuple[float, float, float]
    lower: float  #: mass of the unigram level that goes to the uniform one, times pairs

    @property
    def vocabulary(self) -> int:
        return self.first[-1]


def _range_of(mixed: np.ndarray, ranges: int) -> np.ndarray:
    return ((mixed >> U(32)) * U(ranges)) >> U(32)


def _save(base: str, name: str, *arrays: np.ndarray) -> None:
    fs, root = store(base)
    tmp = f"{root}/{uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    fs.move(tmp, f"{root}/{name}")


_OPEN: dict[str, np.ndarray] = {}


def _load(base: str, name: str, kind: type) -> np.ndarray:
    """A memory map, once per worker; where the store is no mounted folder, the array is read into memory."""
    if (key := f"{base}/{name}") not in _OPEN:
        if len(_OPEN) > 4096 or any(not k.startswith(base) for k in _OPEN):
            _OPEN.clear()
        fs, root = store(base)
        if fs.get_file_info(f"{root}/{name}").size in (0, None):
            _OPEN[key] = np.zeros(0, kind)
        elif isinstance(fs, pyarrow.fs.LocalFileSystem):
            _OPEN[key] = np.memmap(f"{root}/{name}", kind, "r")
        else:
            with fs.open_input_stream(f"{root}/{name}") as f:
                _OPEN[key] = np.frombuffer(f.read(), kind)
    return _OPEN[key]


def tokens(texts: pa.Array, train: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text followed by END, and how many tokens each text has. train: only
    these rows count; the others have no tokens at all."""
    if train is not None:
        texts = texts.filter(pa.array(train))
    data, offsets = words.buffers(texts)
    w = words.split(data, offsets)
    each = w.counts + 1
    out = np.empty(len(w.hash) + len(each), U)
    last = np.cumsum(each) - 1
    mask = np.ones(len(out), bool)
    mask[last] = False
    out[mask] = w.hash
    out[last] = END
    return out, each


def _blocks(kind: int, keys: np.ndarray, counts: np.ndarray, ranges: np.ndarray, universe: int, low: int = 0) -> list[dict]:
    order = np.argsort(ranges, kind="stable")
    keys, counts, ranges = keys[order], counts[order], ranges[order]
    out = []
    for r in np.unique(ranges):
        i, j = np.searchsorted(ranges, r), np.searchsorted(ranges, r, "right")
        out.append({"kind": kind, "range": int(r), "keys": golomb.encode(keys[i:j], universe), "counts": pa.compress(counts[i:j].astype("<u8").tobytes(), "zstd", asbytes=True), "n": int(j - i)})
    return out


BLOCK = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])
BLOCK_DDL = "kind int, range int, keys binary, counts binary, n long"


def _counts(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), "<u8").astype(np.int64)


def _merged(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([golomb.decode(b) for b in blocks["keys"]])
    counts = np.concatenate([_counts(b, n) for b, n in zip(blocks["counts"], blocks["n"], strict=True)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            part = batch.slice(i, j - i)
            yield part, part["train"].to_numpy(zero_copy_only=False).astype(bool)


def count_words(rows: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    total: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in total])
        uniq, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c in total]), len(uniq)).astype(np.int64)
        total.clear()
        return pa.RecordBatch.from_pylist(_blocks(0, uniq, counts, _range_of(uniq, ranges), 1 << 64), BLOCK)

    for part, train in _pieces(rows):
        h, _ = tokens(part["text"], train)
        total.append(np.unique(h, return_counts=True))
        if sum(len(k) for k, _ in total) > 2_000_000:
            yield out()
    if total:
        yield out()


def store_words(key: tuple, blocks: pd.DataFrame, base: str) -> pd.DataFrame:
    keys, counts = _merged(blocks)
    _save(base, f"words-{key[0]}.hash", keys)
    _save(base, f"words-{key[0]}.count", counts)
    docs = int(counts[keys == END].sum())
    return pd.DataFrame({"range": [key[0]], "n": [len(keys)], "tokens": [int(counts.sum())], "docs": [docs]})


def ids(base: str, ranges: int, first: tuple[int, ...], hashes: np.ndarray) -> np.ndarray:
    """Ids of sorted hashes; those that no training text holds get the number of ids."""
    out = np.full(len(hashes), first[-1], np.int64)
    own = _range_of(hashes, ranges)
    for r in np.unique(own):
        i, j = np.searchsorted(own, r), np.searchsorted(own, r, "right")
        table = _load(base, f"words-{r}.hash", U)
        if len(table):
            at = np.searchsorted(table, hashes[i:j])
            at[at == len(table)] = 0
            hit = table[at] == hashes[i:j]
            out[i:j][hit] = first[r] + at[hit]
    return out


def pair_keys(model_base: str, ranges: int, first: tuple[int, ...], h: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left id, right id) of each token, and the distinct tokens' ids by place. The left id of a text's first token is
    the number of ids plus 1, which stands for its beginning."""
    uniq, back = np.unique(h, return_inverse=True)
    own = ids(model_base, ranges, first, uniq)[back]
    left = np.empty(len(own), np.int64)
    left[1:] = own[:-1]
    left[np.cumsum(each) - each] = first[-1] + 1
    return left, own, (left.astype(U) << U(32)) | own.astype(U)


def count_pairs(rows: Iterator[pa.RecordBatch], base: str, ranges: int, first: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for part, train in _pieces(rows):
        h, each = tokens(part["text"], train)
        if len(h):
            keys, counts = np.unique(pair_keys(base, ranges, first, h, each)[2], return_counts=True)
            yield pa.RecordBatch.from_pylist(_blocks(1, keys, counts, _range_of(words.mix(keys), ranges), (first[-1] + 2) << 32), BLOCK)


def _by_range(kind: int, own: np.ndarray, counts: np.ndarray, first: tuple[int, ...]) -> list[dict]:
    keep = own < first[-1]
    own, counts = own[keep], counts[keep]
    return _blocks(kind, own.astype(U), counts, np.searchsorted(first, own, "right") - 1, first[-1] + 2) if len(own) else []


def store_pairs(key: tuple, blocks: pd.DataFrame, base: str, first: tuple[int, ...]) -> pd.DataFrame:
    """Writes the range's arrays; returns blocks of what its bigrams tell of tokens (kinds 1 to 4: n1, n2, n3, a), of
    the text's beginning (kind 5) and of how often counts occur (kind 6), the last two for range -1."""
    keys, counts = _merged(blocks)
    _save(base, f"pairs-{key[0]}.key", keys)
    _save(base, f"pairs-{key[0]}.count", counts)
    left, right = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64)
    rows = []
    level = np.minimum(counts, 3)
    for k in (1, 2, 3):
        own, n = np.unique(left[level == k], return_counts=True)
        rows += _by_range(k, own, n, first)
    own, n = np.unique(right, return_counts=True)
    rows += _by_range(4, own, n, first)
    begin = np.bincount(level[left == first[-1] + 1], minlength=4)[1:4]
    often = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
    for kind, values in ((5, begin), (6, np.append(often, len(keys)))):
        rows += _blocks(kind, np.arange(len(values), dtype=U), values, np.full(len(values), -1), len(values))
    return pd.DataFrame(rows, columns=BLOCK.names)


def store_stats(key: tuple, blocks: pd.DataFrame, base: str, first: tuple[int, ...]) -> pd.DataFrame:
    """kind, v: of range -1 the sums of kinds 5 and 6; of other ranges how many tokens have a = 1, 2, 3, 4, and 1 to 3+."""
    r = key[0]
    if r < 0:
        out = []
        for kind, part in blocks.groupby("kind"):
            keys, counts = _merged(part)
            v = np.zeros(5, np.int64)
            v[keys.astype(np.int64)] = counts
            out.append((int(kind), v.tolist()))
        return pd.DataFrame(out, columns=["kind", "v"])
    stat = np.zeros((4, first[r + 1] - first[r]), np.uint32)
    for kind, part in blocks.groupby("kind"):
        keys, counts = _merged(part)
        stat[int(kind) - 1, keys.astype(np.int64) - first[r]] = counts
    _save(base, f"words-{r}.stat", stat)
    a = np.bincount(np.minimum(stat[3], 5), minlength=6)
    return pd.DataFrame([(7, [*a[1:5].tolist(), int(a[3:].sum())])], columns=["kind", "v"])


def offsets(sizes: list[int]) -> tuple[int, ...]:
    """First id of each range, then the number of ids. A bigram's key holds two ids of 32 bits, and so do the numbers of
    a token's neighbours: a larger vocabulary is an error."""
    first = tuple(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(int).tolist())
    if first[-1] + 2 > 1 << 32:
        raise ValueError(f"{first[-1]} distinct tokens are more than ids of 32 bits can tell apart")
    return first


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams occur once to four times; kept between 0 and the count where data are few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 0.5) for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))


def train(docs: DataFrame, size: int) -> Model:
    """docs: text, train. size: bytes of all texts."""
    spark = docs.sparkSession
    base = work_dir(spark, "kneser-ney")
    fs, root = store(base)
    fs.create_dir(root, recursive=True)
    ranges = max(shuffle_parts(spark), -(-size // RANGE_BYTES))
    blocks = docs.mapInArrow(lambda it: count_words(it, ranges), BLOCK_DDL)
    got = blocks.groupBy("range").applyInPandas(lambda k, b: store_words(k, b, base), "range int, n long, tokens long, docs long").collect()
    n = {r["range"]: r["n"] for r in got}
    first = offsets([n.get(r, 0) for r in range(ranges)])
    for r in range(ranges):
        if r not in n:
            _save(base, f"words-{r}.hash", np.zeros(0, U))
            _save(base, f"words-{r}.count", np.zeros(0, np.int64))
    pairs = docs.mapInArrow(lambda it: count_pairs(it, base, ranges, first), BLOCK_DDL)
    stats = pairs.groupBy("range").applyInPandas(lambda k, b: store_pairs(k, b, base, first), BLOCK_DDL)
    sums = {5: np.zeros(5, int), 6: np.zeros(5, int), 7: np.zeros(5, int)}
    for r in stats.groupBy("range").applyInPandas(lambda k, b: store_stats(k, b, base, first), "kind int, v array<long>").collect():
        sums[r["kind"]] = sums[r["kind"]] + np.array(r["v"])
    d_pair, d_word = discounts(sums[6][:4].tolist()), discounts(sums[7][:4].tolist())
    lower = d_word[0] * sums[7][0] + d_word[1] * sums[7][1] + d_word[2] * sums[7][4]
    n_docs = sum(r["docs"] for r in got)
    model = Model(base, ranges, first, sum(r["tokens"] for r in got), n_docs, int(sums[6][4]), d_pair, d_word, float(lower))
    _save(base, "begin", np.append(sums[5][:3], n_docs).astype(np.int64))
    return model


def _discount(d: tuple[float, float, float], counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def log_probs(model: Model, h: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: its count in training, and log10 of its probability after the token before it."""
    left, right, keys = pair_keys(model.base, model.ranges, model.first, h, each)
    v = model.vocabulary
    uniq, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    count, stat = np.zeros(len(uniq), np.int64), np.zeros((4, len(uniq)), np.int64)
    own = np.searchsorted(model.first, uniq, "right") - 1
    for r in np.unique(own[uniq < v]):
        i, j = np.searchsorted(own, r), min(np.searchsorted(own, r, "right"), np.searchsorted(uniq, v))
        at = uniq[i:j] - model.first[r]
        count[i:j] = _load(model.base, f"words-{r}.count", np.int64)[at]
        s = _load(model.base, f"words-{r}.stat", np.uint32)
        s = s.reshape(4, -1)
        stat[:, i:j] = s[:, at]
    begin = _load(model.base, "begin", np.int64)
    stat[:3, uniq == v + 1] = begin[:3, None]
    count[uniq == v + 1] = begin[3]
    x, w = back[: len(left)], back[len(left) :]
    a = stat[3][w]
    lower = (np.maximum(a - _discount(model.d_word, a), 0) + model.lower / (v + 1)) / model.pairs if model.pairs else np.full(len(w), 1 / (v + 1))
    pairs, pair_back = np.unique(keys, return_inverse=True)
    pair_count = np.zeros(len(pairs), np.int64)
    own = _range_of(words.mix(pairs), model.ranges)
    order = np.argsort(own, kind="stable")
    for r in np.unique(own):
        some = order[np.searchsorted(own[order], r) : np.searchsorted(own[order], r, "right")]
        table = _load(model.base, f"pairs-{r}.key", U)
        if len(table):
            at = np.searchsorted(table, pairs[some])
            at[at == len(table)] = 0
            hit = table[at] == pairs[some]
            pair_count[some[hit]] = _load(model.base, f"pairs-{r}.count", np.int64)[at[hit]]
    c, context = pair_count[pair_back], count[x]
    mass = (np.array(model.d_pair)[:, None] * stat[:3][:, x]).sum(axis=0)
    p = np.where(context > 0, (np.maximum(c - _discount(model.d_pair, c), 0) + mass * lower) / np.maximum(context, 1), lower)
    return count[w], np.log10(p)


def score_rows(rows: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part, _ in _pieces(rows):
        h, each = tokens(part["text"])
        c, logs = log_probs(model, h, each)
        doc = np.repeat(np.arange(len(each)), each)
        base = np.log10((c + 1) / (model.tokens + model.vocabulary + 1))
        cols = [part["doc_id"], part["held_out"], pa.array(each), pa.array(np.bincount(doc, c > 0, len(each)).astype(np.int64)), pa.array(np.full(len(each), model.tokens)), pa.array(np.bincount(doc, base, len(each))), pa.array(np.bincount(doc, logs, len(each)))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def lm_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows whose crc32(doc_id as text) mod folds isn't held_out, and scores all. Tokens: white-space words
    with A-Z in lower case, then one end. A null or empty text has the end alone; a null id counts as an empty one. A
    text of any length is scored whole; repeated rows count as often as they stand there. Without training rows every
    token has the probability 1. An empty table gives an empty result. Extra columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(doc_id), folds) == held_out).alias("held_out"))
    size = docs.select(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0
    model = train(rows.select("text", (~F.col("held_out")).alias("train")), size)
    both = rows.withColumn("train", F.lit(True))
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.mapInArrow(lambda it: score_rows(it, model), ddl).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
