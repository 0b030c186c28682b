"""Toxicity of texts: the noisy channel restores what is written, then a logistic model scores the restored text.

Features are words of the restored text and their beginnings, hashed to 2 ** BITS buckets; a text has a feature or not.
Which of them tell toxic texts from others (G2 statistic) and their weights are learnt from a bounded sample of the
labelled rows, which are restored as well. The character model of the channel is counted on all texts. Scoring looks at
every word of every text, once for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .channel import END, GLUE, SHORT, CharModel, PairCounter, glued, noisy, respaced, restorer, short
from .shared import fold, forget, materialise

U = np.uint64
BITS = 22
PREFIXES = (3, 4, 5, 6, 7)
#: Most labelled rows that are learnt from: about so many are drawn by a hash of their ids.
SAMPLE = 40_000
#: Most features of the model, and the least G2 that makes one.
FEATURES, LEAST_G2 = 1500, 15.0
#: Characters that the channel's model tells apart: the most frequent ones.
CHARS = 512
BATCH = 1 << 20

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(97, 123), *range(65, 91), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"@$!|+")] = True


@dataclass(frozen=True)
class Toxic:
    buckets: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float
    chars: CharModel


def _feature_hashes(lowered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Buckets of (words x features): the whole word, then its prefixes; -1 where the word is not longer."""
    out = np.full((len(start), 1 + len(PREFIXES)), -1, np.int64)
    for k, size in enumerate((0, *PREFIXES)):
        has = np.flatnonzero(end - start >= size)
        h = words.span_hashes(lowered, start[has], start[has] + size if size else end[has])
        out[has, k] = (words.mix(h ^ U(0x5851F42D4C957F2D + size)) >> U(64 - BITS)).astype(np.int64)
    return out


def _noisy(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that may need decoding: they mix letters with other characters, hold a run of three, or have signs and no
    letter; a superset."""
    plain = np.concatenate([[0], np.cumsum(_PLAIN[data])])
    letters, n = plain[end] - plain[start], end - start
    triple = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        triple[3:] = np.cumsum((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _PLAIN[data[2:]])
        triple[1:3] = 0
    runs = np.where(n > 2, triple[end] - triple[np.minimum(start + 2, len(data))], 0)
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    return ((letters > 0) & (letters < n)) | (runs > 0) | ((letters == 0) & (n > 2) & (signs[end] > signs[start]))


def _trim(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the signs at their ends."""
    keep = _PLAIN[data] | ((data >= 48) & (data < 58))
    some = np.concatenate([[0], np.cumsum(keep)])
    at = np.flatnonzero(keep)
    lo, hi = some[start], some[end]
    none = lo == hi
    at = at if len(at) else np.zeros(1, np.int64)
    return np.where(none, start, at[np.minimum(lo, len(at) - 1)]), np.where(none, end, at[np.maximum(hi - 1, 0)] + 1)


_bare = lru_cache(50_000)(short)


def _unspaced(data: np.ndarray, w: words.Words, start: np.ndarray, end: np.ndarray, back: np.ndarray, restored) -> tuple[list[tuple[int, str]], np.ndarray]:
    """(row, word) of the words that runs of short tokens spell, and which tokens they stand for.

    Between letters that are certain, the lattice's choice depends on the two letters next to the space alone, so one
    look at each pair of letters decides; runs with look-alikes or single characters in a row are decoded. Where three or
    more of those follow each other, bigrams tell little of where a word begins, so each place of what is decoded
    gives the beginnings of a word, as if a space stood before it.
    """
    model: CharModel = restored.model
    lo, hi = _trim(data, start, end)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bare = [""] * len(start)
    for i in np.flatnonzero(chars[hi] - chars[lo] <= SHORT).tolist():
        bare[i] = _bare(data[start[i] : end[i]].tobytes().decode("utf-8", "replace").lower())
    size = np.array([len(b) for b in bare], np.int64)[back] if len(bare) else np.zeros(0, np.int64)
    at = np.flatnonzero(size > 0)
    gone = np.zeros(len(back), bool)
    if len(at) < 2:
        return [], gone
    first, last = (np.array([ord(b[k]) if b else 0 for b in bare], np.int64)[back] for k in (0, -1))
    sure = np.array([b.isalpha() for b in bare], bool)[back]
    runs = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(w.doc[at]) != 0)) + 1, [len(at)]])
    run_of = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
    inner = np.flatnonzero(run_of[1:] == run_of[:-1])  # places in `at` before a space within a run
    left, right = at[inner], at[inner + 1]
    single = (size[left] == 1) & (size[right] == 1)
    unsure = np.bincount(run_of[~sure[at]], minlength=len(runs) - 1) > 0
    letters = np.bincount(run_of[sure[at] | (size[at] > 1)], minlength=len(runs) - 1) > 0
    hard = (unsure | (np.bincount(run_of[inner[single]], minlength=len(runs) - 1) > 1)) & letters & (np.diff(runs) > 1)
    out: set[tuple[int, str]] = set()
    easy = ~(hard | unsure)[run_of[inner]]
    left, right, inner, single = left[easy], right[easy], inner[easy], single[easy]
    kinds, which = np.unique((last[left] << 22) | (first[right] << 1) | single, return_inverse=True)
    joins = np.array([glued(chr(k >> 22), chr((k >> 1) & 0x1FFFFF), 0.0 if k & 1 else GLUE, model) for k in kinds.tolist()], bool)[which]
    ends = inner[joins]
    for piece in np.split(ends, np.flatnonzero(np.diff(ends) != 1) + 1) if len(ends) else ():
        out.add((int(w.doc[at[piece[0]]]), "".join(bare[back[j]] for j in at[piece[0] : piece[-1] + 2].tolist())))
        gone[at[piece[0] : piece[-1] + 2]] = True
    reach = PREFIXES[-1]
    for r in np.flatnonzero(hard).tolist():
        tokens = [bare[i] for i in back[at[runs[r] : runs[r + 1]]].tolist()]
        doc = int(w.doc[at[runs[r]]])
        out.update((doc, x) for x in respaced(tuple(tokens), model))
        gone[at[runs[r] : runs[r + 1]]] = True
        for one, group in groupby(tokens, lambda t: len(t) == 1):
            spelled = "".join(group) if one else ""
            if len(spelled) > 2 and any(c.isalpha() for c in spelled):
                whole = restored(spelled) if noisy(spelled) else spelled
                out.add((doc, whole))
                out.update((doc, whole[k : k + reach]) for k in range(len(whole) - PREFIXES[0] + 1))
    return list(out), gone


def doc_features(texts: pa.Array, restored) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs, distinct: every feature of the words of the restored texts, or of the texts as they are
    written if restored is None."""
    data, offsets = words.buffers(texts)
    w = words.split(data, offsets)
    uniq, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    gone = np.zeros(len(w.hash), bool)  # words that others stand for in the restored text
    extra: list[tuple[int, str]] = []
    if restored is not None:
        decoded = {}
        for i in np.flatnonzero(_noisy(data, start, end)).tolist():
            word = data[start[i] : end[i]].tobytes().decode("utf-8", "replace").lower()
            if (out := restored(word)) != word and out:
                decoded[i] = out
        spelled, gone = _unspaced(data, w, start, end, back, restored)
        if decoded:
            at = np.flatnonzero(np.isin(back, np.array(sorted(decoded))) & ~gone)
            extra += [(int(w.doc[j]), decoded[int(back[j])]) for j in at]
            gone[at] = True
        extra = sorted({*extra, *spelled})
    feats = _feature_hashes(words.LOWER[data], *_trim(data, start, end))
    stay = ~gone
    pairs = [np.stack([np.repeat(w.doc[stay], feats.shape[1]).astype(np.int64), feats[back[stay]].ravel()])]
    if extra:
        coded = [x.encode() for _, x in extra]
        ends = np.cumsum([len(x) for x in coded])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        more = _feature_hashes(raw, *_trim(raw, ends - [len(x) for x in coded], ends))
        pairs.append(np.stack([np.repeat([d for d, _ in extra], more.shape[1]).astype(np.int64), more.ravel()]))
    row, bucket = np.concatenate(pairs, axis=1)
    keys = np.unique((row[bucket >= 0] << BITS) | bucket[bucket >= 0])
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words.kept("toxicity")
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            yield batch.slice(i, j - i)


def _pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character bigrams of a task's texts: a row for each distinct one."""
    count = PairCounter()
    for part in _pieces(rows):
        data, offsets = words.buffers(part["text"])
        if len(data):
            count.add(b"\n".join(data[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)).decode("utf-8", "replace"))
    a, b, n = zip(*count.rows(), strict=True) if count.rows() else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def char_model(docs: DataFrame, chars: int = CHARS) -> CharModel:
    """Bigrams of the `chars` most frequent characters, counted on all texts; others are unknown characters to the model."""
    pairs = materialise(docs.select("text").mapInArrow(_pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "characters")
    top = [r["b"] for r in pairs.where(F.col("b") != END).groupBy("b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "b").limit(chars).collect()]
    known = [*top, END]
    # At most (chars + 1) squared rows.
    counts = {(r["a"], r["b"]): r["n"] for r in pairs.where(F.col("a").isin(known) & F.col("b").isin(known)).collect()}
    forget(pairs)
    return CharModel(counts)


def _featured(rows: Iterator[pa.RecordBatch], chars: CharModel) -> Iterator[pa.RecordBatch]:
    restored = restorer(chars)
    for part in _pieces(rows):
        row, bucket = doc_features(part["text"], restored)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part["label"], pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["label", "features"])


def g2(toxic: Column, seen: Column, n_toxic: int, n: int) -> Column:
    """Likelihood ratio statistic of a feature's presence against the label: toxic of the `seen` rows that have it are
    among the n_toxic of all n rows."""
    out = F.lit(0.0)
    for got, have, size in ((toxic, seen, n_toxic), (seen - toxic, seen, n - n_toxic), (n_toxic - toxic, n - seen, n_toxic), (n - n_toxic - seen + toxic, n - seen, n - n_toxic)):
        out += F.when(got > 0, 2 * got * F.log(got * F.lit(float(n)) / (have * F.lit(float(size))))).otherwise(0.0)
    return out


def logistic(x: list[np.ndarray], y: np.ndarray, n: int, steps: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows, with an L2 term. x: the features that each row has."""
    row = np.repeat(np.arange(len(x)), [len(f) for f in x])
    col = np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    w = np.zeros(n + 1)
    w[n] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(x)) + w[n], -30, 30)))
        d = (p - y) / len(y)
        g = np.append(np.bincount(col, d[row], n) + decay * w[:n] / n, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:n], float(w[n])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Toxic | None:
    """docs: doc_id, text; labels: doc_id, label. About `sample` of the labelled rows are learnt from, or all if there
    are fewer. None if one of the two labels is missing."""
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    drawn = labels.where(part < min(1 << 30, (sample << 30) // max(n, 1))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most about `sample` rows of two numbers: bounded by that parameter.
    rows = materialise(docs.join(F.broadcast(drawn), "doc_id").select("text", "label"), "toxic-sample")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return None
    chars = char_model(docs)
    feats = materialise(rows.mapInArrow(lambda it: _featured(it, chars), "label int, features array<int>"), "toxic-features")
    forget(rows)
    counts = feats.select("label", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("seen"))
    stat = counts.select("bucket", g2(F.col("toxic"), F.col("seen"), n_toxic, n_toxic + n_clean).alias("g2"))
    best = stat.where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "bucket").limit(FEATURES).collect()
    buckets = np.array(sorted(r["bucket"] for r in best), np.int64)
    if not len(buckets):
        return Toxic((), (), float(np.log(n_toxic / n_clean)), chars)
    seen = feats.select("label", F.filter("features", lambda x: x.isin(buckets.tolist())).alias("features")).collect()
    forget(feats)
    seen.sort(key=lambda r: (r["label"], r["features"]))  # sums of weights are the same whatever order the rows came in
    x = [np.searchsorted(buckets, np.array(r["features"], np.int64)) for r in seen]
    weights, bias = logistic(x, np.array([r["label"] for r in seen], float), len(buckets))
    return Toxic(tuple(buckets.tolist()), tuple(weights.tolist()), bias, chars)


def _score(rows: Iterator[pa.RecordBatch], model: Toxic | None) -> Iterator[pa.RecordBatch]:
    if model is not None:
        buckets, weights = np.array(model.buckets, np.int64), np.array(model.weights)
        restored = restorer(model.chars)
    for part in _pieces(rows):
        logit = np.full(len(part), model.bias if model else -30.0)
        if model and len(buckets):
            row, bucket = doc_features(part["text"], restored)
            at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
            hit = buckets[at] == bucket
            logit += np.bincount(row[hit], weights[at[hit]], len(part))
        yield pa.RecordBatch.from_arrays([*(part[c] for c in part.schema.names if c != "text"), pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], names=[*(c for c in part.schema.names if c != "text"), "score"])


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", label_id: str = "doc_id", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Labels are learnt from rows whose crc32(doc_id as text) mod folds isn't 0; null labels and ids are left out, and an
    id with several labels counts as toxic if one says so. Null and empty texts get the score of a text without words.
    Without labels of both kinds every score is 0. Very long texts are scored whole. Ids may repeat or be null. An empty
    table gives an empty result. Extra columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), folds) == 0).alias("held_out"), F.col(text).alias("text"))
    model = learn(rows.select("doc_id", "text"), _known(labels, label, label_id, folds), sample)
    return rows.mapInArrow(lambda it: _score(it, model), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _known(labels: DataFrame, label: str, label_id: str, folds: int) -> DataFrame:
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.where((fold(F.col("doc_id"), folds) != 0) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())


def _clean(rows: Iterator[pa.RecordBatch], model: Toxic | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for part in _pieces(rows):
        scored = next(_score(iter([part.select(["text"])]), model))
        kept = part.filter(pa.array(scored["score"].to_numpy() < threshold))
        if len(kept):
            yield kept


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", label_id: str = "doc_id", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text and any others) whose score, as toxicity() gives it, is below threshold, with all
    their columns whatever these are called. Nulls, empty and very long texts, repeated rows and tables without labels
    are scored as toxicity() says; rows that share an id or a text are judged each by its own text. An empty table gives
    an empty result.
    """
    model = learn(docs.select("doc_id", "text"), _known(labels, label, label_id, folds), sample)
    return docs.mapInArrow(lambda it: _clean(it, model, threshold), docs.schema)
