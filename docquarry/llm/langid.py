"""Language of texts by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes. A window's bytes, in CLASSES classes, are embedded; filters of several
widths slide over them, each filter keeps its maximum, and a softmax layer turns the maxima into languages. The windows
of a text vote with the mean of their log-odds, weighted by their bytes; every byte of a text is in one window.

Applied, the network runs on tables: a filter of width 2 has one value for each pair of classes, so that embedding and
convolution are one look-up; wider filters are sums of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import fold

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16  #: of each width
EMBED = 8
#: Most windows that are learnt from; about as many documents are drawn, by a hash of their ids, as give so many.
SAMPLE = 24_000
PER_DOC = 3
UNKNOWN = "und"
BATCH = 2 << 20

# Classes: a-z in either case, white space, digits, other ASCII, and each byte from 128 on.
CLASS = np.full(256, 28, np.int64)
CLASS[97:123] = CLASS[65:91] = np.arange(26)
CLASS[[32, *range(9, 14)]] = 26
CLASS[48:58] = 27
CLASS[128:] = 29 + np.arange(128)
CLASSES = 157
PAD = 26  #: white space


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first: (pairs, all filters), what a filter's first two bytes give; third: (classes, filters of width 3), what
        their last byte gives; last: (pairs, filters of width 4), what their last two give."""
        e = self.embed
        part = {w: [e @ self.filters[w][k * EMBED : (k + 1) * EMBED] for k in range(w)] for w in WIDTHS}
        two = lambda x, y: (x[:, None, :] + y[None, :, :]).reshape(CLASSES * CLASSES, -1)
        first = np.concatenate([two(part[w][0], part[w][1]) for w in WIDTHS], axis=1).astype(np.float32)
        return first, part[3][2].astype(np.float32), two(part[4][2], part[4][3]).astype(np.float32)


def _forward(net: Net, x: np.ndarray) -> tuple[np.ndarray, dict]:
    e = net.embed[x]
    maxima, places = [], {}
    for w in WIDTHS:
        n = x.shape[1] - w + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(w)], axis=2)
        y = cols @ net.filters[w]
        places[w] = y.argmax(axis=1)
        maxima.append(np.take_along_axis(y, places[w][:, None, :], 1)[:, 0])
    h = np.maximum(np.concatenate(maxima, axis=1) + net.bias, 0)
    return h @ net.out + net.out_bias, {"h": h, "places": places, "e": e}


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 7) -> Net:
    """Trains on windows x (classes of bytes) with labels y, by Adam on the cross-entropy."""
    r = np.random.default_rng(seed)
    k = FILTERS * len(WIDTHS)
    p = {"embed": r.normal(0, 0.3, (CLASSES, EMBED)), "bias": np.zeros(k), "out": r.normal(0, 0.1, (k, len(langs))), "out_bias": np.zeros(len(langs))}
    p |= {f"f{w}": r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS}
    p = {a: b.astype(np.float32) for a, b in p.items()}
    m, v, t = {a: np.zeros_like(b) for a, b in p.items()}, {a: np.zeros_like(b) for a, b in p.items()}, 0
    net = lambda: Net(langs, p["embed"], {w: p[f"f{w}"] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"])
    for _ in range(epochs):
        order = r.permutation(len(x))
        for i in range(0, len(x), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            logits, kept = _forward(net(), xb)
            z = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            h = kept["h"]
            g = {"out": h.T @ d, "out_bias": d.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            dh = (d @ p["out"].T) * (h > 0)
            g["bias"] = dh.sum(axis=0)
            for q, w in enumerate(WIDTHS):
                dw = dh[:, q * FILTERS : (q + 1) * FILTERS]
                at = kept["places"][w]
                rows = np.arange(len(xb))[:, None, None]
                span = at[:, :, None] + np.arange(w)
                cols = kept["e"][rows, span].reshape(len(xb), FILTERS, w * EMBED)
                g[f"f{w}"] = np.einsum("bf,bfc->cf", dw, cols)
                back = (dw[:, :, None] * p[f"f{w}"].T[None]).reshape(-1, EMBED)
                np.add.at(g["embed"], xb[rows, span].ravel(), back)
            t += 1
            for a in p:
                m[a] = 0.9 * m[a] + 0.1 * g[a]
                v[a] = 0.999 * v[a] + 0.001 * g[a] ** 2
                p[a] = (p[a] - rate * (m[a] / (1 - 0.9**t)) / (np.sqrt(v[a] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net()


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW classes, row of each, bytes of each): every byte of each text once, the last window padded."""
    size = np.diff(offsets)
    each = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), each)
    k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    weight = np.minimum(WINDOW, size[row] - k * WINDOW)
    out = np.full((len(row), WINDOW), PAD, np.int64)
    within = np.arange(len(data)) - offsets[:-1][np.repeat(np.arange(len(size)), size)]
    first = (np.cumsum(each) - each)[np.repeat(np.arange(len(size)), size)]
    out[first + within // WINDOW, within % WINDOW] = CLASS[data]
    return out, row, weight


def log_odds(net: Net, tables: tuple[np.ndarray, ...], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x languages): mean logits of a text's windows, by bytes; zeros for a text without bytes."""
    first, third, last = tables
    x, row, weight = windows(data, offsets)
    total = np.zeros((len(offsets) - 1, len(net.langs)))
    for i in range(0, len(x), 512):
        some = x[i : i + 512]
        pairs = some[:, :-1] * CLASSES + some[:, 1:]
        y = first[pairs]
        y[:, : WINDOW - 2, FILTERS : 2 * FILTERS] += third[some[:, 2:]]
        y[:, : WINDOW - 3, 2 * FILTERS :] += last[pairs[:, 2:]]
        y[:, WINDOW - 2 :, FILTERS : 2 * FILTERS] = -np.inf
        y[:, WINDOW - 3 :, 2 * FILTERS :] = -np.inf
        h = np.maximum(y.max(axis=1) + net.bias, 0)
        logits = h @ net.out + net.out_bias
        np.add.at(total, row[i : i + 512], logits * weight[i : i + 512, None])
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _drawn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to PER_DOC windows of each text, evenly spread over it."""
    for batch in rows:
        out: dict[str, list] = {"lang": [], "window": []}
        for i, j in words.batches(batch["text"], BATCH):
            data, offsets = words.buffers(batch["text"].slice(i, j - i))
            for k, lang in enumerate(batch["lang"][i:j].to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                n = -(-len(text) // WINDOW)
                for at in sorted({(n - 1) * q // max(1, PER_DOC - 1) for q in range(PER_DOC)}) if n else []:
                    out["lang"].append(lang)
                    out["window"].append(text[at * WINDOW : (at + 1) * WINDOW].tobytes())
        yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("window", pa.binary())]))


def learn(docs: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Net | None:
    """docs: doc_id, text, lang. None if no row has a language and a text."""
    known = docs.where("lang is not null and text is not null and length(text) > 0")
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    # About sample / PER_DOC rows are drawn, of which PER_DOC windows of a fixed size reach the driver.
    drawn = known.where(part < min(1 << 30, (sample // PER_DOC << 30) // max(n, 1))).select("text", "lang")
    got = drawn.mapInArrow(_drawn, "lang string, window binary").collect()
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    x = np.full((len(got), WINDOW), PAD, np.int64)
    for i, r in enumerate(got):
        b = np.frombuffer(bytes(r["window"]), np.uint8)
        x[i, : len(b)] = CLASS[b]
    y = np.array([langs.index(r["lang"]) for r in got])
    order = np.lexsort((y, *x.T))  # whatever order the rows came in; rows that are still equal are the same
    return fit(x[order], y[order], langs)


def _apply(rows: Iterator[pa.RecordBatch], net: Net | None) -> Iterator[pa.RecordBatch]:
    tables = net.tables() if net else None
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            part = batch.slice(i, j - i)
            letters = part["letters"].to_numpy(zero_copy_only=False).astype(bool)
            if net is None:
                lang, score = [UNKNOWN] * len(part), np.zeros(len(part))
            else:
                z = log_odds(net, tables, *words.buffers(part["text"]))
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                lang = [net.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(doc_id as text) mod folds isn't 0 and whose language isn't null. lang_pred is `und`,
    with score 0, for texts that are null or have no letter, and for all if nothing can be learnt. Very long texts are
    taken whole. Equal texts get equal results; of equally likely languages the first by name is taken. An empty table
    gives an empty result. Extra columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(doc_id), folds) == 0).alias("held_out"), F.col(lang).cast("string").alias("lang"))
    net = learn(rows.where(~F.col("held_out")), sample)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    ready = rows.select("doc_id", "held_out", "text", letters.alias("letters"))
    return ready.mapInArrow(lambda it: _apply(it, net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
