"""Quality by neighbours against brute force: terms, cosines and votes in plain loops; nulls, ties, repeated rows."""

import math
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.llm import neighbours, queries, words
from docquarry.llm.neighbours import BUCKETS, Neighbours, decompose, latent, learn, quality, terms, votes
from tests.llm.test_operators import DDL, ROWS

TEXTS = [None, "", " \n ", "one", "One one ONE one x", "a b\x0bc", "Ünï ünï! 12-34 A1b2", "w" * 3000 + " end", "x " * 3000, "!! ?? !! ##", "same same same same same same other other"]


def term_names(text):
    """The terms of a text under names of their own, by definition."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in w]
    kind = lambda b: "a" if 97 <= b < 123 or b > 127 else "A" if 65 <= b < 91 else "0" if 48 <= b < 58 else chr(b)
    shape = ["".join(k for k, _ in groupby(map(kind, x.encode()))) for x in w]
    out = [("word", x) for x in low] + [("shape", s) for s in shape] + [("pair", *p) for p in zip(shape, shape[1:], strict=False)]
    run = 0
    for a, b in zip(low, low[1:], strict=False):
        run = run + 1 if a == b else 0
        if run:
            out.append(("again", int(math.log2(run))))
    return Counter(out)


def test_terms_are_those_of_the_definition():
    """Counts of each name's bucket agree over all texts at once, with sums where names share a bucket."""
    where = {}
    row, bucket, count = terms(pa.array(TEXTS))
    got = [Counter({b: c for r, b, c in zip(row.tolist(), bucket.tolist(), count.tolist(), strict=True) if r == i}) for i in range(len(TEXTS))]
    for name in {n for t in TEXTS for n in term_names(t)}:
        where[name] = bucket_of(name)
    for i, t in enumerate(TEXTS):
        want = Counter()
        for name, c in term_names(t).items():
            want[where[name]] += c
        assert got[i] == want, t


def one_hash(s):
    raw = np.frombuffer(s.encode(), np.uint8)
    return words.span_hashes(raw, np.array([0]), np.array([len(raw)]))


def bucket_of(name):
    k = ("word", "shape", "pair", "again").index(name[0])
    h = words.pair(one_hash(name[1]), one_hash(name[2])) if k == 2 else np.array([name[1]], np.uint64) if k == 3 else one_hash(name[1])
    return int((words.mix(h ^ np.uint64(0x2545F4914F6CDD1D + k)) % np.uint64(BUCKETS))[0])


def brute_scores(model, texts, n):
    out = []
    for t in texts:
        z = np.zeros(model.space.shape[1])
        for b, c in zip(*(x.tolist() for x in terms(pa.array([t]))[1:]), strict=True):
            z += (1 + math.log(c)) * float(model.rarity[b]) * model.space[b]
        size = math.sqrt(sum(z * z))
        near = [max(sum(a * b for a, b in zip(z, k, strict=True)) / size, 0) if size else 0.0 for k in model.known.astype(float)]
        last = sorted(near)[-min(n, len(near))]
        total = sum(s for s in near if s >= last - 2e-5)
        out.append(sum(s * y for s, y in zip(near, model.label, strict=True) if s >= last - 2e-5) / total if total else 0.0)
    return out


def test_query_equals_brute_force(spark, sf_dir):
    """All documents of the table; scores may differ where rounding puts a neighbour on the other side of a tie."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.selectExpr("doc_id", "quality AS label").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    model = learn(docs.select("doc_id", "text"), known)
    rows = docs.collect()
    got = {r["doc_id"]: r for r in queries.op11_quality(spark, sf_dir).collect()}
    want = brute_scores(model, [r["text"] for r in rows], neighbours.NEIGHBOURS)
    assert len(got) == len(rows) and sum(abs(got[r["doc_id"]]["score"] - s) > 2e-3 for r, s in zip(rows, want, strict=True)) <= 0.02 * len(rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op11_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.95 * len(found)


def test_equally_near_neighbours_all_vote():
    known = np.array([[1, 0], [1, 0], [1, 0], [0, 1]], np.float32)
    model = Neighbours(np.ones(BUCKETS), np.zeros((BUCKETS, 2)), known, np.array([1.0, 0.0, 0.0, 1.0]))
    assert votes(np.array([[1, 0], [0, 1], [0, 0], [-1, 0]], np.float32), model, 1).tolist() == pytest.approx([1 / 3, 1, 0, 0])
    assert votes(np.array([[1, 0]], np.float32), model, 50).tolist() == pytest.approx([1 / 3])


def test_decomposition_is_that_of_the_dense_matrix():
    rng = np.random.default_rng(1)
    row, bucket = (x.ravel() for x in np.meshgrid(np.arange(40), rng.choice(BUCKETS, 30, replace=False), indexing="ij"))
    weight = (rng.standard_normal((40, 3)) @ rng.standard_normal((3, 30)) * 5).ravel().astype(np.float32)
    got = decompose(row, bucket, weight, 40, 3)
    dense = np.zeros((40, BUCKETS))
    dense[row, bucket] = weight
    assert np.abs(dense @ got @ got.T - dense).max() < 1e-3 * np.abs(dense).max()
    assert latent(row, bucket, np.ones(len(row)), 41, np.ones(BUCKETS), got)[40].tolist() == [0, 0, 0]


def test_odd_rows(spark):
    """Repeated rows and ids, null ids and texts, columns with other names' meaning, labels that contradict each other."""
    good, bad = "some plain words of prose stand here and there", "BUY!! NOW!! BUY!! NOW!! CHEAP!!"
    rows = [*ROWS[:12], ROWS[3], *((i, t, *ROWS[0][2:]) for i, t in [(50, good), (50, good), (51, bad), (None, bad), (52, good + " too"), (53, bad + " BUY!!"), (54, good), (55, bad), (56, bad)])]
    labels = [(50, 1), (51, 0), (52, 1), (53, 0), (54, 1), (54, 0), (55, None), (None, 1), (56, 7)]
    docs = spark.createDataFrame(rows, DDL).withColumnRenamed("sig", "label").withColumnRenamed("node", "place").withColumnRenamed("id", "score").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in quality(docs, known, folds=10**9, neighbours=2).collect()]
    assert len(got) == len(rows)
    assert all(s == 0 and p == 0 for i, s, p in got if i is not None and i < 3)
    assert {(i, p) for i, _, p in got if i in (50, 51, 52, 53)} == {(50, 1), (51, 0), (52, 1), (53, 0)} and sum(i == 50 for i, _, _ in got) == 2
    assert sorted(p for i, _, p in got if i is None) == [0]


def test_no_labels_and_no_rows(spark):
    docs, labels = spark.createDataFrame(ROWS[:5], DDL), spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality(docs, labels).collect()] == [0.0] * 5
    assert quality(spark.createDataFrame([], DDL), labels).collect() == []
