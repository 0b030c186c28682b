"""Periodic runs against a brute-force version: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re
from array import array

import numpy as np
import pytest

from docquarry.llm import queries, runs
from tests.llm.test_operators import DDL, ROWS

R = random.Random(7)


def brute(y, length, exponent):
    """Every period, every stretch; of equal stretches the smallest period."""
    out, n = {}, len(y)
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and y[j] == y[j + p]:
                j += 1
            if j > i and j + p - i >= max(length, exponent * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def sequences():
    for _ in range(3000):
        letters = R.choice([1, 2, 2, 3, 5])
        y = [R.randrange(letters) for _ in range(R.randint(0, 50))]
        if y and R.random() < 0.6:
            y = y[: R.randint(1, len(y))] * R.randint(1, 6)
            for _ in range(R.randint(0, 2)):
                y[R.randrange(len(y))] = R.randrange(letters)
        yield y


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_brute_force(length, exponent):
    for y in sequences():
        want = brute(y, length, exponent)
        assert runs.found(np.array(y, np.int64), length, exponent) == want, y
        if runs.shallow(np.array([*y, -1]), np.array([len(y)]), runs.reach(length, exponent))[0]:
            assert not want, y


def test_links_are_next_smaller_suffixes_and_their_matches():
    for y in sequences():
        nss, ext = runs.links(array("q", [*y, -1]))
        for i in range(len(y)):
            j = next(j for j in range(i + 1, len(y) + 1) if y[j:] < y[i:])
            m = 0
            while j + m < len(y) and y[i + m] == y[j + m]:
                m += 1
            assert (nss[i], ext[i]) == (j, m), (y, i)


def test_words_are_read_once():
    """Numbers are looked up a bounded number of times for each place, whatever repeats."""

    class Counted(array):
        seen = 0

        def __getitem__(self, k):
            Counted.seen += 1
            return super().__getitem__(k)

    fib = [0], [0, 1]
    while len(fib[1]) < 4000:
        fib = fib[1], fib[1] + fib[0]
    for y in ([0] * 4000, list(range(4000)), fib[1][:4000], [R.randrange(3) for _ in range(40)] * 100, ([0] * 60 + [1]) * 64):
        Counted.seen = 0
        runs.links(Counted("q", [*y, -1]))
        assert Counted.seen <= 9 * len(y)


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_texts(spark):
    periodic = [(100, "a b " * 9 + "c"), (101, "x" + " x" * 5), (101, "x" + " x" * 4), (None, "q r s " * 4 + "q q q q q q"), (102, "Ü\x1cx\x85 " * 7), (103, "a a a a a a b b b b b b"), (104, "w" * 5000 + " k" * 70_000)]
    rows = [*ROWS, ROWS[12], ROWS[12], *((i, t, *ROWS[0][2:]) for i, t in periodic)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    docs = docs.withColumnRenamed("fp", "runs").withColumnRenamed("sig", "collapsed")
    got = sorted((repr(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.text_runs(docs).collect())
    want = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        found = brute(w, 6, 4) if len(w) < 1000 else [(1, 70_000, 1)] if w[1] == "k" else []
        want.append((repr(r[0]), found, collapsed(w, found)))
    assert got == sorted(want)


def test_no_rows(spark):
    assert runs.text_runs(spark.createDataFrame([], DDL)).collect() == []


def test_query_breaks_ties_and_repeats_words(spark, tmp_path):
    """Of runs as long as each other the first counts; h = crc32(doc_id) that ends in 0 makes a text periodic."""
    rows = [(1, "a a a a a a b b b b b b"), (2, None), (29, " ".join(f"w{i}" for i in range(40))), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert (got[1]["n_runs"], got[1]["start"], got[1]["length"], got[1]["period"], got[1]["exponent_milli"]) == (2, 0, 6, 1, 6000)
    assert got[2]["start"] is None and got[2]["n_runs"] == got[3]["n_runs"] == 0 and got[2]["collapsed_sha256"] == got[3]["collapsed_sha256"]
    assert (got[29]["n_runs"], got[29]["start"], got[29]["length"], got[29]["period"], got[29]["exponent_milli"]) == (1, 15, 25, 3, 8333)
