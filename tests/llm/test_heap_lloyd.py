"""Vector codes against brute-force Lloyd rounds: ties, repeated rows, nulls, odd lengths, empty tables, clashing columns."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docquarry.llm import heap_lloyd
from docquarry.llm.heap_lloyd import Block, Books, compress

R = random.Random(3)
DDL = "vec_id long, embedding array<double>, label string, block long, n long, x string, at string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: id, numbers, label. Plain loops over whole numbers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    common = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda c: (c[1], c[0]))[0]
    kept = [r for r in kept if len(r[1]) == common]
    width = common // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, k) for _, v, _ in first] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda k, v: min((far(cut(v, k), c), e) for e, c in enumerate(books[k]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for k in range(parts):
                groups[k, near(k, v)[1]].append(cut(v, k))
        for (k, e), g in groups.items():
            books[k][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    coded = [(i, y, bytes(near(k, v)[1] for k in range(parts)), sum(near(k, v)[0] for k in range(parts))) for i, v, y in kept]
    total = Counter()
    for _, y, _, d in coded:
        total[y] += d
    return sorted([(*c, total[c[1]]) for c in coded], key=repr), books


def vectors(n, length, scale=1.0):
    out = [(i, [R.gauss(0, scale) for _ in range(length)], R.choice(["a", "a", "b", None])) for i in range(n)]
    out += [(n + i, list(out[i % 7][1]), "copy") for i in range(n // 5)]  # ties and repeated vectors
    return out


def held(coded):
    return sorted(((r["vec_id"], r["label"], bytes(r["code"]), r["error"], r["label_error"]) for r in coded.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "clash", "clash") for r in rows], DDL).repartition(3)


@pytest.mark.parametrize(("n", "length", "entries", "scale"), [(300, 8, 16, 1.0), (40, 4, 256, 0.002), (120, 12, 5, 3000.0)])
def test_codes_equal_brute_force(spark, n, length, entries, scale):
    rows = vectors(n, length, scale)
    rows += [(9, rows[0][1], "a"), (9, rows[0][1], "a"), (None, rows[1][1], "b")]  # repeated ids, a repeated row, a null id
    rows += [(500, None, "a"), (501, [None] * length, "a"), (502, [float("nan")] * length, "a"), (-3, [float("inf"), *[0.0] * (length - 1)], "a"), (-4, [1.0] * 4 * length, "a"), (-5, [], "a")]
    coded, books = compress(frame(spark, rows), entries=entries)
    want, brute_books = brute(rows, entries=entries)
    assert books.tolist() == brute_books
    assert held(coded) == want


def test_few_and_no_vectors(spark):
    one = [(5, [0.5, -0.25, 1.0, -1.0], None)]
    coded, books = compress(frame(spark, one))
    assert held(coded) == [(5, None, bytes(4), 0, 0)] and books.tolist() == [[[512]], [[-256]], [[1024]], [[-1024]]]
    for rows in ([], [(1, None, "a")], [(1, [float("nan")] * 4, "a")]):
        coded, books = compress(spark.createDataFrame([(*r, 7, 7, "clash", "clash") for r in rows], DDL))
        assert coded.collect() == [] and books.size == 0
    assert held(compress(frame(spark, [(1, [], "a"), (2, [], None)]))[0]) == [(1, "a", bytes(4), 0, 0), (2, None, bytes(4), 0, 0)]


def test_lengths_and_sizes_that_cannot_be(spark):
    with pytest.raises(ValueError, match="equal parts"):
        compress(frame(spark, [(1, [1.0] * 5, "a")]))
    with pytest.raises(ValueError, match="64 bits"):
        compress(frame(spark, [(1, [1e30] * 4, "a")]))


def test_numbers_beyond_floating_point(spark):
    rows = [(i, [R.uniform(-40_000, 40_000) for _ in range(8)], "a") for i in range(30)]
    coded, books = compress(frame(spark, rows), entries=4, scale=1 << 12)
    want, brute_books = brute(rows, entries=4, scale=1 << 12)
    assert books.tolist() == brute_books and held(coded) == want


def test_only_parts_whose_bounds_are_violated_are_scanned(monkeypatch):
    """Two far groups: after small moves nothing is scanned, after large ones what they may have changed is, and the heaps
    come back from their bytes as they were."""
    x = np.concatenate([np.arange(50), 10_000 + np.arange(50)]).reshape(100, 1, 1).astype(np.int64)
    books = Books(np.array([[[20], [10_020]]]), np.zeros((1, 2)), 1e-9, True)
    block, scanned = Block(x), []
    nearest = heap_lloyd.nearest
    monkeypatch.setattr(heap_lloyd, "nearest", lambda x, *a: scanned.append(len(x)) or nearest(x, *a))
    delta = block.assign(books)
    assert scanned == [100] and delta[0, :, 1].tolist() == [50, 50]
    books = books.moved(np.array([[[25], [10_025]]]))
    again = Block(x)
    again.load(*block.stored(), 2)
    assert again.heaps == block.heaps
    assert not again.assign(books).any() and scanned == [100]
    books = books.moved(np.array([[[25], [40]]]))
    delta = again.assign(books)
    assert len(scanned) == 2 and again.entries[0].tolist() == [int(abs(v - 40) < abs(v - 25)) for v in x.ravel().tolist()]
    assert delta[0, :, 1].tolist() == [33 - 50, 67 - 50]


def test_rounds_shuffle_neither_vectors_nor_heaps(spark):
    rows = spark.range(2000).selectExpr("id AS block", "cast('x' AS binary) AS x")
    a, b = (heap_lloyd.bucketed(rows, "test", "block", 4) for _ in range(2))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b.withColumnRenamed("x", "y").hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan


def test_rare_labels_beside_heavy_ones(spark, monkeypatch):
    monkeypatch.setattr(heap_lloyd, "HEAVY", 4)
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"l{i % 7}", b"", i) for i in range(200)]
    want = Counter()
    for _, y, _, e in rows:
        want[y] += e
    got = heap_lloyd.with_totals(spark.createDataFrame(rows, "vec_id long, label string, code binary, error long")).collect()
    assert len(got) == 200 and all(r["label_error"] == want[r["label"]] for r in got)
