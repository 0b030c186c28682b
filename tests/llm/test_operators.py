"""Each operator against a brute-force version on small rows: nulls, empty and very long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with those that the operators use."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.llm import channel, decontam, exact_dedup, golomb, html_extract, jaccard_join, kneser_ney, langid, mixing, records, sharding, toxicity, words

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp string, sig string, node string, shard string, epoch string, id string, chunk string"
TOKENS = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(4)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 6))) for _ in range(300)]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def edited(t, k):
    w = t.split()
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(VOCABULARY)
    return " ".join(w)


def texts():
    out = [None, "", " \n\t ", "one", "one two", "One  two", "a b c", "A B\tC", "...", "Ünïcode Çase", "x" * 5000, prose(20_000)]
    for _ in range(12):
        base = prose(R.randint(3, 120))
        out += [base, base, base.upper(), base.replace(" ", "\n"), *(edited(base, k) for k in (1, 1, 2, 3))]
    return out + [prose(R.randint(1, 60)) for _ in range(40)]


TEXTS = texts()
ROWS = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 1, *["clash"] * 7) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a repeated id with another text, and null ids."""
    return spark.createDataFrame([*ROWS[:20], ROWS[12], ROWS[12], (12, "other text here", *ROWS[0][2:]), (None, TEXTS[12], *ROWS[0][2:]), (None, None, *ROWS[0][2:])], DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_split_like_the_pattern():
    t = ["Hello the  World", None, "", " a\tb\n", "x", "é Ü", "w" * 3000 + " end", "\x0b\x0c\x1f\x85"] + TEXTS
    for piece in (64, 1 << 20):
        old, words.PIECE = words.PIECE, piece
        words._CACHE.clear()
        data, offsets = words.buffers(pa.array(t))
        w = words.split(data, offsets)
        words.PIECE = old
        words._CACHE.clear()
        spelled = [bytes(data[s:e]) for s, e in zip(w.start, w.end, strict=True)]
        assert spelled == [x.encode() for u in t for x in TOKENS.findall(u or "")]
        assert len(set(w.hash.tolist())) == len({lower(x.decode()) for x in spelled})
    assert len(words.split(*words.buffers(pa.array([], pa.string()))).hash) == 0


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1 << 60), (1000, 1 << 48), (1000, 50), (500, 1 << 64)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        assert (golomb.decode(golomb.encode(v, top)) == v).all()


def test_exact_dedup(docs, odd, none):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(TEXTS)}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = by_id(exact_dedup.exact_dedup(docs))
    assert len(got) == len(TEXTS)
    for i, t in norm.items():
        assert tuple(got[i])[1:] == (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(odd).count() == odd.count()
    assert exact_dedup.exact_dedup(none).count() == 0


@pytest.mark.parametrize("owners, sent", [(1, 1), (3, 7), (16, 1 << 20)])
def test_exact_dedup_over_chunks_and_owners(spark, owners, sent):
    """A third of all rows is one text; copies stand in one chunk or in several, at every number of them."""
    texts = ["hot  text" if i % 3 == 0 else f"t {i % 40}" if i % 3 == 1 else f"alone {i}" for i in range(300)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t].append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = by_id(exact_dedup.exact_dedup(df, owners=owners, sent=sent))
    assert len(got) == 300 and all(tuple(got[i])[1:4] == (min(groups[t]), len(groups[t]), i == min(groups[t])) for i, t in enumerate(texts))


def test_a_chunk_sends_each_fingerprint_once():
    fps = np.array([5, 5, 5, 9, 1 << 47], np.int64)
    rows = exact_dedup.pa.RecordBatch.from_arrays([exact_dedup.pa.array(fps)], names=["fp"])

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 2)

    before, exact_dedup.TaskContext = exact_dedup.TaskContext, Task
    try:
        (out,) = exact_dedup.send(2, 100)(iter([rows]))
    finally:
        exact_dedup.TaskContext = before
    got = out.to_pydict()
    assert got["chunk"] == [2 << 32] * 2 and got["owner"] == [0, 1]
    assert golomb.decode(got["blob"][0]).tolist() == [5, 9] and exact_dedup._set(got["repeated"][0], 2).tolist() == [True, False]


def test_fingerprint_owners_cover_the_range():
    for owners in (1, 3, 16, 51):
        v = np.sort(np.random.default_rng(2).integers(0, 1 << 48, 2000, dtype=np.uint64))
        own = exact_dedup.owner_of(v, owners)
        assert own.max() < owners and (np.diff(own.astype(int)) >= 0).all()
        for o in np.unique(own):
            lo, width = exact_dedup._bounds(int(o), owners)
            assert (v[own == o] >= lo).all() and (v[own == o] < lo + width).all()


def test_sharding(docs, odd, none):
    got = sharding.kd_shards(docs, 7).collect()
    assert len(got) == len(TEXTS) and {r["law"] for r in got} == {"bytes"}
    for r in got:
        t = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.kd_shards(odd, 3).count() == odd.count() and sharding.kd_shards(none, 3).count() == 0


def test_shards_are_even_where_rows_allow(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int"))).alias("text"))
    sizes = [r["s"] for r in sharding.kd_shards(df, 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.03 * min(sizes)
    assert sharding.kd_shards(df, None, target_bytes=20_000).select("shard").distinct().count() == math.ceil(sum(sizes) / 20_000)


def brute_hits(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = {i: word.findall(lower(t)) for i, t in docs.items()}
    grams = defaultdict(set)
    for k, t in items.items():
        x = word.findall(lower(t))
        for s in range(max(1, len(x) - size + 1)) if x else ():
            grams[tuple(x[s : s + size])].add(k)
    out = {}
    for i, x in w.items():
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(x) - n + 1):
                if ks := grams.get(tuple(x[s : s + n])):
                    found |= ks
                    hit |= set(range(s, s + n))
        out[i] = (len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, docs, odd, none):
    items = {1: " ".join(TEXTS[30].split()[:14]), 2: "One TWO", 3: None, 4: "", 5: "nowhere at all", 11: TEXTS[30], 6: "e!", 7: " ".join(TEXTS[11].split()[500:540]), 8: "one"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_hits(dict(enumerate(TEXTS)), items)
    got = by_id(decontam.contamination(docs, bench))
    assert {i: tuple(r)[1:] for i, r in got.items()} == want and sum(w[4] for w in want.values()) > 5
    assert decontam.contamination(odd, bench).count() == odd.count()
    assert decontam.contamination(none, bench).count() == 0
    assert not decontam.contamination(docs, bench.limit(0)).where("contaminated").count()


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha beta"), (3, "alpha " + "x " * 9 + "beta"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    got = decontam.proximity_matches(b, d, slop=3)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]


def test_shares():
    assert mixing.share(10, {"a": (1, 100), "b": (1, 100)}) == {"a": 5, "b": 5}
    assert mixing.share(10, {"a": (1, 2), "b": (1, 100), "c": (2, 100)}) == {"a": 2, "b": 3, "c": 5}
    assert mixing.share(100, {"a": (1, 2), "b": (0, 9)}) == {"a": 2, "b": 0}
    assert mixing.share(10, {"a": (1, 9), "b": (1, 9), "c": (1, 9)}) == {"a": 4, "b": 3, "c": 3}


def test_shortage_goes_to_siblings_first():
    leaves = [("d", "en", "a", 2), ("d", "en", "b", 100), ("d", "fr", "c", 100), ("e", "en", "f", 100)]
    got = mixing.budgets(leaves, 80, {}, 1)
    assert got == {("d", "en", "a"): 2, ("d", "en", "b"): 18, ("d", "fr", "c"): 20, ("e", "en", "f"): 40}


def brute_mix(rows, total, weights, epochs, seed):
    n = lambda t: len(TOKENS.findall(t or ""))
    leaf = lambda r: ("x" if (r[3] or "") < "s2" else "y", r[2] or "", r[3] or "")
    size = Counter()
    for r in rows:
        size[leaf(r)] += n(r[1])
    total = int(total * sum(size.values()))
    wanted = mixing.budgets(sorted((*k, v) for k, v in size.items()), total, weights, epochs)
    out = []
    for k, budget in wanted.items():
        for e in range(epochs):
            b = min(budget, size[k])
            budget -= b
            done = 0
            for r in sorted((r for r in rows if leaf(r) == k), key=lambda r: hashlib.md5(f"{seed}:{e}:{r[0]}".encode()).hexdigest()):
                if done < b:
                    out.append((r[0], e))
                done += n(r[1])
    return sorted(out), {k: min(v, size[k] * epochs) for k, v in wanted.items()}


@pytest.mark.parametrize(("total", "epochs"), [(Fraction(1, 2), 1), (Fraction(3, 2), 2), (Fraction(9, 1), 2)])
def test_mixing(docs, total, epochs):
    weights = {"domain": {"x": 3}, "source": {"s1": 2, "s3": 0}}
    domain = F.when(F.coalesce("source", F.lit("")) < "s2", "x").otherwise("y")
    got = mixing.mix(docs, total, domain, weights, epochs, "z")
    want, _ = brute_mix(ROWS, total, weights, epochs, "z")
    assert sorted((r["doc_id"], r["epoch"]) for r in got.select("doc_id", "epoch").collect()) == want
    assert set(got.columns) == set(docs.columns) | {"mix_tokens"}


def test_mixing_of_odd_rows(odd, none):
    assert mixing.mix(none, 100, F.lit("x"), {}).count() == 0
    assert mixing.mix(odd, Fraction(1), F.lit(None), {}).count() > 0


def brute_components(rows, size=3, num=90, den=100):
    sets = {}
    for i, t in rows.items():
        w = TOKENS.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(docs, odd, none):
    want = brute_components(dict(enumerate(TEXTS)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == want and sum(i != c for i, (_, c) in want.items()) > 30
    assert jaccard_join.jaccard_components(odd).count() == odd.count()
    assert jaccard_join.jaccard_components(none).count() == 0


def test_chains_and_near_copies_of_one_another(spark):
    base = prose(400).split()
    rows, t = [], list(base)
    for k in range(25):  # each is near the one before, the last far from the first
        t = list(t)
        t[k * 15] = f"new{k}"
        rows.append((1000 + k, " ".join(t)))
    rows += [(2000 + k, " ".join([*base[: 16 * k], f"u{k}", f"v{k}", f"w{k}", *base[16 * k + 3 :]])) for k in range(20)]
    want = brute_components(dict(rows))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("two", [0, 1, 3])
def test_every_linked_pair_shares_a_signature(two):
    lows = jaccard_join.bands(400)
    ends = [*(lows[1:] - 1).tolist(), int(lows[-1] * 10 // 9), int(lows[-1] * 100 // 81)]
    plans = []
    for hi in ends:
        m = 10 * 2 * hi // 190 + 1
        k = min(two, m // 2)
        plans.append((m - k, k))
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(5, 400))
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        most = int((n * 2) * 10 // 190)
        cut = int(r.integers(0, most + 1))
        b = np.concatenate([a[cut:], r.integers(0, 1 << 63, int(r.integers(0, most - cut + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            row = np.repeat([0, 1], [len(a), len(b)])
            sig, counts = jaccard_join.signatures(row, np.concatenate([a, b]), 2, lows, plans)
            assert set(sig[: counts[0]].tolist()) & set(sig[counts[0] :].tolist())


def test_allotments_meet_the_bound():
    for hi in (1, 9, 10, 100, 5000):
        for n in (10, 10**6, 10**10):
            m, two = jaccard_join.allot(hi, n)
            assert m + two >= 20 * hi // 190 + 1 and two <= m


def test_token_records(spark, docs, odd, none, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    base = f"file://{tmp_path}/r"
    manifest = records.write_records(docs, base, P.path("word_bpe_49k.json"), 2, files=3)
    got = records.read_records(spark, base, manifest).orderBy("doc_id").collect()
    start = 0
    for r, (i, x) in zip(got, enumerate(TEXTS), strict=True):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert records.token_records(odd, P.path("word_bpe_49k.json")).count() == odd.count()
    assert records.token_records(none, P.path("word_bpe_49k.json")).count() == 0


def test_special_strings_and_odd_white_space_are_tokenised_alike():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    xs = ["it's <|endoftext|> x", "<|ENDOFTEXT|>", "é É a b", "á ́b", "中文 １２ ①", "A\x1cB"]
    ids, each = records.encode(pa.array(xs), path, None)
    assert ids.tolist() == [i for x in xs for i in t.encode(x, add_special_tokens=False).ids] and each.sum() == len(ids)


def test_broken_records_are_noticed():
    data = records.frame(b"abc") + records.frame(b"")
    assert [p for _, p in records.frames(data)] == [b"abc", b""]
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(data[:-1]))


class BruteKneserNey:
    def __init__(self, texts_):
        self.pairs, self.c = Counter(), Counter()
        for t in texts_:
            w = ["<s>", *TOKENS.findall(lower(t)), "</s>"]
            self.c.update(w[1:])
            self.pairs.update(zip(w, w[1:], strict=False))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.context, self.follow, self.before = Counter(), defaultdict(Counter), Counter()
        for (a, b), k in self.pairs.items():
            self.context[a] += k
            self.follow[a][min(k, 3)] += 1
            self.before[b] += 1
        often = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
        self.d, self.e = kneser_ney.discounts(often(self.pairs.values())), kneser_ney.discounts(often(self.before.values()))

    def p(self, a, b):
        d = lambda ds, k: ds[min(k, 3) - 1] if k else 0
        if not self.pairs:
            return 1 / (self.v + 1)
        mass = sum(d(self.e, k) for k in self.before.values())
        lo = (max(self.before[b] - d(self.e, self.before[b]), 0) + mass / (self.v + 1)) / len(self.pairs)
        if not self.context[a]:
            return lo
        k = self.pairs[a, b]
        return (max(k - d(self.d, k), 0) + sum(self.d[j - 1] * m for j, m in self.follow[a].items()) * lo) / self.context[a]


def test_counts_beyond_32_bits_and_too_large_vocabularies(tmp_path):
    base, many = tmp_path.as_uri(), (1 << 33) + 5
    keys = np.array([7, int(kneser_ney.END)], np.uint64)
    blocks = [b for n in ([many, 1], [many, 2]) for b in kneser_ney._blocks(0, keys, np.array(n), np.zeros(2, int), 1 << 64)]
    got = kneser_ney.store_words((0,), pd.DataFrame(blocks), base).iloc[0]
    assert (got["n"], got["tokens"], got["docs"]) == (2, 2 * many + 3, 3)
    assert kneser_ney._load(base, "words-0.count", np.int64).tolist() == [2 * many, 3]
    assert kneser_ney.offsets([2, 0, 3]) == (0, 2, 2, 5) and kneser_ney.offsets([(1 << 32) - 2])[-1] == (1 << 32) - 2
    with pytest.raises(ValueError):
        kneser_ney.offsets([1 << 31, 1 << 31])


def test_language_model(docs, odd, none):
    m = BruteKneserNey([t for i, t in enumerate(TEXTS) if fold(i, 7) != 2])
    got = by_id(kneser_ney.lm_scores(docs))
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w = ["<s>", *TOKENS.findall(lower(t)), "</s>"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(w) - 1, sum(m.c[x] > 0 for x in w[1:]), m.n)
        assert r["base_score"] == pytest.approx(sum(math.log10((m.c[x] + 1) / (m.n + m.v + 1)) for x in w[1:]))
        assert r["score"] == pytest.approx(sum(math.log10(m.p(a, b)) for a, b in zip(w, w[1:], strict=False)))
    for a in ["<s>", "one", "nowhere", *VOCABULARY[:5]]:
        assert sum(m.p(a, b) for b in m.c) + m.p(a, "nowhere") == pytest.approx(1)
    assert kneser_ney.lm_scores(odd).count() == odd.count() and kneser_ney.lm_scores(none).count() == 0


LANGS = {"aa": ["kalo", "miru", "tave", "sono"], "bb": ["schtu", "wrang", "bltz", "knopf"], "cc": ["éà", "çût", "ïöé", "ñéç"]}


def test_language_id(spark, none):
    rows = [(i, " ".join(R.choice(LANGS[k]) for _ in range(R.randint(1, 60))), k) for i in range(600) for k in [R.choice("abc") * 2]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, rows[0][1] * 400, rows[0][2]), (1004, rows[1][1], None), (None, rows[2][1], "aa")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", rows[0][2]]
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and sum(by[r["doc_id"]]["lang_pred"] == rows[r["doc_id"]][2] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got if r["doc_id"] is not None)
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_tables_give_what_the_network_gives():
    r = np.random.default_rng(5)
    net = langid.fit(r.integers(0, 28, (256, langid.WINDOW)), r.integers(0, 3, 256), ["a", "b", "c"], epochs=1)
    data = r.integers(32, 250, langid.WINDOW * 3).astype(np.uint8)
    x, row, weight = langid.windows(data, np.array([0, len(data)]))
    assert (x == langid.CLASS[data].reshape(3, -1)).all() and (weight == langid.WINDOW).all() and (row == 0).all()
    direct = langid._forward(net, x)[0].mean(axis=0)
    assert np.allclose(langid.log_odds(net, net.tables(), data, np.array([0, len(data)]))[0], direct, atol=1e-4)


def bad_words_model():
    good = "the plain text of a page with words such as idiot moron trash stupid loser and others likewise".split()
    return channel.CharModel(channel.bigrams(good, [50] * len(good)))


@pytest.mark.parametrize(("noisy", "plain"), [("1d1ot", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("l0$er", "loser"), ("plain", "plain"), ("text***", "text***"), ("page,", "page,")])
def test_channel_restores(noisy, plain):
    assert channel.restore_word(noisy, bad_words_model()) == plain


def test_channel_on_texts():
    m = bad_words_model()
    assert channel.restore("You 1d1ot", m) == "you idiot" and channel.restore("an i d i o t here", m) == "an idiot here" and channel.restore(None, m) == ""


def toxic_rows():
    bad = ["idiot", "moron", "trash"]
    rows, labels = [], []
    for i in range(800):
        w = [R.choice(VOCABULARY) for _ in range(R.randint(5, 40))]
        if y := int(R.random() < 0.25):
            w[R.randrange(len(w))] = R.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return rows, labels


def test_toxicity(spark, none):
    rows, labels = toxic_rows()
    extra = [(2000, "ab 1d1ot cd ef"), (2001, "ab i d i o t cd ef"), (2002, None), (2003, ""), (2004, "idiot " + prose(20_000)), (2005, prose(50)), (None, "idiot")]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    held = [i for i, _ in labels if fold(i, 5) == 0]
    assert sum(by[i]["predicted"] == dict(labels)[i] for i in held) >= 0.97 * len(held)
    assert [by[i]["predicted"] for i in (2000, 2001, 2004, None)] == [1, 1, 1, 1] and [by[i]["predicted"] for i in (2002, 2003, 2005)] == [0, 0, 0]
    kept = {r["doc_id"] for r in toxicity.without_toxic(d, lab).collect()}
    assert kept == {i for i, r in by.items() if r["predicted"] == 0}
    assert toxicity.toxicity(none, lab).count() == 0
    assert {r["score"] < 0.5 for r in toxicity.toxicity(d, lab.limit(0)).collect()} == {True}


def test_html_text(spark):
    page = "<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  para\n of <b>text</b>, long enough to look like one.<p>Second &eacute; para. It ends.</article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "u", "<p>Only a paragraph stands here, which is the page.")], "page_id long, url string, html string")
    got = html_extract.main_text(df).collect()
    want = "A & B\nFirst para of text, long enough to look like one.\nSecond é para. It ends."
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got if r["page_id"]) == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_invented_pages_held_out():
    trees = html_extract.model()
    right = total = 0
    for nodes, labels in html_extract.made_pages(120, seed=77):
        keep = html_extract.decode(nodes, trees.predict(html_extract.features(nodes)))
        right, total = right + int((keep == labels).sum()), total + len(labels)
        at = {id(n): k for k, n in enumerate(nodes)}
        assert all(keep[at[id(n.parent)]] for n, ok in zip(nodes, keep, strict=True) if ok and n.parent is not None)
    assert right >= 0.98 * total


@pytest.mark.parametrize("size", [5, 63, 64, 150])
def test_sibling_features_at_every_size(size):
    tags = ["p" if k % 3 else "div" for k in range(size)]
    body = "".join(f"<{t}>{'x' * (k + 1)}</{t}>" for k, t in enumerate(tags))
    nodes = html_extract.walk(html_extract.parse(f"<body>{body}</body>"))
    f = html_extract.features(nodes)[1:, len(html_extract.TAGS) + 2 * len(html_extract.WORDS) :]
    text = [math.log1p(k + 1) for k in range(size)]
    assert np.allclose(f[:, 10], size) and np.allclose(f[:, 11], np.arange(size) / (size - 1))
    assert np.allclose(f[:, 12], [-1, *text[:-1]]) and np.allclose(f[:, 13], [*text[1:], -1])
    assert f[:, 17].tolist() == [tags.count(t) for t in tags]


def test_channel_puts_spaces_into_its_lattice():
    good = "the plain text of a page with words such as idiot moron trash stupid loser and others idiöt likewise".split()
    m = channel.CharModel(channel.bigrams(good, [50] * len(good)))
    assert channel.restore("here is m o r o n, there", m) == "here is moron there"
    assert channel.restore("mo ron", m) == "moron" and channel.restore("i d i ö t", m) == "idiöt" and channel.restore("m. 0. r. 0. n.", m) == "moron"
    assert channel.restore("text of a page", m) == "text of a page"


@pytest.mark.parametrize("text", ["such a m o r o n here", "m o r o n i d i o t t r a s h", "with mo ron here", "the i d i ö t here", "M, o, r, o, n!", "m 0 r 0 n", "m o r r r o n"])
def test_spaced_words_give_their_features(text):
    good = "the plain text of a page with words such as idiot moron trash stupid loser and others idiöt likewise".split()
    restored = channel.restorer(channel.CharModel(channel.bigrams(good, [50] * len(good))))
    features = lambda t, r: set(toxicity.doc_features(pa.array([t]), r)[1].tolist())
    got = features(text, restored)
    for word in ("idiöt",) if "ö" in text else ("idiot", "moron", "trash") if "t r a" in text else ("moron",):
        want = {k for k in features(word, None) if k not in features(word[:2], None)}
        assert want & features(word + "x", None) <= got  # every beginning of the word


def test_ordinary_short_words_stay_apart():
    good = "the plain text of a page with words such as idiot moron trash stupid loser and others likewise".split()
    restored = channel.restorer(channel.CharModel(channel.bigrams(good, [50] * len(good))))
    text = pa.array(["text of a page such as the others", None, "", "1 2 3 4", "plain"])
    assert [x.tolist() for x in toxicity.doc_features(text, restored)] == [x.tolist() for x in toxicity.doc_features(text, None)]


@pytest.mark.parametrize(("page", "texts"), [
    ("<article><p>one<button>Go<p>two</p></article><p>three", ["one", "two", "three"]), ("<p>one <object data='x'>two</object> <object>three</p><p>four", ["one two three", "four"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["so x=1 holds"]), ("<p>a<noscript>b</noscript>c", ["abc"]), ("<p>a<button>Go</button><select><option>x</select>b", ["ab"]),
    ("<p>a<svg><path d='M0'/><title>t</title></svg>b</p><svg><g><p>c", ["ab", "c"]), ("<select><option>x<option>y<div>a</div>b", ["a", "b"]), ("<p>a<video src=x>b<p>c<script>var x", ["ab", "c"]),
])
def test_text_after_unclosed_elements_stays(page, texts):
    from docquarry.llm.dom import parse, walk

    assert [t for _, t in sorted(x for n in walk(parse(page)) for x in n.texts)] == texts


def test_all_terms_of_a_window_must_meet(spark):
    """Rows in which the rarest terms stand right but another word doesn't are no matches; so removing either
    intersection changes the result. Ids may be null or repeat: each row has the hits of its own text."""
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item), (2, item.replace("seven", "x")), (3, "one two " + "y " * 8), (None, "a " + item), (4, None), (4, item), (4, "nothing here"), (5, item.replace("one", "x") + " one two three")]
    docs = spark.createDataFrame(rows + [(9, "three four five six seven eight nine ten " * 4)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in decontam.contamination(docs, bench).collect())
    assert got == [(0, 11, 10), (1, 10, 10), (2, 10, 0), (3, 10, 0), (4, 0, 0), (4, 2, 0), (4, 10, 10), (5, 13, 0), (9, 32, 0)]
    for rarest in (1, 3, 10):
        assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in decontam.contamination(docs, bench, rarest=rarest).collect()) == got
    kept = decontam.without_contaminated(docs.withColumn("row", F.lit(1)).withColumn("w", F.lit(2)), bench)
    assert kept.count() == 6 and kept.columns == ["doc_id", "text", "row", "w"]


def test_decontamination_and_join_without_broadcasts(spark, docs, monkeypatch):
    from docquarry.llm import shared

    items = {1: " ".join(TEXTS[30].split()[:14]), 2: "One TWO", 7: " ".join(TEXTS[11].split()[500:540])}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    got = by_id(decontam.contamination(docs, bench))
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_hits(dict(enumerate(TEXTS)), items)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()} == brute_components(dict(enumerate(TEXTS)))


def test_proximity_needs_all_words(spark):
    d = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "alpha beta delta"), (2, "alpha beta gamma"), (None, "beta alpha gamma"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma"), (8, None)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in decontam.proximity_matches(b, d, slop=3).collect()) == [0, 1, 2]
    assert decontam.proximity_matches(b, d.limit(0)).count() == 0 and decontam.proximity_matches(b.limit(0), d).count() == 0


@pytest.mark.parametrize("spares", [0, 1, 4])
def test_linked_pairs_share_a_signature_with_light_segments_left_out(spares):
    num, den = 80, 100
    lows = jaccard_join.bands(120, num, den)
    ends = [*(lows[1:] - 1).tolist(), int(lows[-1] * den // num), int(lows[-1] * den * den // num // num)]
    plans = []
    for hi in ends:
        least = jaccard_join.most_apart(hi, num, den) + 1
        plans.append((least + spares - least // 3, least // 3))
    r = np.random.default_rng(5)
    for _ in range(600):
        n = int(r.integers(1, 120))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        most = 2 * n * (den - num) // (den + num)
        cut = int(r.integers(0, most + 1))
        b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 63, int(r.integers(0, most - cut + 1))).astype(np.uint64)]))
        if len(b) and den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
            row = np.repeat([0, 1], [len(a), len(b)])
            sig, counts = jaccard_join.signatures(row, np.concatenate([a, b]), 2, lows, plans, [spares] * len(plans))
            assert set(sig[: counts[0]].tolist()) & set(sig[counts[0] :].tolist())


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    xs = [one, one.translate(str.maketrans("ab", "ba")), "some other words, some of them twice", "x" * 300 + " " + "y" * 300]
    want = [i for x in xs for i in Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids]
    assert records.encode(pa.array(xs), path, None)[0].tolist() == want
    monkeypatch.setattr(words, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    words.kept("another operator")
    assert records.encode(pa.array(xs), path, None)[0].tolist() == want
    words.kept("another operator")


def test_wide_ids_and_ids_of_other_types(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, **{f"w{i}": i for i in range(1, 100_000)}}, "[UNK]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(f"{tmp_path}/t.json")
    rows = [("b", "w5 w99999"), ("a", "w70000"), (None, "w1"), ("10", None), ("a", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    manifest = records.write_records(df, f"file://{tmp_path}/r", f"{tmp_path}/t.json", 2, files=2)
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in records.read_records(spark, f"file://{tmp_path}/r", manifest).orderBy("start").collect()]
    assert sorted(got, key=str) == sorted([(None, [1, 2]), ("10", [2]), ("a", [70000, 2]), ("a", [2]), ("b", [5, 99999, 2])], key=str)
    assert [d for d, _ in got] == [None, "10", "a", "a", "b"]
    assert records.token_records(spark.createDataFrame([(1.5, "w1")], "doc_id double, text string"), f"{tmp_path}/t.json").first()["doc_id"] == "1.5"


def brute_kd(rows, shards):
    """rows: (id, size, crc, tie, values). The same law, row by row."""
    spans = [max(1, max(r[4][d] for r in rows) - min(r[4][d] for r in rows)) for d in range(len(rows[0][4]))]
    out = {}

    def halve(rows, first, n):
        if n == 1 or not rows:
            out.update((r[0], first) for r in rows)
            return
        width = [max(r[4][d] for r in rows) - min(r[4][d] for r in rows) for d in range(len(spans))]
        wide = [d for d in range(len(spans)) if width[d]]
        d = max(wide, key=lambda d: width[d] / spans[d], default=0)
        weight, goal = sum(r[1] for r in rows), sum(r[1] for r in rows) * (n // 2) / n
        left, inside = [], rows
        for level, key in enumerate((lambda r: r[4][d], lambda r: r[2], lambda r: r[3])):
            groups = defaultdict(list)
            for r in inside:
                groups[key(r)].append(r)
            for k in sorted(groups):
                inside = groups[k]
                if sum(r[1] for r in left) + sum(r[1] for r in inside) >= goal or k == max(groups):
                    break
                left += inside
            short, over = goal - sum(r[1] for r in left), sum(r[1] for r in left) + sum(r[1] for r in inside) - goal
            if level == 2 or min(short, over) <= sharding.SLACK * weight / n:
                left += inside if over <= short else []
                break
        there = {r[0] for r in left}
        halve(left, first, n // 2)
        halve([r for r in rows if r[0] not in there], first + n // 2, n - n // 2)

    halve(rows, 0, shards)
    return out


@pytest.mark.parametrize(("slack", "n"), [(0.01, 5), (0.5, 3)])
def test_shards_by_brute_force(spark, docs, monkeypatch, slack, n):
    monkeypatch.setattr(sharding, "SLACK", slack)
    tie = {r["doc_id"]: r["t"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("kd")).bitwiseAND(F.lit((1 << 52) - 1)).alias("t")).collect()}
    rows = []
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        rows.append((i, len(b) + 8, zlib.crc32(b), tie[i], (len(b) + 8, len(b) - len(t or ""), (t or "").count(" "))))
    assert {r["doc_id"]: r["shard"] for r in sharding.kd_shards(docs, n).collect()} == brute_kd(rows, n)


def test_equal_texts_share_a_shard_where_a_border_can_pass_between_them(spark):
    rows = [(9 * k + j, f"{k:03d}" + "x" * 97) for k in range(100) for j in range(9)] + [(1000 + k, "y" * (150 + k)) for k in range(60)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert sum(len(s) > 1 for s in where.values()) <= 7 and max(sizes.values()) < 1.05 * min(sizes.values())


@pytest.mark.parametrize("n", [10, 45, 200])
def test_adverts_in_articles_of_any_length_go(n):
    r = random.Random(n)
    sentence = lambda k: (" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(k)) + ".").capitalize()
    parts = [f"<p>{sentence(r.randint(10, 60))}</p>" + ('<div class="ad">BUYNOW ' + sentence(8) + "</div>" if k % 9 == 8 else "") for k in range(n)]
    for tag in ("article", "div"):
        page = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><{tag}><h1>T</h1>{"".join(parts)}</{tag}><footer>&copy; x</footer></body></html>'
        got = html_extract.extract([page], html_extract.model())[0]
        assert len(got) == n + 1 and not any("BUYNOW" in x for x in got)


def seconds(f, x):
    import time

    took = []
    for _ in range(3):
        began = time.perf_counter()
        f(x)
        took.append(time.perf_counter() - began)
    return min(took)


def test_unclosed_quotes_take_linear_time():
    from docquarry.llm.dom import parse, walk

    for junk in ('<p "', "<p '\""):
        assert seconds(parse, junk * 80_000) < 12 * seconds(parse, junk * 20_000) + 0.1
    page = "<p title=\"a > b\">one</p><p title='x \"y'>two</p><a href=\"u?a<b\">z</a>"
    assert [t for _, t in sorted(x for n in walk(parse(page)) for x in n.texts)] == ["one", "two", "z"]


@pytest.mark.parametrize("word", ["word,", "-{}1a", "$-", "-{}a", "a!", "a1,b2,", "a_", "1,", "$", "a.", "$(", "a"])
def test_long_words_take_linear_time(word):
    m = channel.CharModel(channel.bigrams(["word", "moron"], [5, 5]))
    of = lambda n: ("a" + word.format("-" * n)) if "{}" in word else word[0] * n + word[1:] * n if word in ("$-", "$(") else word * n
    work = lambda w: (channel.restore_word(w, m), channel.trimmed(w))
    assert seconds(work, of(40_000)) < 12 * seconds(work, of(10_000)) + 0.05


def test_viterbi_finds_the_cheapest_of_all_paths():
    from itertools import product

    r = random.Random(9)
    m = channel.CharModel(channel.bigrams("idiot moron trash stupid loser silly goose llama".split(), [r.randint(1, 50) for _ in range(8)]))
    for _ in range(300):
        word = "".join(r.choice("idotmrsl1103$!|l") * r.choice([1, 1, 1, 2, 3]) for _ in range(r.randint(1, 6)))
        parts = channel.lattice(word)

        def cost(path):
            out = "".join(x for x, _ in path)
            return sum(c for _, c in path) + sum(m(a, b) for a, b in zip(channel.END + out, out + channel.END, strict=True))

        got = channel.viterbi(parts, m)
        ways = list(product(*parts))
        best = min(cost(p) for p in ways)
        assert min(cost(p) for p in ways if "".join(x for x, _ in p) == got) == pytest.approx(best), word


def test_words_go_to_the_tokenizer_in_groups():
    """Few sequences for many words, with the ids that the tokenizer gives each word alone; odd words as well."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, calls = Tokenizer.from_file(path), []

    class Counted:
        def __init__(self, real):
            self.real = real

        def encode_batch_fast(self, batch, **k):
            calls.append(len(batch))
            return self.real.encode_batch_fast(batch, **k)

    many = [f"word{k}'s-Été{k % 7}" for k in range(900)] + ["<|endoftext|>", "e\u0301", "\u0301x", "\u00a0", "日本語", "\u200b", "|word|", "'s", "\u00a0\u0301"]
    for listed, most in ((many, 10), ([*many, "x" * 700 + "é"], 1000), ([*many, records.MARK, "a\x00", "\x00|word|"], 1000)):
        ids_of = records.WordIds(path)
        ids_of.tokenizer = Counted(ids_of.tokenizer)
        raw = [w.encode() for w in listed]
        size = np.array([len(x) for x in raw])
        end = np.cumsum(size)
        at, n = ids_of.tokenised(np.frombuffer(b"".join(raw), np.uint8), end - size, end)
        assert [ids_of.pool[a : a + k].tolist() for a, k in zip(at, n, strict=True)] == [plain.encode(w, add_special_tokens=False).ids for w in listed]
        assert ids_of.size == plain.get_vocab_size() and sum(calls) <= most
        calls.clear()


def test_records_are_written_from_small_batches(spark, tmp_path, monkeypatch):
    """As stored steps are: a worker and the JVM hold a few MB of texts at a time."""
    import public_tokenizers

    from docquarry.llm.shared import SENT, SENT_BYTES

    docs, seen = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), []
    real, before = type(docs).collect, spark.conf.get(SENT)
    monkeypatch.setattr(type(docs), "collect", lambda self: seen.append(spark.conf.get(SENT)) or real(self))
    records.write_records(docs, f"file://{tmp_path}/r", public_tokenizers.path("word_bpe_49k.json"), files=1)
    assert seen[-1].removesuffix("b") == str(SENT_BYTES) and spark.conf.get(SENT) == before
