"""N-gram Jaccard join by universe partition and the pigeonhole principle, exact for the threshold num / den.

Texts with equal sets of shingles form a class; one document stands for it. Sizes fall into bands so narrow that links
join the same band or neighbouring ones. In the group of a band b, which holds b and the band below, two linked sets
differ in at most H shingles. Shingles are hashed into segments: with allotments of 1 (equal segments) or 2 (segments
at most one shingle apart, found by one-deletion neighbourhoods) that sum to H + 1, some segment of any linked pair
meets its allotment. The number of segments with allotment 2 is the one with the least estimated cost: signatures
stored, plus pairs of unrelated sets that share a short segment by chance, which grow with the square of a band.

Classes that share a signature are candidates. They are verified on whole sets, in three rounds: each class with the
central class of the buckets it shares most; central classes again with what is still in another component; and then
all pairs of different components that share a bucket. Whole sets are compared only for pairs whose parity sketches
allow a link. Pairs within a component
need no look, as components are what is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golomb, words
from .components import components
from .shared import forget, materialise, shuffle_parts, small

U = np.uint64
NUM, DEN = 90, 100
SHINGLE = 3
BATCH = 1 << 20
SKETCH, WIDE = 16, 128  #: longs of a parity sketch, and of the wider one for pairs that the first leaves
FP = 48  #: bits of a signature by which shared ones are found; chance agreements only send a signature more
#: Signatures that a task codes at once, and that an owner of fingerprints gets, on average.
SENT, OWNED = 1_000_000, 2_000_000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order: hashes of `size` consecutive words, or of all words
    where there are fewer."""
    data, offsets = words.buffers(texts)
    w = words.split(data, offsets)
    n = len(w.hash)
    left = np.repeat(w.counts, w.counts) - (np.arange(n) - np.repeat(w.first(), w.counts))  # words from here on
    total = np.repeat(w.counts, w.counts)
    h = words.mix(w.hash + U(1))
    for k in range(1, size):
        more = words.pair(h[: n - k] if n > k else h[:0], w.hash[k:])
        long = left[: len(more)] > k
        h[: len(more)][long] = more[long]
    keep = (left >= size) | ((total < size) & (left == total))
    row, h = w.doc[keep].astype(np.int64), h[keep]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def bands(top: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Lower ends of the bands of sizes, from 1 to beyond top."""
    lows = [1]
    while lows[-1] <= top:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * den // num)))
    return np.array(lows, np.int64)


def most_apart(hi: int, num: int = NUM, den: int = DEN) -> int:
    """The largest difference of two linked sets of at most hi shingles each."""
    return (den - num) * 2 * hi // (den + num)


def allot(hi: int, docs: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """(segments, how many of them have allotment 2) for the group whose largest size is hi, with so many documents.

    The allotments sum to most_apart + 1 and some spare ones. Spare ones let a set leave its light segments out of the
    index, see signatures(): sets that are empty there agree by chance. The cost is that of the signatures, plus that of
    pairs that agree by chance."""
    least = most_apart(hi, num, den) + 1
    low = max(1, hi * num * num // (den * den))  # the smallest sets of the group have the most light segments
    best = (float("inf"), least, 0)
    for two in sorted({0, least // 4, least // 2}):
        mean = low / max(1, least - two)
        light = float(np.exp(-mean))
        weight = (least - 2 * two) * light + 2 * two * light * (1 + mean)  # of a set's light segments
        for deviations, over in ((None, 1.0), (1, 0.16), (2, 0.03), (3, 3e-3), (4, 3e-4), (6, 3e-6)):
            spare = 0 if deviations is None else int(np.ceil(weight + deviations * weight**0.5))
            m = least + spare - two
            chance = max(light * (1 + two / m * mean), spare / m) * over if m > 1 else 0.0
            best = min(best, (docs * (m + two * hi / m) + m * (chance * docs) ** 2 / 2, m, two))
    return best[1], best[2]


def _sizes(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words.kept("jaccard")
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            row, h = shingle_sets(batch["text"].slice(i, j - i), size)
            n = np.bincount(row, minlength=j - i)
            prints = []
            for salt in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
                sums = np.zeros(j - i, U)
                np.add.at(sums, row, words.mix(h ^ salt))
                prints.append(sums.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(n.astype(np.int64)), *map(pa.array, prints)], names=["doc_id", "n", "fp1", "fp2"])


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def signatures(row: np.ndarray, h: np.ndarray, rows: int, lows: np.ndarray, plans: list[tuple[int, int]], spare: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, ordered by set, and how many each has. plans: (segments, twos) of each group.

    A segment is light if a signature of it may be that of no shingles at all: an empty one, or one of a single shingle
    whose allotment is 2. spare: by how much a group's allotments exceed what linked sets need. A set whose light
    segments weigh no more than that meets a linked set in a segment that isn't light, and leaves the signature of no
    shingles out; two sets that both weigh more keep it."""
    n = np.bincount(row, minlength=rows)
    band = np.searchsorted(lows, n, "right") - 1
    mixed = words.mix(h ^ U(0xA0761D6478BD642F))
    segments, two = np.array([p[0] for p in plans]), np.array([p[1] for p in plans])
    extra = np.array(spare if spare is not None else [0] * len(plans))
    owner, sig = [], []
    for step in (0, 1):
        group = np.where(n > 0, band + step, 0)
        m = np.where(n > 0, segments[group], 0)
        twos = two[group]
        base = np.cumsum(m) - m
        place = words.mix(h + U(1) + group[row].astype(U) * U(0x9E3779B97F4A7C15))
        seg = (((place >> U(32)) * m[row].astype(U)) >> U(32)).astype(np.int64)
        at = base[row] + seg
        size = np.bincount(at, minlength=int(m.sum()))
        content = np.zeros(len(size), U)
        np.add.at(content, at, mixed)
        who = np.repeat(np.arange(rows), m)
        number = np.arange(len(content)) - np.repeat(base, m)
        double = number < twos[who]
        light = np.bincount(who, (size <= double) * (1 + double), minlength=rows)
        empty = (light > extra[group])[who]  # whether the signature of no shingles is kept
        tag = words.mix(group[who].astype(U) << U(32) | number.astype(U))
        keep = (size > 0) | empty
        owner.append(who[keep])
        sig.append(words.mix(content ^ tag)[keep])
        del_ = (seg < twos[row]) & ((size[at] > 1) | empty[at])
        if del_.any():
            owner.append(row[del_])
            sig.append(words.mix((content[at[del_]] - mixed[del_]) ^ tag[at[del_]]))
    owner, sig = np.concatenate(owner), np.concatenate(sig)
    order = np.argsort(owner, kind="stable")
    return sig[order], np.bincount(owner, minlength=rows)


def _signatures(rows: Iterator[pa.RecordBatch], size: int, lows: np.ndarray, plans: list[tuple[int, int]], spare: list[int]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes of sets, signatures, how many each set has) for a few texts at a time."""
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            row, h = shingle_sets(batch["text"].slice(i, j - i), size)
            sig, counts = signatures(row, h, j - i, lows, plans, spare)
            yield batch["doc_id"].slice(i, j - i), np.bincount(row, minlength=j - i).astype(np.int64), sig, counts


def _signed(parts: Iterator) -> Iterator[pa.RecordBatch]:
    for ids, n, sig, counts in parts:
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), _lists(sig, counts)], names=["id", "n", "sigs"])


def _coded(parts: Iterator, owners: int) -> Iterator[pa.RecordBatch]:
    """Golomb-coded fingerprints (the upper FP bits of signatures), one blob for each owner of a range of them."""
    kept: list[np.ndarray] = []

    def blobs() -> pa.RecordBatch:
        fp = np.sort(np.concatenate(kept))
        kept.clear()
        own = ((fp >> U(FP - 32)) * U(owners)) >> U(32)
        which, first = np.unique(own, return_index=True)
        coded = [golomb.encode(x, (1 << FP) // owners) for x in np.split(fp, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(coded, pa.binary())], names=["owner", "blob"])

    for _, _, sig, _ in parts:
        kept.append(sig >> U(64 - FP))
        if sum(map(len, kept)) > SENT:
            yield blobs()
    if kept:
        yield blobs()


def _repeated(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
    """Fingerprints that an owner was sent more than once, and how often."""
    fp, times = np.unique(np.concatenate([golomb.decode(b) for b in blobs["blob"]]), return_counts=True)
    words.trim()
    return pd.DataFrame({"fp": fp[times > 1].astype(np.int64), "size": times[times > 1]})


def _parity(row: np.ndarray, h: np.ndarray, rows: int, longs: int) -> pa.Array:
    """A sketch of each set: bit k is the parity of the shingles whose hash is k modulo the number of bits."""
    bits = words.mix(h ^ U(0x2545F4914F6CDD1D)) % U(64 * longs)
    out = np.zeros(rows * longs, U)
    np.bitwise_xor.at(out, row * longs + (bits >> U(6)).astype(np.int64), U(1) << (bits & U(63)))
    return _lists(out, np.full(rows, longs))


def _sketches(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            row, h = shingle_sets(batch["text"].slice(i, j - i), size)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(np.bincount(row, minlength=j - i).astype(np.int64)), _parity(row, h, j - i, SKETCH)], names=["id", "n", "sketch"])


def _sets(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i, j in words.batches(batch["text"], BATCH):
            row, h = shingle_sets(batch["text"].slice(i, j - i), size)
            n = np.bincount(row, minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(n.astype(np.int64)), _parity(row, h, j - i, WIDE), _lists(h, n)], names=["id", "n", "sketch", "shingles"])


def _close(n: Column, m: Column, num: int, den: int) -> Column:
    return F.least(n, m) * den >= F.greatest(n, m) * num


def _fits(a: str, b: str, num: int, den: int, longs: int = SKETCH) -> Column:
    """Whether sizes (n_a, n_b) and parity sketches allow a link: sketches differ in no more bits than sets in shingles."""
    if longs <= SKETCH:
        differ = sum((F.bit_count(F.col(f"sketch_{a}")[k].bitwiseXOR(F.col(f"sketch_{b}")[k])) for k in range(longs)), F.lit(0))
    else:
        differ = F.aggregate(F.zip_with(f"sketch_{a}", f"sketch_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _close(F.col(f"n_{a}"), F.col(f"n_{b}"), num, den) & (differ * (den + num) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (den - num))


def _sketched(pairs: DataFrame, sketches: DataFrame, num: int, den: int, longs: int) -> DataFrame:
    """The pairs (a, b) that the sketches allow."""
    a, b = (sketches.select(*(F.col(c).alias(k if c == "id" else f"{c}_{k}") for c in ("id", "n", "sketch"))) for k in ("a", "b"))
    return materialise(pairs.select("a", "b").join(a, "a").join(b, "b").where(_fits("a", "b", num, den, longs)).select("a", "b").distinct(), "likely")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with one of the ids (id), a table."""
    return docs.join(small(ids, ids.count(), 16), F.col("doc_id") == F.col("id"), "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets really reach the threshold. Whole sets are made only where the sketches allow it."""
    likely = _sketched(pairs, sketches, num, den, SKETCH)
    ids = materialise(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "likely-ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = materialise(_of(docs, ids).mapInArrow(lambda it: _sets(it, size), f"id {kind}, n long, sketch array<long>, shingles array<long>"), "sets")
    forget(ids)
    first, likely = likely, _sketched(likely, sets, num, den, WIDE)
    forget(first)
    x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"shingles_{k}")) for k in ("a", "b"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    reach = both * den >= (F.size("shingles_a") + F.size("shingles_b") - both) * num
    links = materialise(likely.join(x, "a").join(y, "b").where(reach).select("a", "b"), "links")
    forget(likely, sets)
    return links


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, class_id.

    Lower case is made of A-Z alone; words are runs of other bytes than space and U+0009 to U+000D. Documents link when
    den * intersection >= num * union of their sets of `size`-word shingles; component_id is the smallest doc_id that links
    reach. class_id: the smallest doc_id with the same set. Texts that are null, empty or without words have no shingle
    and no link. Rows that share an id are one node; a null id is linked with nothing. Shingles are told apart by
    64-bit hashes, sets by 128 bits. Very long texts are taken whole. An empty table gives an empty result. Extra
    columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    light = materialise(docs.mapInArrow(lambda it: _sizes(it, size), f"doc_id {kind}, n long, fp1 long, fp2 long"), "set-sizes")
    full = light.where("n > 0 and doc_id is not null")
    top = full.agg(F.max("n")).first()[0]
    if top is None:
        return light.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    classes = full.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    several = materialise(classes.where("copies > 1").drop("copies"), "classes")
    n_several = several.count()
    known = materialise(light.join(small(several, n_several, 48), ["fp1", "fp2", "n"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("class_id")).alias("class_id")), "members")
    forget(light, several)
    others = known.where("class_id is not null and class_id <> doc_id").select(F.col("doc_id").alias("id"))
    lows = bands(top, num, den)
    # Documents of each group: those of its band and of the band below.
    edges = F.array(*(F.lit(int(x)) for x in lows))
    sizes = known.where("n > 0").groupBy("n").count()
    per_band = dict(sizes.groupBy((F.size(F.filter(edges, lambda x: x <= F.col("n"))) - 1).alias("band")).agg(F.sum("count")).collect())
    ends = [*(lows[1:] - 1).tolist(), int(lows[-1] * den // num), int(lows[-1] * den * den // num // num)]
    plans = [allot(hi, per_band.get(b, 0) + per_band.get(b - 1, 0), num, den) for b, hi in enumerate(ends)]
    spare = [m + two - most_apart(hi, num, den) - 1 for (m, two), hi in zip(plans, ends, strict=True)]
    expected = sum(n * sum(m + two * ends[b + g] // m for g, (m, two) in enumerate(plans[b : b + 2])) for b, n in per_band.items())
    owners = max(shuffle_parts(spark), -(-expected // OWNED))
    one_each = docs.where("doc_id is not null").join(small(others, others.count(), 16), F.col("doc_id") == F.col("id"), "left_anti")
    # Signatures are made twice: as fingerprints of a few bytes that tell which are shared, then in full for those alone.
    coded = one_each.mapInArrow(lambda it: _coded(_signatures(it, size, lows, plans, spare), owners), "owner int, blob binary")
    shared = materialise(coded.groupBy("owner").applyInPandas(_repeated, "fp long, size long"), "shared")
    signed = one_each.mapInArrow(lambda it: _signed(_signatures(it, size, lows, plans, spare)), f"id {kind}, n long, sigs array<long>")
    sigs = signed.select("id", "n", F.explode("sigs").alias("sig")).withColumn("fp", F.shiftrightunsigned("sig", 64 - FP))
    buckets = materialise(sigs.join(shared.hint("shuffle_hash"), "fp").drop("fp"), "buckets")
    forget(shared)
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    members = materialise(buckets.drop("size").join(degree, "id"), "bucket-members")
    forget(buckets)
    ids = materialise(members.select("id").distinct(), "candidates")
    sketches = materialise(_of(docs, ids).mapInArrow(lambda it: _sketches(it, size), f"id {kind}, n long, sketch array<long>"), "sketches")
    central = F.max(F.struct("degree", "id", "n"))

    def stars(rows: DataFrame) -> DataFrame:
        hubs = materialise(rows.groupBy("sig").agg(central.alias("hub")), "hubs")  # a plain table, so that skewed joins with it can be split
        return rows.join(hubs, "sig").where((F.col("id") != F.col("hub.id")) & _close(F.col("n"), F.col("hub.n"), num, den))

    first = stars(members).groupBy("id", F.col("hub.id").alias("hub")).agg(F.count(F.lit(1)).alias("times"))
    best = first.groupBy(F.col("id").alias("b")).agg(F.max_by("hub", F.struct("times", "hub")).alias("a"))
    links = _verified(best, docs, sketches, size, num, den)
    comps = components(links)

    def apart(comps: DataFrame) -> DataFrame:
        """Members of buckets that still hold several components."""
        own = members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = own.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
        return materialise(own.join(materialise(mixed, "mixed"), "sig"), "apart")

    left = apart(comps)
    if not left.isEmpty():
        hubs = materialise(left.groupBy("sig").agg(F.max(F.struct("degree", "id", "n", "comp")).alias("hub")), "hubs")
        again = left.join(hubs, "sig").where((F.col("comp") != F.col("hub.comp")) & _close(F.col("n"), F.col("hub.n"), num, den))
        pairs = again.select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
        links = links.union(_verified(pairs, docs, sketches, size, num, den))
        comps = components(links)
        left = apart(comps)
    if not left.isEmpty():
        drawn = left.join(sketches.select("id", "sketch"), "id")
        x, y = (drawn.select("sig", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "comp", "sketch"))) for k in ("a", "b"))
        fits = (F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b")) & _fits("a", "b", num, den)
        pairs = x.join(y, (x["sig"] == y["sig"]) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        links = links.union(_verified(pairs, docs, sketches, size, num, den))
        comps = components(links)
    forget(members, sketches)
    node = F.coalesce("class_id", "doc_id")
    found = comps.select(F.col("id").alias("node"), "comp")
    return known.withColumn("node", node).join(small(found, found.count(), 24), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component_id"), F.col("node").alias("class_id"))
