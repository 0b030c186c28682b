"""Shards by a k-d tree: nodes are halved by bytes along their widest metadata dimension until the leaves are shards.

Weighted medians come from histograms that Spark sums over all rows: a round counts each open node's bytes in a
bounded number of bins, the driver picks the bin that holds the median, and the next round looks into that bin alone.
What reaches the driver is at most COLLECTED numbers, however many rows there are. Rows are ordered by the dimension,
then by the text's checksum, then by a hash of the id, so that a border passes between groups of equal texts unless it
has to fall within one. Borders are tables that rows are joined with, one for each level of the tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, shuffle_parts, small

#: Bins of a node's histogram in each round, and bins of all nodes together.
BINS, COLLECTED = 1024, 1 << 20
#: Least number of chunks in which the rows of a shard are numbered, and rows of a chunk on average.
CHUNKS, CHUNK_ROWS = 64, 500_000
#: Part of a shard's bytes by which a border may miss to keep equal values together.
SLACK = 0.01
NONE, ALL = -1, (1 << 62) - 1  #: borders below and above all checksums and ties


@dataclass
class Node:
    """Shards first..last, and the box of values that each dimension takes in the node's rows."""

    id: int
    first: int
    last: int
    weight: int = 0
    box: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def shards(self) -> int:
        return self.last - self.first + 1


def _boxes(rows: DataFrame, nodes: dict[int, Node], dims: list[str]) -> None:
    aggs = [F.sum("weight").alias("w"), *(f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max)))]
    for r in rows.groupBy("node").agg(*aggs).collect():
        if n := nodes.get(r["node"]):
            n.weight, n.box = r["w"], {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for d in dims}


def _widest(n: Node, dims: list[str], spans: dict[str, int]) -> str | None:
    """The dimension that takes the largest part of its whole range within the node; the first one if several do."""
    wide = [d for d in dims if n.box[d][1] > n.box[d][0]]
    return max(wide, key=lambda d: (n.box[d][1] - n.box[d][0]) / spans[d], default=None)


def _value(dims: list[str]) -> Column:
    return F.element_at(F.array(*(F.col(d) for d in dims)), F.col("dim") + 1)


def _medians(rows: DataFrame, open_: dict[int, tuple[int, int, float]], value: Column, extra: list[tuple], kind: str) -> dict[int, tuple[int, float, float]]:
    """open_: node -> (lowest, highest, bytes wanted on the left). value: an expression over rows and the columns of
    `extra`, which are those of a table (node, ...) with the DDL `kind`. Returns node -> (v, bytes below v, bytes at v),
    with the wanted bytes reached at v."""
    spark = rows.sparkSession
    known = {x[0]: x[1:] for x in extra}
    state = {k: [lo, hi, want, 0.0] for k, (lo, hi, want) in open_.items()}
    found: dict[int, tuple[int, float, float]] = {}
    while state:
        bins = max(2, min(BINS, COLLECTED // len(state)))
        step = {k: max(1, -(-(hi - lo + 1) // bins)) for k, (lo, hi, _, _) in state.items()}
        table = spark.createDataFrame([(k, *known[k], x[0], x[1], step[k]) for k, x in state.items()], f"node long, {kind}, lo long, hi long, step long")
        near = rows.join(small(table, len(state), 80), "node").select("node", "weight", value.alias("v"), "lo", "hi", "step").where("v between lo and hi")
        sums: dict[int, dict[int, int]] = {k: {} for k in state}
        for r in near.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("weight").alias("w")).collect():
            sums[r["node"]][r["bin"]] = r["w"]
        for k in list(state):
            lo, hi, want, below = state[k]
            for b, w in sorted(sums[k].items()):
                if below + w >= want or b == max(sums[k]):
                    break
                below += w
            if step[k] == 1:
                found[k] = (lo + b, below, sums[k][b])
                del state[k]
            else:
                state[k] = [lo + b * step[k], min(hi, lo + (b + 1) * step[k] - 1), want, below]
    return found


def _descended(rows: DataFrame, borders: list[tuple[int, int, int, int, int]], dims: list[str]) -> DataFrame:
    """rows with `node` replaced by its child, where borders has the node: (node, dim, value, crc, tie). Rows up to the
    border, in the order of the dimension's value, the checksum and the tie, go left."""
    table = rows.sparkSession.createDataFrame(borders, "node long, dim int, b_v long, b_crc long, b_tie long")
    v = _value(dims)
    left = (v < F.col("b_v")) | ((v == F.col("b_v")) & ((F.col("crc") < F.col("b_crc")) | ((F.col("crc") == F.col("b_crc")) & (F.col("tie") <= F.col("b_tie")))))
    child = F.when(F.col("b_v").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))
    kept = [c for c in rows.columns if c != "node"]
    return rows.join(small(table, len(borders), 80), "node", "left").select(*kept, child.alias("node"))


def kd_shards(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id", dims: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: the shards' sizes, UTF-8 bytes plus 8 for each row, are as near equal as the rows allow: a node of s
    shards gives floor(s / 2) of them that part of its bytes. shards, or the number that makes a leaf at most
    target_bytes on average. dims: integer expressions over docs, by default what is known of the text: its bytes, its
    bytes beyond one for each character, and its spaces, so that equal texts have equal places. A border in a run of
    equal values passes between texts, by their checksums, and within a group of equal texts, by a hash of the id, only
    if the sizes were more than SLACK of a shard off otherwise; rows with equal ids and texts lie on one side. A null
    text has no bytes; null dims count as 0. With fewer rows than shards, some shards are empty; an empty table gives
    no rows. Very long texts are rows like others. Other columns are ignored.
    """
    spark = docs.sparkSession
    written = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(written).cast("long") + 8
    crc = F.crc32(written.cast("binary"))
    if dims is None:
        dims = {"d_bytes": size, "d_wide": F.octet_length(written) - F.char_length(written), "d_spaces": F.char_length(written) - F.char_length(F.replace(written, F.lit(" "), F.lit("")))}
    names = [f"_{i}" for i in range(len(dims))]
    tie = F.xxhash64(F.col(doc_id), F.lit("kd")).bitwiseAND(F.lit((1 << 52) - 1))
    base = materialise(docs.select(F.col(doc_id).alias("doc_id"), size.alias("weight"), crc.alias("crc"), tie.alias("tie"), *(F.coalesce(e, F.lit(0)).cast("long").alias(d) for d, e in zip(names, dims.values(), strict=True))), "metadata")
    count, total = base.agg(F.count(F.lit(1)), F.sum("weight")).first()
    if shards is None:
        shards = max(1, math.ceil((total or 0) / (target_bytes or 1 << 30)))
    rows = base.withColumn("node", F.lit(1).cast("long"))
    nodes = {1: Node(1, 0, shards - 1)}
    leaves: dict[int, Node] = {}
    spans: dict[str, int] = {}
    while nodes:
        _boxes(rows, nodes, names)
        spans = spans or {d: max(1, hi - lo) for d, (lo, hi) in nodes[1].box.items()}
        leaves |= {k: n for k, n in nodes.items() if n.shards == 1 or not n.box}
        nodes = {k: n for k, n in nodes.items() if k not in leaves}
        if not nodes:
            break
        left = {k: n.shards // 2 for k, n in nodes.items()}
        want = {k: n.weight * left[k] / n.shards for k, n in nodes.items()}
        dim = {k: names.index(_widest(n, names, spans) or names[0]) for k, n in nodes.items()}
        # A border's value, then the checksum within the run of that value, then the tie within one text.
        cut: dict[int, list[int]] = {k: [dim[k]] for k in nodes}
        open_ = {k: (*nodes[k].box[names[dim[k]]], want[k]) for k in nodes}
        for level, value in enumerate((_value(names), F.when(_value(names) == F.col("b_v"), F.col("crc")), F.when((_value(names) == F.col("b_v")) & (F.col("crc") == F.col("b_crc")), F.col("tie")))):
            kind = "dim int" + ", b_v long" * (level > 0) + ", b_crc long" * (level > 1)
            deeper = {}
            for k, (v, below, at) in _medians(rows, open_, value, [(k, *cut[k]) for k in open_], kind).items():
                miss_right, miss_left = open_[k][2] - below, below + at - open_[k][2]
                cut[k].append(v)
                if level < 2 and min(miss_left, miss_right) > SLACK * nodes[k].weight / nodes[k].shards:
                    deeper[k] = (0, (1 << (32 if level == 0 else 52)) - 1, miss_right)
                elif miss_left <= miss_right:  # the whole run goes left
                    cut[k] += [ALL] * (2 - level)
                elif level == 2:
                    cut[k][-1] = v - 1
                else:
                    cut[k] += [NONE] * (2 - level)
            open_ = deeper
        rows = _descended(rows, [(k, *cut[k]) for k in nodes], names)
        nodes = {c: Node(c, a, b) for k, n in nodes.items() for c, a, b in ((2 * k, n.first, n.first + left[k] - 1), (2 * k + 1, n.first + left[k], n.last))}
    places = spark.createDataFrame([(k, n.first) for k, n in leaves.items()], "node long, shard int")
    # Slots: rows are numbered within a chunk of a shard, after the counts of the chunks before it.
    chunks = max(CHUNKS, shuffle_parts(spark), -(-count // (shards * CHUNK_ROWS)))
    rows = rows.join(small(places, len(leaves), 40), "node").withColumn("chunk", F.pmod(F.col("tie"), F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("tie", "doc_id")) - 1
    return rows.withColumn("number", number).join(before, ["shard", "chunk"]).select(
        "doc_id", F.col("weight").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("number") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
