"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The tree is domain > language > source. A budget of tokens goes from the root to the leaves by the weights of each
node's children. A leaf can give at most epochs x its tokens; what it lacks goes to its siblings that still have some,
by their weights, and only what a whole node lacks is shared out one level further up. The driver works on the tree
alone, whose size is that of the domains, languages and sources. Every leaf then gives the prefix of its documents, in
an order that a seed and the epoch determine, up to its budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, materialise, small

#: Hexadecimal digits of a document's place that make a block of a leaf; a block's documents are ordered in one task.
BLOCK_DIGITS = 3
LEVELS = ("domain", "lang", "source")


@dataclass
class Node:
    weight: int
    supply: int = 0
    budget: int = 0
    children: dict[str, Node] = field(default_factory=dict)


def n_tokens(text: Column) -> Column:
    """White-space words; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACES.replace("[", "[^"))).cast("long")


def share(amount: int, parts: dict[str, tuple[int, int]]) -> dict[str, int]:
    """amount by (weight, supply): nobody gets more than its supply; what one lacks goes to the others, by weight. Whole
    numbers: rounded down, then one more each in order of the lost fraction, then of the name."""
    got = dict.fromkeys(parts, 0)
    amount = min(amount, sum(s for _, s in parts.values()))
    open_ = {k for k, (w, s) in parts.items() if w > 0 and s > 0}
    while open_ and amount > 0:
        total = sum(parts[k][0] for k in open_)
        full = {k for k in open_ if Fraction(amount * parts[k][0], total) >= parts[k][1]}
        if not full:
            exact = {k: Fraction(amount * parts[k][0], total) for k in open_}
            got |= {k: int(v) for k, v in exact.items()}
            for k in sorted(open_, key=lambda k: (int(exact[k]) - exact[k], k))[: amount - sum(int(v) for v in exact.values())]:
                got[k] += 1
            break
        for k in full:
            got[k] = parts[k][1]
            amount -= parts[k][1]
        open_ -= full
    return got


def _spread(node: Node, amount: int) -> int:
    """Budgets below node; returns what the node can't use, which its own siblings then share."""
    if not node.children:
        node.budget = min(amount, node.supply if node.weight > 0 else 0)
        return amount - node.budget
    got = share(amount, {k: (c.weight, c.supply) for k, c in node.children.items()})
    for k, c in node.children.items():
        _spread(c, got[k])
    node.budget = sum(c.budget for c in node.children.values())
    return amount - node.budget


def budgets(leaves: list[tuple[str, str, str, int]], total: int, weights: dict[str, dict[str, int]], epochs: int) -> dict[tuple[str, str, str], int]:
    """leaves: (domain, lang, source, tokens). weights: level -> name -> whole number; 1 where a name isn't listed."""
    root = Node(1)
    for d, lang, s, n in leaves:
        node = root
        for level, name in zip(LEVELS, (d, lang, s), strict=True):
            node = node.children.setdefault(name, Node(weights.get(level, {}).get(name, 1)))
        node.supply = n * epochs

    def supply(node: Node) -> int:
        if node.children:
            node.supply = sum(supply(c) for c in node.children.values() if c.weight > 0)
        return node.supply if node.weight > 0 else 0

    supply(root)
    _spread(root, total)
    return {(d, lang, s): root.children[d].children[lang].children[s].budget for d, lang, s, _ in leaves}


def mix(docs: DataFrame, total: int | Fraction, domain: Column, weights: dict[str, dict[str, int]], epochs: int = 1, seed: str = "0", text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the mixture takes, with epoch (from 0) and mix_tokens added; a row comes once per epoch.

    total: tokens in all, or a Fraction of the tokens of docs. domain: an expression over docs; null domains, languages
    and sources are leaves named "". A document is taken if the tokens before it, in its leaf's order for that epoch,
    are below the leaf's budget for the epoch, so that a leaf exceeds its budget by less than one document. Documents without words cost
    nothing and are taken with the prefix they stand in. Order: md5 of seed, epoch and id; rows with
    equal ids are taken together. Leaves with weight 0 give nothing. An empty table gives an empty result. Columns
    of docs named epoch or mix_tokens are replaced, others are kept, whatever they are called.
    """
    names = [F.coalesce(c.cast("string"), F.lit("")) for c in (domain, F.col(lang), F.col(source))]
    keys = ["_domain", "_lang", "_source"]
    spark = docs.sparkSession
    tag = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    # The columns of docs in one, so that none of their names meets one of these.
    own = F.struct(*(c for c in docs.columns if c not in ("epoch", "mix_tokens")))
    base = docs.select(own.alias("own"), *(c.alias(k) for c, k in zip(names, keys, strict=True)), tag.alias("_tag"))
    tokens = n_tokens(F.col("own")[text])
    light = materialise(base.select(*keys, "_tag", tokens.alias("mix_tokens")), "mix-sizes")
    leaves = [tuple(r) for r in light.groupBy(*keys).agg(F.sum("mix_tokens")).collect()]
    if isinstance(total, Fraction):
        total = int(total * sum(x[3] for x in leaves))
    wanted = budgets(sorted(leaves), total, weights, epochs)
    rows = []
    for *leaf, n in leaves:
        left = wanted[tuple(leaf)]
        for e in range(epochs):
            if (take := min(left, n)) > 0:
                rows.append((*leaf, e, take))
            left -= take
    plan = spark.createDataFrame(rows, "_domain string, _lang string, _source string, epoch int, _budget long")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("_tag")).cast("binary"))
    leaf = [*keys, "epoch"]
    # A leaf's prefix ends in the block in which its budget is reached; only that block's documents are put in order.
    placed = light.join(small(plan, len(rows), 200), keys).withColumn("_place", place).withColumn("_block", F.substring("_place", 1, BLOCK_DIGITS))
    sizes = placed.groupBy(*leaf, "_block", "_budget").agg(F.sum("mix_tokens").alias("n"))
    before = (F.sum("n").over(Window.partitionBy(*leaf).orderBy("_block")) - F.col("n")).alias("_before")
    border = sizes.select(*leaf, "_block", "_budget", "n", before).where("_before < _budget and _before + n >= _budget").select(*leaf, "_block", "_before")
    upto = F.sum("mix_tokens").over(Window.partitionBy(*leaf, "_block").orderBy("_place"))
    own = F.sum("mix_tokens").over(Window.partitionBy(*leaf, "_block", "_place"))
    last = placed.join(small(border, len(rows), 200), [*leaf, "_block"]).withColumn("_upto", upto - own).where(F.col("_before") + F.col("_upto") < F.col("_budget"))
    ends = materialise(last.groupBy(*leaf).agg(F.max("_place").alias("_end")), "mix-ends")
    picked = base.join(small(ends, len(rows), 250), keys).where(place <= F.col("_end"))
    return picked.select("own.*", "epoch", tokens.alias("mix_tokens"))
