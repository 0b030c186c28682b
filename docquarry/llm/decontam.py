"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds postings of training tokens: (term, row, pos). A search ranks each window's terms by their counts in
the training texts, shifts the postings of the rarest ones by the terms' offsets in the window, and intersects the lists
on (row, start). The other terms' lists are read only around the places that are left, shifted and intersected likewise:
a window matches where the lists of all its terms meet. Postings are stored only of terms that are among some window's
rarest; those of a window's very rarest term carry the postings around them, as the words in their order.

Lower case is made of A-Z alone; words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Rows are told apart by a number
that they get when their words are stored, so that null and repeated ids don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, fits, materialise, measured, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case words of a text, in order; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def numbered(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_row`, a number for each row, and `_words`, stored."""
    return materialise(docs.select("*", words(F.col(text)).alias("_words")).withColumn("_row", F.monotonically_increasing_id()), "texts")


def windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """items: item_id, text. Returns the distinct windows, (w, off, term, len) a row for each of their words, and which
    items hold them: (w, item_id)."""
    x = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    keys = x.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.array_join(F.slice("words", F.col("start"), F.lit(size)), " ").alias("key"))
    keys = materialise(keys.distinct(), "window-keys")
    known = materialise(keys.select("key").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    spelled = known.select("w", F.size(F.split("key", " ")).alias("len"), F.posexplode(F.split("key", " ")).alias("off", "term"))
    return spelled, materialise(keys.join(known, "key").select("w", "item_id"), "window-items")


def ranked(spelled: DataFrame, texts: DataFrame) -> DataFrame:
    """The windows' words with `role`, from 1 for a window's rarest term in the texts; windows with a term that the texts
    lack can't match and are left out."""
    counts = texts.select(F.explode("_words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.join(measured(materialise(spelled.select("term").distinct(), "terms"), "term"), "term"), "term-counts")
    lacking = F.max(F.col("n").isNull()).over(Window.partitionBy("w"))
    role = F.row_number().over(Window.partitionBy("w").orderBy("n", "off"))
    return materialise(spelled.join(counts, "term", "left").withColumn("lacking", lacking).where(~F.col("lacking")).select("w", "len", "off", "term", role.alias("role")), "ranked")


def postings(texts: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """term, row, pos (from 0), lead, around: a row for each occurrence of one of the terms (term, first). Where `first` is
    set, around holds the words from `lead` places before it to reach - 1 places after it."""
    tokens = texts.select(F.col("_row").alias("row"), "_words", F.posexplode("_words").alias("pos", "term"))
    lead = F.least(F.col("pos"), F.lit(reach - 1))
    around = F.array_join(F.slice("_words", F.col("pos") - lead + 1, lead + reach), " ")
    out = ["term", "row", "pos", lead.alias("lead")]
    if fits(terms, "term"):  # what is around a posting is put together for those that stay
        return tokens.join(F.broadcast(terms), "term").select(*out, F.when(F.col("first"), around).alias("around"))
    return tokens.select(*out, around.alias("around")).join(terms, "term").select("term", "row", "pos", "lead", F.when(F.col("first"), F.col("around")).alias("around"))


def phrase_matches(texts: DataFrame, spelled: DataFrame, size: int, rarest: int = 2) -> DataFrame:
    """row, w, start, len: every place where the words of one of the numbered() texts equal those of a window."""
    terms = ranked(spelled, texts)
    lists = materialise(terms.where(F.col("role") <= rarest).select("term", "w", "off", "len", "role", F.expr("shiftleft(1, role - 1)").alias("bit")), "rarest")
    index = materialise(postings(texts, materialise(lists.groupBy("term").agg((F.min("role") == 1).alias("first")), "rare-terms"), size), "postings")
    shifted = index.join(measured(lists, "term"), "term").select("row", "w", (F.col("pos") - F.col("off")).alias("start"), "len", "bit").where("start >= 0")
    every = F.expr(f"shiftleft(1, least({rarest}, len)) - 1")  # a bit for each of the window's rarest terms
    met = materialise(shifted.groupBy("row", "w", "start", "len").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == every).drop("bits"), "rarest-met")
    # The other terms' lists, as they lie around the rarest term of each place where the rarest ones met.
    anchors = materialise(lists.where("role = 1").select("w", "off"), "anchors")
    at = met.where(F.col("len") > rarest).join(measured(anchors), "w").select("row", "w", "start", "len", "off", (F.col("start") + F.col("off")).alias("pos"))
    held = F.slice(F.split("around", " "), F.col("lead") - F.col("off") + 1, F.col("len"))
    near = at.join(index.where("around is not null").select("row", "pos", "lead", "around"), ["row", "pos"]).select("row", "w", "start", "len", F.posexplode(held).alias("off", "term"))
    others = materialise(terms.where(F.col("role") > rarest).select("w", "off", "term"), "other-terms")
    rest = near.join(measured(others, "term"), ["w", "off", "term"]).groupBy("row", "w", "start", "len").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("len") - rarest)
    return materialise(met.where(F.col("len") <= rarest).union(rest.drop("n")), "matches")


def proximity_matches(items: DataFrame, docs: DataFrame, size: int = 10, rarest: int = 2, slop: int = 3) -> DataFrame:
    """doc_id, item_id, start: documents in which all words of a window stand near their places in it. start is the place
    of the window's rarest term less its offset; each other word of the window must stand within `slop` words of its
    own offset from there. Null texts have no words, rows that repeat an id count as one document, a null id is an id.
    Empty tables have no matches."""
    texts = numbered(docs.select("doc_id", "text"))
    spelled, holders = windows(items.select("item_id", "text"), size)
    terms = ranked(spelled, texts)
    first = materialise(terms.where("role = 1").select("term", "w", "off"), "rarest")
    index = materialise(postings(texts, materialise(first.select("term", F.lit(False).alias("first")).distinct(), "rare-terms"), size), "postings")
    starts = index.join(measured(first, "term"), "term").select("row", "w", (F.col("pos") - F.col("off")).alias("start"))
    spelling = materialise(terms.groupBy("w").agg(F.collect_list(F.struct("off", "term")).alias("terms")), "spellings")
    at = starts.join(spelling, "w").join(texts.select(F.col("_row").alias("row"), "doc_id", "_words"), "row")

    def there(x: Column) -> Column:
        lo = F.greatest(F.col("start") + x["off"] - slop, F.lit(0))
        n = F.col("start") + x["off"] + slop + 1 - lo
        return F.array_contains(F.slice("_words", (lo + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")), x["term"])

    return at.where(F.forall("terms", there)).join(holders, "w").select("doc_id", "item_id", "start").distinct()


def _searched(docs: DataFrame, items: DataFrame, size: int, rarest: int, text: str) -> tuple[DataFrame, DataFrame]:
    """The numbered texts, and for the rows with hits: _row, n_hit, n_items, items_sha256."""
    texts = numbered(docs, text)
    spelled, holders = windows(items, size)
    found = phrase_matches(texts, spelled, size, rarest)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["n"],
    )
    ids = F.array_join(F.sort_array(F.collect_set(F.col("item_id").cast("string"))), ",")
    named = found.select("row", "w").distinct().join(holders, "w").groupBy("row").agg(F.count_distinct("item_id").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    hits = found.groupBy("row").agg(covered.alias("n_hit")).join(named, "row")
    return texts, materialise(hits.select(F.col("row").alias("_row"), "n_hit", "n_items", "items_sha256"), "hits")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 2, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside any match), n_items, items_sha256,
    contaminated. A window: `size` consecutive words of an item, or all of them where it has fewer; an item without words
    has none. Null and empty texts have no words and no hits; rows that repeat an id, and rows with a null id, get the
    hits of their own texts. With an empty table of items nothing is hit, an empty table of docs gives an empty result.
    Very long texts are searched whole. Extra columns are ignored.
    """
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    texts, hits = _searched(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, size, rarest, "text")
    light = texts.select("_row", "doc_id", F.size("_words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return light.join(small(hits, hits.count(), 160), "_row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 2, text: str = "text") -> DataFrame:
    """The rows of docs that hold no window of an item, with their columns, whatever these are called. Odd rows and tables
    are treated as contamination() says."""
    others = [c for c in docs.columns if c != text]
    own = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    texts, hits = _searched(docs.select(F.col(text).alias("text"), own.alias("own")), items.select("item_id", "text"), size, rarest, "text")
    kept = texts.join(small(hits, hits.count(), 160), "_row", "left_anti")
    return kept.select(*(F.col("text").alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns))
