"""A training corpus from documents: toxic texts go, near copies are merged, benchmark passages are taken out, sources
are mixed to their weights, and what is left is written as binary token records.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.decontam import without_contaminated
from docquarry.llm.jaccard_join import jaccard_components
from docquarry.llm.mixing import mix
from docquarry.llm.queries import MIX_WEIGHTS, TOKENIZER, domain
from docquarry.llm.records import token_records
from docquarry.llm.shared import materialise, small, table
from docquarry.llm.toxicity import without_toxic

#: Near copies: words of a shingle, and the least Jaccard similarity as a fraction.
NEAR = {"size": 5, "num": 80, "den": 100}
#: Part of the tokens that the mixture takes.
MIXED = Fraction(9, 10)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text scores 0.5 or more. Null and empty texts stay unless a text without words does; each row
    is judged by its own text, whatever its id; an empty table stays empty."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the rows with the smallest doc_id. Texts without words and rows with a null id
    are in no group and stay; rows that share an id are one document and stay or go together; an empty table stays
    empty."""
    ids = materialise(jaccard_components(docs, **NEAR).where("component_id <> doc_id").select("doc_id"), "dropped")
    return docs.join(small(ids, ids.count(), 100), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds ten consecutive words of a benchmark item, or all of a shorter one. Null and empty
    texts stay; ids don't matter; with no items all rows stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps MIXED of the words, by the weights. Null languages and sources are leaves of their own; texts without words
    cost nothing and go with the prefix they stand in; rows with equal ids are taken together."""
    return mix(docs, MIXED, domain(), MIX_WEIGHTS, epochs=1, seed="mix-1").select(docs.columns)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all rows as records and gives one row for each: a null text has the end id alone, null ids come first, rows
    that share an id follow each other; an empty table gives no rows."""
    return token_records(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("mixing sources", mixing), ("token records", records)]

#: The first stage's model is beyond SQL; a brute-force version of the other stages is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
