"""Columns whose names are those that operators use themselves, and results that don't depend on how rows are dealt."""

from fractions import Fraction

from pyspark.sql import functions as F

from docquarry.llm import queries
from docquarry.llm.decontam import without_contaminated
from docquarry.llm.mixing import mix
from tests.llm.test_operators import DDL, ROWS

NAMES = ("_row", "_words", "own", "none", "_domain", "_lang", "_source", "_tag", "_end", "_place", "_block", "_budget", "w", "row", "words")


def named(spark):
    docs = spark.createDataFrame(ROWS, DDL).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})
    return docs.repartition(3)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_decontamination_keeps_columns_of_any_name(spark):
    items = spark.createDataFrame([(1, ROWS[11][1][:200])], "item_id long, text string")
    docs = named(spark)
    got = without_contaminated(docs, items)
    plain = {r["doc_id"] for r in without_contaminated(docs.select("doc_id", "text"), items).collect()}
    assert got.columns == docs.columns and 0 < len(plain) < len(ROWS)
    assert rows(got) == rows(docs.where(F.col("doc_id").isin(plain)))


def test_mixture_keeps_columns_of_any_name(spark):
    docs = named(spark).drop("epoch")
    got = mix(docs, Fraction(1, 2), F.col("source"), {}, seed="n")
    plain = {r["doc_id"] for r in mix(docs.select("doc_id", "text", "lang", "source"), Fraction(1, 2), F.col("source"), {}, seed="n").collect()}
    assert got.columns == [*docs.columns, "epoch", "mix_tokens"] and 0 < len(plain) < len(ROWS)
    assert rows(got.drop("epoch", "mix_tokens")) == rows(docs.where(F.col("doc_id").isin(plain)))


def test_languages_do_not_depend_on_the_deal(spark, sf_dir, tmp_path):
    """The same documents in one file in order, and in seven files in another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = []
    for n, order in ((1, "doc_id"), (7, "text")):
        docs.repartition(n, "doc_id").sortWithinPartitions(order).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found.append(rows(queries.op1_language_id(spark, f"{tmp_path}/{n}")))
    assert found[0] == found[1]
