"""HTML files as a source, and cleaned texts beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import decode
from .html_tree import main_text


def html_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """page_id (the path), url, html of each file; UTF-8 with or without a mark, broken bytes replaced."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    text = decode(rows.select(F.col("path").alias("page_id"), F.col("content").alias("body")), "page_id")
    return text.select("page_id", F.col("page_id").alias("url"), F.regexp_replace("text", "^﻿", "").alias("html"))


def cleaned_files(pages: DataFrame) -> DataFrame:
    """target (<stem>.clean.txt beside the page), text."""
    texts = main_text(pages)
    return texts.select(F.concat(F.regexp_replace("page_id", r"\.[^./]*$", ""), F.lit(".clean.txt")).alias("target"), "text")
