"""Responses that arrive in a folder, as a stream: each URL once, cleaned and appended as it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.url import canonical_key
from ..operators.lines import strip_tags

SCHEMA = "url string, fetched timestamp, html string"


def landing(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """New responses below path; a URL that comes again within `late` is dropped, so that state stays bounded."""
    rows = spark.readStream.schema(SCHEMA).parquet(path).withColumn("key", canonical_key(F.col("url")))
    return rows.withWatermark("fetched", late).dropDuplicatesWithinWatermark(["key"])


def cleaned(stream: DataFrame) -> DataFrame:
    return stream.select("key", "url", "fetched", strip_tags(F.coalesce("html", F.lit(""))).alias("text"))


def arrivals(stream: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Responses by window of arrival."""
    return stream.groupBy(F.window("fetched", width)).agg(F.count(F.lit(1)).alias("n"))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
