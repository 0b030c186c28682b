"""Tables that a run keeps between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a statement go when it has ended, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary
    folder is chosen once and kept in the session's settings if all runs on one machine; otherwise that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docquarry/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of executors. The shuffle
    files of df aren't needed beyond that and are removed at once."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
