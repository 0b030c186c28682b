"""Work folders, table access and size checks shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an operator broadcasts; a larger side goes through a shuffled join instead.
BROADCAST_BYTES = 8 << 20
#: White space of the text contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it. Hadoop's names for S3 are known as well."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


#: Whether the shuffle files of a statement go when it has ended, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a batch that goes to a Python worker: the JVM and the worker each hold some of them at a time.
SENT, SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """While a step is written: its shuffle files go when it has ended, and batches for Python are small."""
    ours = {CLEANUP: "true", SENT: str(SENT_BYTES)}
    before = {k: spark.conf.get(k).removesuffix("b") for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of executors. The shuffle
    files of df aren't needed beyond that and are removed at once."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with lean(spark):
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing is going to read again: what was made of them is stored itself."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.work_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like materialise(), in buckets by a key: tables with equally many buckets are joined on it without a shuffle. The
    files stay in the work folder; the table's name is in the catalogue only while it is looked up."""
    spark, table = df.sparkSession, f"docquarry_{uuid.uuid4().hex}"
    try:
        with lean(spark):
            df.write.bucketBy(buckets, key).option("path", work_dir(spark, name)).saveAsTable(table)
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks df for broadcast if its rows, of at most row_bytes each, have been counted to lie below BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fits(df: DataFrame, *strings: str) -> bool:
    """Whether df's rows, counted with the bytes of their strings and 40 bytes for each column, lie below
    BROADCAST_BYTES. df should be a table, as it is read for that."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(40 * len(df.columns)))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def measured(df: DataFrame, *strings: str) -> DataFrame:
    """Marks df for broadcast if it fits()."""
    return F.broadcast(df) if fits(df, *strings) else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that for strings without other letters, and is far faster."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
