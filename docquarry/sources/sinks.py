"""Sinks: results and texts by Spark's own commit protocol, the error log, and exports for other programs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..lexicons import ERROR_LOG_COLUMNS


def error_rows(results: DataFrame) -> DataFrame:
    """The columns of the error log, as strings, of results that went wrong; missing columns and nulls are empty."""
    s = F.col("status")
    bad = ~(F.startswith(s, F.lit("OK")) | F.startswith(s, F.lit("SKIPPED")) | (s == "DRY_RUN"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in results.columns else F.lit("")
    return results.where(bad).select(*(text(c).alias(c) for c in ERROR_LOG_COLUMNS))


BOM = "\ufeff"


def write_error_log(results: DataFrame, path: str, enabled: bool = True) -> bool:
    """Writes the log as CSV, each file opened by a BOM; a clean run leaves no log, not even that of a run before it.
    Returns whether there was something to write."""
    if not enabled:
        return False
    rows = error_rows(results)
    some = not rows.isEmpty()
    if not some:
        context = results.sparkSession.sparkContext
        old = context._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
        return False
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return some


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*(c.removeprefix(BOM) for c in rows.columns)).na.fill("")


class FileWriter(DataSourceArrowWriter):
    """A task writes its files to a folder of the run beside the targets; when all tasks have ended well the driver moves
    them to their places, and removes the originals that they replace. Otherwise no target has been touched, and the
    folder goes. Files of attempts that failed are in no message and go with it."""

    def __init__(self, path: str, bom: bool) -> None:
        self.path, self.bom = path.rstrip("/"), bom
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = self._store()
        staging = root + self.staging[len(self.path) :]
        store.create_dir(staging, recursive=True)
        moves = []
        for batch in iterator:
            replaced = batch["replaces"].to_pylist() if "replaces" in batch.schema.names else [None] * len(batch)
            for target, content, old in zip(batch["target"].to_pylist(), batch["content"].to_pylist(), replaced, strict=True):
                data = content if isinstance(content, bytes) else (content or "").encode("utf-8-sig" if self.bom else "utf-8")
                staged = f"{staging}/{uuid.uuid4().hex}"
                with store.open_output_stream(staged) as out:
                    out.write(data)
                moves.append((staged, target, old))
        return Moves(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        moves = [x for m in messages if m is not None for x in m.moves]
        if len({t for _, t, _ in moves}) < len(moves):
            raise ValueError("two rows have the same target")

        def place(move: tuple[str, str, str | None]) -> None:
            staged, target, old = move
            store.create_dir(f"{root}/{target}".rpartition("/")[0], recursive=True)
            store.move(staged, f"{root}/{target}")
            if old and old != target and store.get_file_info(f"{root}/{old}").type == fs.FileType.File:
                store.delete_file(f"{root}/{old}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, moves))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = self._store()
        staging = root + self.staging[len(self.path) :]
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


@dataclass
class Moves(WriterCommitMessage):
    moves: list[tuple[str, str, str | None]]


class Files(DataSource):
    """format("docquarry_files"): a file for each row, at its target below path. Columns: target, content (bytes, or a
    text in UTF-8, opened by a BOM if the option bom is set), and replaces, a file that goes when this one is there."""

    @classmethod
    def name(cls) -> str:
        return "docquarry_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("bom", "false") == "true")


def write_files(rows: DataFrame, path: str, bom: bool = False) -> None:
    """rows: target, content and perhaps replaces, one for each target, as files below path: all of them, or none."""
    spark = rows.sparkSession
    spark.dataSource.register(Files)
    keep = [c for c in ("target", "content", "replaces") if c in rows.columns]
    clashes = rows.groupBy("target").count().where("count > 1")
    if not clashes.isEmpty():
        raise ValueError(f"two rows have the same target: {clashes.first()['target']}")
    rows.select(*keep).write.format("docquarry_files").mode("append").option("path", path).option("bom", str(bom).lower()).save()


def write_texts(texts: DataFrame, path: str, existing: DataFrame | None = None, overwrite: bool = False) -> None:
    """target, text: texts whose target isn't there yet are added; all of them where overwrite is set."""
    rows = texts if existing is None or overwrite else texts.join(existing.select("target").distinct(), "target", "left_anti")
    rows.write.mode("overwrite" if overwrite else "append").parquet(path)
