"""Registries: tables of DOCX files whose rows name a document, a folder and links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_space
from ..functions.url import force_scheme
from .formats import docx_tables

CELL = "struct<text string, links array<string>>"
ROWS = f"registry string, table_no int, row_no int, cells array<{CELL}>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("links", pa.list_(pa.string()))]))
ROLES = ("document", "folder", "link")


def _rows(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in files:
        for name, body in zip(batch["registry"].to_pylist(), batch["content"].to_pylist(), strict=True):
            rows = docx_tables(body)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r["table_no"] for r in rows], pa.int32()), pa.array([r["row_no"] for r in rows], pa.int32()), pa.array([r["cells"] for r in rows], _ARROW)], names=["registry", "table_no", "row_no", "cells"])


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    """registry, table_no, row_no, cells of all DOCX files at path, a folder or one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.col("_metadata.file_name").alias("registry"), "content").mapInArrow(_rows, ROWS)


def header_roles(rows: DataFrame) -> DataFrame:
    """registry, table_no, num, document, folder, link: places (from 1) of the columns; the last that fits a role has it."""
    cells = rows.where("row_no = 1").select("registry", "table_no", F.posexplode("cells").alias("pos", "cell"))
    h = F.lower(norm_space(F.col("cell.text")))
    role = F.when(h.isin("№", "no", "n"), "num").when(F.contains(h, F.lit("документ")), "document").when(F.contains(h, F.lit("папка")), "folder").when(F.contains(h, F.lit("ссылка")) | F.contains(h, F.lit("источник")), "link")
    tagged = cells.withColumn("role", role)
    return tagged.groupBy("registry", "table_no").agg(*(F.max(F.when(F.col("role") == r, F.col("pos") + 1)).alias(r) for r in ("num", *ROLES)))


def registry_items(rows: DataFrame) -> DataFrame:
    """registry, table_no, row_no, num, title, folder, ord, original_url, download_url: a row for each URL of each
    accepted row. A number that is missing is the running count of accepted rows over the registry's tables."""
    roles = header_roles(rows).where(" and ".join(f"{r} is not null" for r in ROLES))
    joined = rows.where("row_no > 1").join(F.broadcast(roles), ["registry", "table_no"])
    cell = lambda r: F.try_element_at("cells", F.col(r))
    text = lambda r: F.trim(F.coalesce(cell(r)["text"], F.lit("")))
    none = F.array().cast("array<string>")
    plain = F.regexp_extract_all(text("link"), F.lit(r"https?://\S+"), F.lit(0))
    urls = F.transform(F.concat(F.coalesce(cell("link")["links"], none), plain), lambda u: F.regexp_replace(F.trim(u), r"[).,;\]]+$", ""))
    found = joined.select("registry", "table_no", "row_no", text("num").alias("given"), text("document").alias("title"), text("folder").alias("folder"), F.array_distinct(F.filter(urls, lambda u: u != "")).alias("urls"))
    accepted = found.where((F.col("title") != "") & (F.col("folder") != "") & (F.size("urls") > 0))
    count = F.row_number().over(Window.partitionBy("registry").orderBy("table_no", "row_no"))
    numbered = accepted.withColumn("num", F.when(F.col("given") != "", F.col("given")).otherwise(count.cast("string")))
    return numbered.select("registry", "table_no", "row_no", "num", "title", "folder", F.posexplode("urls").alias("ord", "original_url")).withColumn("download_url", force_scheme(F.col("original_url"), "http"))
