"""A whole acquisition: a registry's items, their pages and linked documents requested level by level, states, files and
the error log. What the network gives comes through a fetcher, see sources.fetch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url
from ..operators.crawl import outcome_totals, roots, status_rollup
from ..sources import sinks
from ..sources.fetch import Fetcher, attempts, fetch
from ..storage import stored
from .acquire import Options, acquire, crawled


def requested(items: DataFrame, fetcher: Fetcher, retries: int, pause: float) -> tuple[DataFrame, DataFrame]:
    """items: item, url. The responses that went well, one for each URL, and every request that was made."""
    kept: list[DataFrame] = []

    def ask(due: DataFrame) -> DataFrame:
        kept.append(stored(fetch(due, fetcher), "responses"))
        return due.select("url", "try_no").join(kept[-1].select("url", "http_status", "error"), "url")

    made = attempts(items, ask, retries, pause)
    got = kept[0]
    for more in kept[1:]:
        got = got.unionByName(more)
    return got.where("error is null and http_status < 400").dropDuplicates(["url"]), made


def responses_of(items: DataFrame, fetcher: Fetcher, options: Options, retries: int = 3, pause: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The responses that items and their links need: those of a level are there before its links are looked for. No form
    of a URL that has been asked for at a level above is asked for again. And every request, with its level."""
    known = made = None
    asked = None
    for depth in range(options.max_depth + 1 if options.follow_page_links else 1):
        every = roots(items) if known is None else crawled(items, known, replace(options, max_depth=depth)).where(F.col("depth") == depth)
        need = every.select(url.preferred_content(F.col("original_url")).alias("url")).distinct().withColumn("item", F.col("url"))
        need = stored(need if asked is None else need.join(asked, "url", "left_anti"), "needed")
        if need.isEmpty():
            break
        got, tries = requested(need.select("item", "url"), fetcher, retries, pause)
        got, tries = stored(got if known is None else got.join(known.select("url"), "url", "left_anti"), "got"), tries.withColumn("depth", F.lit(depth))
        asked = need.select("url") if asked is None else asked.union(need.select("url"))
        known, made = (got, tries) if known is None else (known.unionByName(got), made.unionByName(tries))
    return known, made


def existing_files(spark: SparkSession, root: str) -> DataFrame | None:
    """saved_to, and text of the text files, of what is below root; None if there is nothing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = store.makeQualified(path).toString().rstrip("/")
    inside = F.expr(f"substring(path, {len(base) + 1})")
    return files.select(F.concat(F.lit(root.rstrip("/")), inside).alias("saved_to"), F.when(F.endswith("path", F.lit(".txt")), F.col("content").cast("string")).alias("text"))


def beside(saved_to: Column) -> Column:
    """The path of the text beside a file."""
    return F.concat(F.regexp_replace(saved_to, r"\.[^./]+$", ""), F.lit(".txt"))


def write_results(results: DataFrame, responses: DataFrame, options: Options) -> None:
    """Texts of pages with a BOM, other files as they came, and their texts in place of them or beside them."""
    rows = results.where(F.startswith("status", F.lit("OK")) & (F.col("status") != "OK_LINKED_DOCUMENTS")).withColumn("target", F.expr(f"substring(saved_to, {len(options.root.rstrip('/')) + 2})"))
    textual, replaced = F.col("file_type").isin("HTML_TEXT", "TEXT"), F.endswith("status", F.lit("_TEXT")) & ~F.col("file_type").isin("HTML_TEXT", "TEXT")
    texts = rows.where(textual).select("target", F.col("text").alias("content"), F.lit(None).cast("string").alias("replaces"))
    extracted = rows.where(~textual & (F.col("text") != "") & (replaced | F.lit(options.extract_text))).select(beside(F.col("target")).alias("target"), F.col("text").alias("content"), F.when(replaced, F.col("target")).alias("replaces"))
    sinks.write_files(texts.unionByName(extracted).dropDuplicates(["target"]), options.root, bom=True)
    binary = rows.where(~textual & ~replaced).select("target", "attempted_url").dropDuplicates(["target"])
    sinks.write_files(binary.join(responses.select(F.col("url").alias("attempted_url"), F.col("body").alias("content")), "attempted_url").select("target", "content"), options.root)


def run(
    spark: SparkSession, items: DataFrame, fetcher: Fetcher, options: Options, retries: int = 3, pause: float = 2.0, error_log: str | None = None, say: Callable[[str], None] = print,
) -> DataFrame:
    """items: id, num, title, folder, original_url. Requests, writes what came below options.root and the error log, tells
    the counts, and returns a row for each item and link."""
    if options.dry_run:
        results = acquire(items, spark.createDataFrame([], RESPONSES), None, options)
    else:
        responses, made = responses_of(items, fetcher, options, retries, pause)
        results = stored(acquire(items, responses, existing_files(spark, options.root), options), "results")
        failed = made.where("not ok").groupBy(F.col("item").alias("u")).agg(F.array_join(F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("cand_ord", "try_no", "error")))), 1, 6), lambda x: x["error"]), " | ").alias("told"))
        named = results.withColumn("u", url.preferred_content(F.col("original_url"))).join(failed, "u", "left")
        results = stored(named.withColumn("error", F.when((F.col("error") == "no response") & F.col("told").isNotNull(), F.col("told")).otherwise(F.col("error"))).drop("u", "told"), "results")
        write_results(results, responses, options)
    top = results.where("depth = 0")
    total = outcome_totals(top).first()
    say(f"new: {total['ok']}, there already: {total['skipped']}, errors: {total['errors']}")
    for r in status_rollup(top).orderBy("status").collect():  # one row for each state
        say(f"  {r['status']}: {r['n']}")
    if error_log is not None:
        given = items.drop(*(set(items.columns) & set(top.columns) - {"id"}))
        sinks.write_error_log(top.join(given, "id").withColumn("download_url", url.force_scheme(F.col("original_url"), "http")), error_log)
    return results


RESPONSES = "url string, final_url string, http_status int, content_type string, content_disposition string, http_encoding string, body binary"
