"""python -m docquarry clean INPUT OUTPUT | search QUERY PAGES [--page N] [--limit N] [--max-pages N] [--min-score X] [--phases]
| acquire REGISTRY ROOT [options]

acquire: the documents that a DOCX registry, or a folder of them, links to, as files below ROOT; --help lists its options.
clean: main texts of HTML files. search: candidates from a table of pages (page_id, url, html), as JSON. With --phases the
table holds responses (url, html), and the three phases look in it for the pages that they need, --no-text leaves texts
out and --full-text gives whole ones.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.query import expand_words, query_words
from .operators import search
from .operators.crawl import select_items
from .plans import find, run
from .plans.acquire import Options
from .sources import files, html_tree, registry
from .sources.fetch import http_fetcher
from .storage import stored


def acquired(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = registry.registry_items(registry.table_rows(spark, a.registry))
    order = F.struct("registry", "table_no", "row_no", "ord")
    # A registry is a document: its rows fit into a task.
    placed = rows.withColumn("id", F.row_number().over(Window.orderBy(order)).cast("long"))
    numbers = [n.strip() for n in a.only_nums.split(",") if n.strip()]
    items = select_items(placed.drop("ord").withColumn("ord", F.col("id")), numbers or None, a.start_index, a.limit).drop("ord")
    options = Options(
        a.dry_run, not a.no_repair_bad_text, a.extract_text, a.readable_text, a.overwrite_text, a.allow_generic_pages, not a.no_follow_page_links, a.max_link_depth, a.max_chain_candidates, a.max_page_links, a.max_path, a.root.rstrip("/"),
    )
    fetcher = http_fetcher(a.connect_timeout, a.read_timeout, a.max_redirects)

    def paused(u: str) -> dict:
        time.sleep(a.pause)
        return fetcher(u)

    return run.run(spark, stored(items, "items"), paused, options, a.retries, a.retry_pause, None if a.no_error_log else a.error_log)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docquarry", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean")
    c.add_argument("input")
    c.add_argument("output")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("pages")
    for name, default in (("page", 1), ("limit", 5), ("max-pages", 3)):
        s.add_argument(f"--{name}", type=int, default=default)
    s.add_argument("--min-score", type=float, default=0.15)
    for name in ("any-host", "phases", "no-text", "full-text"):
        s.add_argument(f"--{name}", action="store_true")
    r = sub.add_parser("acquire")
    r.add_argument("registry")
    r.add_argument("root")
    for name, default in (("connect-timeout", 60), ("read-timeout", 90), ("retries", 3), ("max-redirects", 8), ("max-path", 200), ("max-page-links", 0), ("max-link-depth", 2), ("max-chain-candidates", 0), ("start-index", 1), ("limit", 0)):
        r.add_argument(f"--{name}", type=int, default=default)
    for name, default in (("retry-pause", 2.0), ("pause", 0.2)):
        r.add_argument(f"--{name}", type=float, default=default)
    r.add_argument("--error-log", default="download_errors.csv")
    r.add_argument("--only-nums", default="")
    for name in ("dry-run", "no-error-log", "no-repair-bad-text", "readable-text", "extract-text", "overwrite-text", "allow-generic-pages", "no-follow-page-links"):
        r.add_argument(f"--{name}", action="store_true")
    given = sys.argv[1:] if argv is None else argv
    a = p.parse_args([x.rstrip("\\/") if x.startswith("--") else x for x in given])
    spark = SparkSession.builder.appName("docquarry").getOrCreate()
    if a.command == "clean":
        files.cleaned_files(files.html_files(spark, a.input)).write.mode("overwrite").parquet(a.output)
        return
    if a.command == "acquire":
        acquired(spark, a)
        return
    pages = spark.read.parquet(a.pages)
    more = {"hosts": None} if a.any_host else {}
    if a.phases:
        print(find.search_documents(pages, a.query, a.page, a.limit, a.max_pages, a.min_score, not a.no_text, a.full_text, **more).first()[0])
        return
    rows = html_tree.anchors(pages).select(F.col("page_id").alias("page_ord"), F.col("ord").alias("anchor_ord"), F.lit("catalog").alias("mode"), "url", "title", "snippet")
    found = search.candidates(rows, expand_words(query_words(F.lit(a.query))), a.min_score, **more)
    listed = pages.select(F.lit("catalog").alias("mode"), F.col("page_id").alias("page_ord"), F.col("url").alias("page_url"), F.lit("ok").alias("status"), F.lit("").alias("error"))
    page = search.page_of(found, a.page, a.limit)
    print(search.response(a.query, page, search.page_reports(listed, found), found, a.page, a.limit, a.max_pages, a.min_score).first()[0])


if __name__ == "__main__":
    main()
