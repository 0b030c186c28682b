"""Search of a site in three phases over fetched responses: documents that the query names, catalogues, the site's search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.query import expand_words, query_words, sp_numbers
from ..lexicons import ALLOWED_HOSTS
from ..operators import search
from ..sources import html_tree


def planned_urls(spark: SparkSession, query: str, max_pages: int = 3) -> DataFrame:
    """mode, page_ord, page_url: what the phases ask for. A few URLs for each number in the query, year and page."""
    q = F.lit(query)
    phases = zip(search.MODES, (U.direct_sp_urls(sp_numbers(q)), F.array(*map(F.lit, U.catalog_urls())), U.search_urls(q, max_pages)), strict=True)
    rows = [spark.range(1).select(F.lit(mode).alias("mode"), F.posexplode(urls).alias("page_ord", "page_url")) for mode, urls in phases]
    return rows[0].union(rows[1]).union(rows[2])


def search_documents(responses: DataFrame, query: str, iteration: int | str | None = 1, limit: int = 5, max_pages: int = 3, min_score: float = 0.15, include_text: bool = True, include_full_text: bool = False, hosts: Iterable[str] | None = ALLOWED_HOSTS) -> DataFrame:
    """One row `json`. responses: url, html, one row for each URL, of planned_urls() and of the documents they lead to; html
    is null where fetching failed. A page that isn't there counts as failed, which only the direct phase doesn't report."""
    query = query.strip()
    iteration = iteration if isinstance(iteration, int) and iteration >= 1 else 1
    spark = responses.sparkSession
    planned = planned_urls(spark, query, max_pages)
    words = expand_words(query_words(F.lit(query)))
    # The planned URLs are few, whatever the size of the responses.
    got = responses.where("html is not null").join(F.broadcast(planned), F.col("url") == F.col("page_url")).select("mode", "page_ord", "page_url", F.col("page_url").alias("page_id"), "url", "html")
    pages = got.where("mode = 'direct'")
    direct = pages.select("page_id", "page_ord", "url").join(html_tree.titles(pages), "page_id").join(html_tree.readable_text(pages), "page_id").where("title <> ''")
    linked = html_tree.anchors(got.where("mode <> 'direct'")).select(F.col("page_id").alias("page_url"), F.col("ord").alias("anchor_ord"), "url", "title", "snippet")
    linked = linked.join(F.broadcast(planned.where("mode <> 'direct'")), "page_url").select("page_ord", "anchor_ord", "mode", "url", "title", "snippet")
    found = search.merged(search.direct_candidates(direct, words, hosts=hosts), search.candidates(linked, words, min_score, hosts))
    there = planned.join(got.select("mode", "page_ord", F.lit(True).alias("there")), ["mode", "page_ord"], "left")
    ok = F.col("there").isNotNull() | (F.col("mode") == "direct")
    listed = there.select("mode", "page_ord", "page_url", F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, "").otherwise("no response").alias("error"))
    page = search.page_of(found, iteration, limit)
    if include_text:
        by_url = responses.where("html is not null").withColumn("page_id", U.strip_fragment(U.force_http(F.col("url"))))
        wanted = by_url.join(F.broadcast(page.select(F.col("url").alias("page_id"))), "page_id", "left_semi")  # at most `limit` URLs
        page = search.enrich(page, html_tree.readable_text(wanted).select(F.col("page_id").alias("url"), "text"))
    return search.response(query, page, search.page_reports(listed, found), found, iteration, limit, max_pages, min_score, include_full_text)
