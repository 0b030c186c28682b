"""Catalogue search: candidates from pages, scored, deduplicated, ordered and paged, with a report on each page."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions.text import norm_space
from ..functions.url import force_http, host, is_binary, strip_fragment
from ..lexicons import ALLOWED_HOSTS, DOCUMENT_MARKERS
from .ranks import slice_of

MODES = ("direct", "catalog", "site_search")


def candidates(anchors: DataFrame, words: Column, min_score: float = 0.15, hosts: Iterable[str] | None = ALLOWED_HOSTS, markers: Iterable[str] = DOCUMENT_MARKERS, keep_bad: bool = False) -> DataFrame:
    """anchors: page_ord, anchor_ord, mode, url, title, snippet. Adds points, score, matched; drops bad links, other
    hosts and low scores; the first of each URL stays."""
    # Generators keep the URL and the points from being worked out again in each of their uses.
    rows = anchors.select(*(c for c in anchors.columns if c != "url"), F.explode(F.array(strip_fragment(force_http(F.col("url"))))).alias("url"))
    if hosts is not None:
        rows = rows.where(host(F.col("url")).isin(*hosts))
    if not keep_bad:
        rows = rows.where(~Q.is_bad_link(F.col("url"), F.col("title")))
    scored = rows.select("*", F.inline(F.array(Q.score(F.col("title"), F.col("url"), F.col("snippet"), words, markers))))
    # Whole points, so that equality with the limit is exact.
    passed = scored.where(F.col("points") >= round(min_score * 100))
    mode = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    first = Window.partitionBy("url").orderBy(mode, "page_ord", "anchor_ord")
    return passed.withColumn("mode_ord", mode).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


#: Places up to which a page is the end of a list of the best rows, which each task keeps; beyond, it is found by ranges.
NEAR = 10_000


def page_of(found: DataFrame, iteration: int | str | None = 1, limit: int = 5) -> DataFrame:
    """A page of results, best first; ties stay in the order they were found. Bad page numbers count as 1."""
    i = iteration if isinstance(iteration, int) and iteration >= 1 else 1
    order = [F.col("points").desc(), "mode_ord", "page_ord", "anchor_ord"]
    clipped = found.withColumn("points", F.least(F.lit(100), F.greatest(F.lit(0), F.col("points"))))
    if i * limit <= NEAR:
        return clipped.orderBy(*order).offset((i - 1) * limit).limit(limit)
    return slice_of(clipped, order, (i - 1) * limit, i * limit).orderBy(*order)


def page_reports(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages: mode, page_ord, page_url, status, error. Adds candidates_found: those that stayed after the dedupe."""
    n = found.groupBy("mode", "page_ord").agg(F.count(F.lit(1)).alias("candidates_found"))
    return pages.join(n, ["mode", "page_ord"], "left").select(*pages.columns, F.coalesce("candidates_found", F.lit(0)).alias("candidates_found"))


def totals(found: DataFrame, iteration: int, limit: int) -> DataFrame:
    n = F.count(F.lit(1))
    offset = (iteration - 1) * limit
    return found.agg(n.alias("total_candidates_found"), F.least(F.lit(limit), F.greatest(F.lit(0), n - offset)).cast("long").alias("documents_returned"), (n > offset + limit).alias("has_more_documents"))


def enrich(page: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts (url, text) of the page's documents only, joined after the limit: content_status, text and a preview."""
    joined = page.join(texts.select("url", "text"), "url", "left")
    blank = F.coalesce(norm_space(F.col("text")), F.lit("")) == ""
    binary = is_binary(F.col("url"))
    status = F.when(binary, "binary_document_not_parsed_here").when(F.col("text").isNull(), "html_parse_error: no response").when(blank, "empty_text").otherwise("html_text_extracted")
    text = F.when(binary, "").otherwise(F.coalesce("text", F.lit("")))
    return joined.withColumn("content_status", status).withColumn("text", text).withColumn("text_preview", F.left(F.col("text"), F.lit(1000)))


def _named(mode: Column) -> Column:
    return F.when(mode == "direct", "direct_sp_url").otherwise(mode)


def response(query: str, page: DataFrame, reports: DataFrame, found: DataFrame, iteration: int = 1, limit: int = 5, max_pages: int = 3, min_score: float = 0.15, full_text: bool = False) -> DataFrame:
    """One row `json`: the whole answer. A blank query is an error object. What enrich() adds is in it if page has it, whole
    texts only with full_text."""
    spark = page.sparkSession
    if not query.strip():
        return spark.range(1).select(F.to_json(F.struct(F.lit("error").alias("status"), F.lit("empty query").alias("message"))).alias("json"))
    more = [c for c in ("content_status", "text_preview", *(("text",) if full_text else ())) if c in page.columns]
    rows = page.join(reports.select("mode", "page_ord", F.col("page_url").alias("source_search_url")), ["mode", "page_ord"], "left")
    own = F.struct(
        "title", "url", Q.document_type(F.col("title"), F.col("url")).alias("document_type"), "score", F.col("matched").alias("matched_keywords"), "snippet",
        _named(F.col("mode")).alias("source_mode"), F.coalesce("source_search_url", F.lit("")).alias("source_search_url"), *more,
    )
    order = (-F.col("points"), F.col("mode_ord"), F.col("page_ord"), F.col("anchor_ord"))
    docs = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), own.alias("own")))), lambda x: x["own"]).alias("documents"))
    place = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    report = F.struct(_named(F.col("mode")).alias("mode"), F.col("page_url").alias("url"), "status", "candidates_found", "error")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("_0"), F.col("page_ord").alias("_1"), report.alias("own")))), lambda x: x["own"])
    pages = reports.agg(F.count(F.lit(1)).alias("pages_checked"), listed.alias("page_reports"))
    head = {"status": "success", "query": query, "current_iteration": iteration, "max_pages": max_pages, "limit": limit, "min_score": min_score}
    # Three tables of one row each.
    row = pages.crossJoin(F.broadcast(totals(found, iteration, limit))).crossJoin(F.broadcast(docs))
    return row.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in head.items()), *(F.col(c) for c in row.columns)), {"pretty": "true"}).alias("json"))


def direct_candidates(responses: DataFrame, words: Column, min_score: float = 0.10, hosts: Iterable[str] | None = ALLOWED_HOSTS) -> DataFrame:
    """responses: page_ord, url, title, text of pages that the query itself names. Candidates of mode direct, whose
    snippet is the beginning of the text; their least score is their own."""
    rows = responses.select("page_ord", F.lit(0).alias("anchor_ord"), F.lit("direct").alias("mode"), "url", "title", norm_space(F.left(F.col("text"), F.lit(500))).alias("snippet"))
    return candidates(rows, words, min_score, hosts)


def merged(*phases: DataFrame) -> DataFrame:
    """Candidates of several phases; the first of each URL stays, by phase and place."""
    rows = phases[0]
    for p in phases[1:]:
        rows = rows.unionByName(p)
    first = Window.partitionBy("url").orderBy("mode_ord", "page_ord", "anchor_ord")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
