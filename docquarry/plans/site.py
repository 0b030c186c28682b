"""A site made of the pages table, so that its pages link to each other: page b has a URL by its id, and each anchor of a
page leads to another page, by the page's id and the anchor's place and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import links

#: Pages of another host, documents, and sections, which are portals.
URL_SQL = "CASE WHEN {0} % 7 = 3 THEN 'http://example.org/x/' || {0} WHEN {0} % 3 = 0 THEN 'http://vsrf.ru/documents/own/' || {0} ELSE 'http://www.vsrf.ru/documents/own?page=' || {0} END"
TARGET_SQL = "(page_id * 7 + ord * 13 + length(title)) % {0}"


def page_url(page: str) -> Column:
    return F.expr(URL_SQL.format(page))


def site_links(pages: DataFrame) -> DataFrame:
    """page_id, base, ord, url, title."""
    n = pages.count()
    rows = links.anchors(pages).withColumn("to_page", F.expr(TARGET_SQL.format(n)))
    return rows.select("page_id", page_url("page_id").alias("base"), "ord", page_url("to_page").alias("url"), "title")


def items(pages: DataFrame) -> DataFrame:
    """Every page as an item of a registry."""
    return pages.select(F.col("page_id").alias("id"), F.col("page_id").cast("string").alias("num"), F.lit("t").alias("title"), F.lit("r").alias("folder"), page_url("page_id").alias("original_url"))


def responses(pages: DataFrame) -> DataFrame:
    """Every page's response, its links in the site followed by its own html, which may leave a script or a comment open:
    some are missing, some documents are texts."""
    anchors = site_links(pages).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "url", "title"))).alias("a"))
    head = F.array_join(F.transform("a", lambda x: F.concat(F.lit('<p><a href="'), x["url"], F.lit('">'), F.replace(x["title"], F.lit("&"), F.lit("&amp;")), F.lit("</a></p>"))), "")
    plain = (F.col("page_id") % 6 == 0) & (F.col("page_id") % 7 != 3)
    rows = pages.join(anchors, "page_id", "left")
    return rows.select(
        page_url("page_id").alias("url"), F.lit(None).cast("string").alias("final_url"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("http_status"), F.when(plain, "text/plain").otherwise("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("content_disposition"), F.lit("utf-8").alias("http_encoding"), F.when(plain, F.lit("plain text")).otherwise(F.concat(F.coalesce(head, F.lit("")), "html")).cast("binary").alias("body"),
    )


#: A chain of redirects through the pages, its ends, jumps back, and hosts: of page {0}.
HOP_SQL = "CASE WHEN {0} % 13 = 0 THEN NULL WHEN {0} % 29 = 5 THEN {0} - 3 WHEN {0} % 31 = 30 THEN {0} - 12 ELSE {0} + 1 END"
HOST_SQL = "CASE WHEN {0} % 19 = 7 THEN 'http://other.org' ELSE 'http://sniprf.ru' END"
#: What the script of requests answers to a try of a page's form.
ANSWER_SQL = "CASE WHEN (length(html) + 7 * cand_ord + 3 * try_no) % 9 < 2 THEN 200 WHEN (length(html) + try_no) % 5 = 0 THEN NULL ELSE 404 + (length(html) + try_no) % 3 END"


def hops(pages: DataFrame) -> DataFrame:
    """url, http_status, location: a redirect of each page but the last ones of chains; relative within a host."""
    rows = pages.select("page_id", F.expr(HOP_SQL.format("page_id")).alias("to_page"), F.expr(HOST_SQL.format("page_id")).alias("host")).withColumn("to_host", F.expr(HOST_SQL.format("to_page")))
    path = F.concat(F.lit("/p/"), F.col("to_page").cast("string"))
    location = F.when(F.col("host") == F.col("to_host"), path).otherwise(F.concat("to_host", path))
    return rows.select(F.concat("host", F.lit("/p/"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("to_page").isNull(), 200).otherwise(301 + F.col("page_id") % 2).cast("int").alias("http_status"), location.alias("location"))


def script(pages: DataFrame, retries: int) -> DataFrame:
    """item, url, try_no, http_status, error: what each request of a page, the item, for a form of its URL gets. Pages that
    share a URL have answers of their own."""
    rows = pages.select(F.col("page_id").alias("item"), "html", F.posexplode(U.candidates(F.col("url"))).alias("cand_ord", "url")).withColumn("try_no", F.explode(F.sequence(F.lit(1), F.lit(retries))))
    status = F.expr(ANSWER_SQL)
    return rows.select("item", "url", "try_no", status.cast("int").alias("http_status"), F.when(status.isNull(), "Timeout").alias("error"))
