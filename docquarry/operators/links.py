"""Links of pages: extraction, first-wins dedupe, per-page limits and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.names import link_text

ANCHOR = r"(?is)<a\b[^>]*href=['\"]([^'\"]+)['\"][^>]*>(.*?)</a>"


def anchors(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "url") -> DataFrame:
    """key, base, ord (from 0), href, url, title: a row for each anchor with an href, in page order; natively, by a
    pattern. hrefs that lead nowhere are left out."""
    whole = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(0))
    rows = pages.select(key, F.col(base).alias("base"), F.posexplode(whole).alias("ord", "_a"))
    href = F.btrim(F.regexp_extract("_a", ANCHOR, 1), F.lit(" \t\r\n\f\x0b"))
    title = link_text(F.regexp_replace(F.regexp_extract("_a", ANCHOR, 2), r"(?s)<[^>]+>", " "))
    found = rows.select(key, "base", "ord", href.alias("href"), title.alias("title")).where(~U.is_skipped_href(F.col("href")))
    return found.withColumn("url", U.join(F.col("base"), F.col("href")))


def followable(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Links worth following, titled, the first of each canonical key on a page. A key counts as seen only once a link
    with it has passed, hence the filter goes before the window."""
    titled = links.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif(U.doc_id(F.col("url")), F.lit("")), F.lit("linked_document")))
    kept = titled.where(U.is_followable(F.col("url"), F.col("title"), F.col("base"))).withColumn("link_key", U.canonical_key(F.col("url")))
    return first_wins(kept, [key, "link_key"], ["ord"])


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def first_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; all if n is 0."""
    if n == 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def tier(url: Column) -> Column:
    return F.when(U.is_direct_document(url), 0).when(U.is_generic(url), 2).otherwise(1)


def ranked(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds place (from 1): direct documents first, portals last, then by length of title and URL."""
    order = Window.partitionBy(key).orderBy(tier(F.col("url")), F.length("title"), "url", "ord")
    return links.withColumn("place", F.row_number().over(order))


def numbered_children(links: DataFrame, key: str, num: Column) -> DataFrame:
    """Adds child_num: the parent's number, a point, and the link's place in two digits at least."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return links.withColumn("child_num", F.btrim(F.concat(num, F.lit("."), F.format_string("%02d", place)), F.lit(".")))


def planned(links: DataFrame, navigation: Column, key: str = "page_id", max_chain: int = 0, max_links: int = 0) -> DataFrame:
    """The links that a page's crawl tries, in place: a portal's all, direct documents first, at most max_chain; of other
    pages the direct documents alone, in page order, at most max_links. 0 is no limit."""
    by_rank = Window.partitionBy(key).orderBy(tier(F.col("url")), F.length("title"), "url", "ord")
    portal = links.where(navigation).withColumn("place", F.row_number().over(by_rank))
    other = links.where(~navigation & U.is_direct_document(F.col("url"))).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ord")))
    cut = lambda df, n: df.where(F.col("place") <= n) if n else df
    return cut(portal, max_chain).unionByName(cut(other, max_links))


def plan(links: DataFrame, key: str = "page_id", max_chain: int = 0, max_links: int = 0) -> DataFrame:
    """What a crawl tries on each page: links (key, base, ord, url, title) that are worth following, the first of each
    canonical key, in place. A page that is a portal is a place of navigation. key becomes src."""
    kept = followable(links, key).withColumn("navigation", U.is_generic(F.col("base")))
    return planned(kept, F.col("navigation"), key, max_chain, max_links).select(F.col(key).alias("src"), "place", "url", "title", "link_key", "navigation")


def summary(links: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text: a line for each link, with its title if it has one."""
    line = F.concat(F.lit("- "), F.when(link_text(F.col("title"), 180) != "", F.concat(link_text(F.col("title"), 180), F.lit(": "))).otherwise(""), F.col("url"))
    rows = links.where(F.coalesce("url", F.lit("")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("_l"))
    return rows.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))
