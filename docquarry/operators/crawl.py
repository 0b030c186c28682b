"""Depth-limited crawl over a table of links, and the state of each item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.names import child_folder, join_errors
from ..functions.text import text
from ..storage import stored
from .ranks import slice_of


ITEM = ("path", "parent", "depth", "id", "num", "title", "folder", "original_url")


def roots(items: DataFrame) -> DataFrame:
    """items: id, num, title, folder, original_url, as the first level of a crawl."""
    return items.select(
        F.col("id").cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "id", F.col("num").cast("string").alias("num"), "title", "folder", "original_url",
        F.lit(0).alias("place"), F.array_distinct(F.array(U.canonical_key(F.col("original_url")))).alias("visited"),
    )


def walk(items: DataFrame, plan: DataFrame, page: Callable[[DataFrame], DataFrame] | None = None, max_depth: int = 2) -> DataFrame:
    """items, and what their pages' planned links lead to, level by level: path (the item's id, then a place for each
    level), parent, depth, id (of the item that it comes from), num, title, folder, original_url, place.

    plan: src, place, url, title, link_key, navigation; a row for each link that is tried on a page, as links.planned() gives
    them. page adds src, the page of each item, to a level, and may add to `visited`; by default that is the URL's key.
    A portal's link is left out if its key was visited on the way from the item, so siblings may share a child; its place
    stays empty. Each level is a stored table made from the one before it alone, so no join runs twice.
    """
    page = page or (lambda level: level.withColumn("src", U.canonical_key(F.col("original_url"))))
    level = stored(roots(items), "level-0")
    out = level
    for depth in range(1, max_depth + 1):
        up = page(level).select("src", "visited", *(F.col(c).alias(f"_{c}") for c in ITEM))
        open_ = up.join(plan, "src").where(~F.col("navigation") | ~F.array_contains("visited", F.col("link_key")))
        place = F.format_string("%02d", F.col("place"))
        step = open_.select(
            F.concat_ws(".", "_path", place).alias("path"), F.col("_path").alias("parent"), F.lit(depth).alias("depth"), F.col("_id").alias("id"), F.btrim(F.concat(text(F.col("_num")), F.lit("."), place), F.lit(".")).alias("num"),
            "title", child_folder(F.col("_folder"), F.col("_title"), F.col("_num")).alias("folder"), F.col("url").alias("original_url"), "place", F.array_union("visited", F.array("link_key")).alias("visited"),
        )
        level = stored(step, f"level-{depth}")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("visited")


def settled(items: DataFrame, status: Callable[[Column], Column], max_depth: int = 2, messages: int = 5) -> DataFrame:
    """items: path, parent, depth, place, original_url, error and what status() reads. Adds linked_saved, linked_errors,
    status, and to error the first messages of the links that failed. From the leaves up: status() gets an item's
    linked_saved, which counts each saved child for itself or for what it has saved below, whichever is more. Each
    level is a stored table."""
    out = below = None
    for depth in range(max_depth, -1, -1):
        rows = items.where(F.col("depth") == depth)
        if below is None:
            rows = rows.withColumns({"linked_saved": F.lit(0).cast("long"), "linked_errors": F.lit(0).cast("long"), "_told": F.lit("")})
        else:
            good = F.startswith("status", F.lit("OK")) | F.startswith("status", F.lit("SKIPPED_EXISTS"))
            told = F.when(~good, F.struct("place", F.concat("original_url", F.lit(" -> "), "status", F.lit(": "), text(F.col("error"))).alias("line")))
            sums = below.groupBy(F.col("parent").alias("path")).agg(
                F.sum(F.when(good, F.greatest(F.lit(1), F.col("linked_saved"))).otherwise(0)).alias("linked_saved"), F.sum(F.when(good, 0).otherwise(1)).cast("long").alias("linked_errors"),
                F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(told)), 1, messages), lambda x: x["line"]), " | ").alias("_told"),
            )
            rows = rows.join(sums, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("linked_saved", "linked_errors")})
        told = F.when(F.col("linked_errors") > 0, F.concat(F.lit("errors of links: "), F.col("_told")))
        rows = rows.withColumn("status", status(F.col("linked_saved"))).withColumn("error", join_errors(F.col("error"), told)).drop("_told")
        below = stored(rows.select(*items.columns, "linked_saved", "linked_errors", "status"), f"settled-{depth}")
        out = below if out is None else out.unionByName(below)
    return out


def item_status(
    file_type: Column, exists: Column, bad_text: Column, has_bom: Column, follow: Column, linked_saved: Column, generic: Column, needs_links: Column, failed: Column,
    dry_run: bool = False, readable: bool = False, extract: bool = False, repair: bool = True, overwrite: bool = False, wrote_text: Column | None = None,
) -> Column:
    """The state of an item after its turn: what was there before, what came, and what its links gave.

    readable: formats other than text are replaced by their text; extract: it is put beside them.
    """
    wrote = wrote_text if wrote_text is not None else F.lit(False)
    textual = file_type.isin("HTML_TEXT", "TEXT")
    html = file_type == "HTML_TEXT"
    redo = exists & textual & (F.lit(overwrite) | bad_text | ~has_bom) & F.lit(repair)
    skip_write = exists & html & ~redo & follow & F.lit(repair)
    skipped = exists & ~redo & ~skip_write
    old = F.when(~textual & (F.lit(readable) | F.lit(extract)) & wrote, "SKIPPED_EXISTS_TEXT_EXTRACTED").otherwise("SKIPPED_EXISTS")
    page = (
        F.when(generic & (linked_saved > 0) & ~skip_write & follow, "OK_LINKED_DOCUMENTS").when(skip_write & (linked_saved > 0), "SKIPPED_EXISTS_LINKS_PROCESSED")
        .when(skip_write, "SKIPPED_EXISTS").when(redo, "OK_HTML_TEXT_REPAIRED").otherwise("OK_HTML_TEXT")
    )
    other = F.concat(F.lit("OK_"), file_type, F.when(F.lit(readable) & wrote, "_TEXT").otherwise(""))
    return (
        F.when(F.lit(dry_run), "DRY_RUN").when(failed, "ERROR").when(skipped, old)
        .when(html & needs_links & (linked_saved <= 0), "ERROR_NO_LINKED_DOCUMENTS").when(html, page)
        .when(file_type == "TEXT", F.when(redo, "OK_TEXT_REPAIRED").otherwise("OK_TEXT")).otherwise(other)
    )


def fetch_fallback(attempts: DataFrame, keep: int = 6) -> DataFrame:
    """attempts: item, cand_ord, try_no, url, ok, error. One row for each item: the first that went well in order of
    candidate and try, and the last `keep` errors before it."""
    order = F.struct("cand_ord", "try_no")
    best = attempts.groupBy("item").agg(F.min(F.when(F.col("ok"), F.struct("cand_ord", "try_no", "url"))).alias("hit"))
    joined = attempts.join(best, "item")
    failed = ~F.col("ok") & (F.col("hit").isNull() | (order < F.struct("hit.cand_ord", "hit.try_no")))
    errors = F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("cand_ord", "try_no", "error")))), lambda x: text(x["error"]))
    last = F.slice(errors, F.greatest(F.size(errors) - keep + 1, F.lit(1)), keep)
    return joined.groupBy("item").agg(F.first("hit.url").alias("url"), F.array_join(last, " | ").alias("errors")).withColumn("status", F.when(F.col("url").isNull(), "ERROR").otherwise("OK"))


def status_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def outcome_totals(results: DataFrame) -> DataFrame:
    """Numbers of items that went well, were skipped and failed; dry runs are none of them."""
    ok, skipped = F.startswith("status", F.lit("OK")), F.startswith("status", F.lit("SKIPPED"))
    bad = ~ok & ~skipped & (F.col("status") != "DRY_RUN")
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(skipped).alias("skipped"), F.count_if(bad).alias("errors"))


def select_items(items: DataFrame, numbers: list[str] | None = None, start: int = 1, limit: int = 0) -> DataFrame:
    """items: ord, num. Those with one of the numbers, from the start-th on, at most limit; order stays."""
    rows = items.where(F.col("num").isin(numbers)) if numbers else items
    first = max(start - 1, 0)
    return slice_of(rows, [F.col("ord")], first, first + limit if limit else None) if first or limit else rows
