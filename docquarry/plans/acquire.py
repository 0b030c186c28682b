"""From registry items and fetched responses to named, typed, decoded texts with a state each: one plan of joins.

items: id, num, title, folder, original_url. responses, one for each URL: url, final_url, http_status, content_type,
content_disposition, http_encoding, body. existing: saved_to, and text for text files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, text, url
from ..functions.classify import is_valid_pdf, response_type
from ..operators import links
from ..operators.crawl import ITEM, item_status, roots, settled, walk
from ..sources import encoding, formats, html_tree
from ..storage import stored


@dataclass(frozen=True)
class Options:
    """What a run does; the defaults are a plain run."""

    dry_run: bool = False
    repair_bad_text: bool = True
    extract_text: bool = False
    readable_text: bool = False
    overwrite_text: bool = False
    allow_generic_pages: bool = False
    follow_page_links: bool = True
    max_depth: int = 2
    #: Most links that are tried on a portal, and on another page; 0 is no limit.
    max_chain: int = 0
    max_links: int = 0
    max_path: int = 200
    root: str = "/archive"
    #: Leaves out links that there is no response of any kind for, instead of failing on them; their places stay empty.
    only_answered: bool = False


def chosen_urls(items: DataFrame, responses: DataFrame) -> DataFrame:
    """path, attempted_url and final_url: an item's first candidate URL that went well. Items without one have no row."""
    content = items.select("path", url.preferred_content(F.col("original_url")).alias("content_url"))
    tries = content.select("path", F.posexplode(url.candidates(F.col("content_url"))).alias("cand_ord", "url"))
    good = tries.join(responses.where(F.col("http_status").between(200, 299)).select("url", "final_url"), "url")
    best = F.min_by(F.struct("url", "final_url"), "cand_ord")
    return good.groupBy("path").agg(best.alias("b")).select("path", F.col("b.url").alias("attempted_url"), F.coalesce(F.nullif("b.final_url", F.lit("")), F.col("b.url")).alias("final_url"))


def answers(responses: DataFrame) -> DataFrame:
    """The responses that went well, by attempted_url, with file_type and ext."""
    good = responses.where(F.col("http_status").between(200, 299)).withColumnRenamed("url", "attempted_url")
    t = response_type(F.coalesce("final_url", "attempted_url"), F.col("content_type"), F.col("body"), F.col("content_disposition"))
    return good.withColumn("t", t).select("*", F.col("t.file_type").alias("file_type"), F.col("t.ext").alias("ext")).drop("t")


def decoded(rows: DataFrame) -> DataFrame:
    return encoding.decode(rows, "attempted_url", header_charset=names.header_charset(F.col("content_type")), http_charset=F.col("http_encoding"))


def planned_links(responses: DataFrame, options: Options) -> DataFrame:
    """The links that are tried on each HTML response, once for each response however many items lead to it."""
    html = answers(responses).where("file_type = 'HTML_TEXT'")
    bases = html.select(F.col("attempted_url").alias("page_id"), F.coalesce(F.nullif("final_url", F.lit("")), F.col("attempted_url")).alias("url"))
    pages = decoded(html).select(F.col("attempted_url").alias("page_id"), F.col("text").alias("html")).join(bases, "page_id")
    return links.plan(html_tree.page_links(pages), "page_id", options.max_chain, options.max_links)


def crawled(items: DataFrame, responses: DataFrame, options: Options) -> DataFrame:
    """The items, and those that the links of their pages add."""
    light = stored(responses.select("url", "http_status", "final_url"), "answers")
    planned = planned_links(responses, options)
    if options.only_answered:
        planned = planned.join(light.select(url.canonical_key(F.col("url")).alias("link_key")).distinct(), "link_key", "left_semi")
    plan = stored(planned, "plan")

    def page(level: DataFrame) -> DataFrame:
        got = level.join(chosen_urls(level, light), "path")
        return got.withColumns({"src": F.col("attempted_url"), "visited": F.array_union("visited", F.array(url.canonical_key(F.col("final_url"))))})

    return walk(items, plan, page, options.max_depth)


def acquire(items: DataFrame, responses: DataFrame, existing: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """A row for each item, depth 0, and, if links are followed, for what their pages lead to: id (the item's), path,
    depth, num, original_url, status, file_type, saved_to, encoding, text, error, linked_saved, linked_errors. A page's state
    follows from the states of its links."""
    follow = options.follow_page_links and not options.dry_run
    every = crawled(items, responses, options) if follow else roots(items).drop("visited")
    tried = stored(every.join(chosen_urls(every, responses.select("url", "http_status", "final_url")).drop("final_url"), "path", "left"), "tried")
    # What a response holds is worked out once, however many items lead to it.
    used = stored(answers(responses).join(tried.select("attempted_url").distinct(), "attempted_url", "left_semi"), "used")
    light = used.select("attempted_url", "file_type", "ext", (F.coalesce(is_valid_pdf(F.col("body")), F.lit(False))).alias("whole_pdf"))
    typed = tried.join(light, "attempted_url", "left")
    folder = F.concat(F.lit(f"{options.root}/"), names.subpath(F.col("folder")))
    saved = names.fit_path(folder, names.file_name(F.col("num"), F.col("title"), F.col("original_url"), F.col("ext")), options.max_path)
    typed = typed.withColumn("saved_to", F.when(F.col("file_type").isNull() | F.lit(options.dry_run), folder).otherwise(saved))
    pages = stored(decoded(used.where(F.col("file_type").isin("HTML_TEXT", "TEXT"))), "decoded")
    html = pages.join(used.where("file_type = 'HTML_TEXT'").select("attempted_url"), "attempted_url", "left_semi")
    main = html_tree.readable_text(html.select(F.col("attempted_url").alias("page_id"), F.col("text").alias("html"))).select(F.col("page_id").alias("attempted_url"), F.col("text").alias("main"))
    files = formats.texts(used.where(~F.col("file_type").isin("HTML_TEXT", "TEXT")), "attempted_url").select("attempted_url", F.col("text").alias("file_text"), F.col("error").alias("file_error"))
    if existing is None:
        existing = items.sparkSession.createDataFrame([], "saved_to string, old_text string")
    elif "text" in existing.columns:
        existing = existing.withColumnRenamed("text", "old_text")
    old = existing.select("saved_to", "old_text", F.lit(True).alias("found"))
    texts = pages.select("attempted_url", F.col("text").alias("decoded"), F.col("charset").alias("encoding")).join(main, "attempted_url", "left")
    rows = typed.join(texts, "attempted_url", "left").join(files, "attempted_url", "left").join(old, "saved_to", "left")
    found = F.coalesce("found", F.lit(False))
    bad = text.looks_like_mojibake(F.col("old_text")) | text.looks_like_shell(F.col("old_text"))
    broken_pdf = (F.col("file_type") == "PDF") & ~F.col("whole_pdf")
    failed = F.col("file_type").isNull() | F.coalesce(broken_pdf, F.lit(False))
    u = F.col("original_url")
    needs = url.requires_link_target(u, text.is_allowed_generic(F.col("folder"), F.col("title")), options.allow_generic_pages)
    body = F.coalesce(F.col("main"), F.col("decoded"), F.when(F.lit(options.extract_text or options.readable_text), F.col("file_text")), F.lit(""))
    error = F.when(F.col("file_type").isNull(), "no response").when(broken_pdf, "not a PDF").when(F.lit(options.extract_text or options.readable_text), F.col("file_error"))
    turns = rows.select(
        *ITEM, "place", "attempted_url", text.text(F.col("file_type")).alias("file_type"), "saved_to", text.text(F.col("encoding")).alias("encoding"), body.alias("text"), text.text(error).alias("error"), found.alias("found"), bad.alias("bad"),
        F.startswith(text.text(F.col("old_text")), F.lit("\ufeff")).alias("bom"), url.is_generic(u).alias("generic"), needs.alias("needs"), failed.alias("failed"), F.coalesce(F.col("file_text") != "", F.lit(False)).alias("wrote"),
    )

    def status(linked_saved: Column) -> Column:
        c = {n: F.col(n) for n in ("file_type", "found", "bad", "bom", "generic", "needs", "failed", "wrote")}
        followed = F.lit(follow) & (F.col("depth") < options.max_depth)
        return item_status(
            c["file_type"], c["found"], c["bad"], c["bom"], followed, linked_saved, c["generic"], c["needs"], c["failed"], options.dry_run, options.readable_text, options.extract_text, options.repair_bad_text,
            options.overwrite_text, c["wrote"],
        )

    done = settled(stored(turns, "turns"), status, options.max_depth if follow else 0)
    return done.select("id", "path", "depth", "num", "title", "folder", "original_url", "attempted_url", "status", "file_type", "saved_to", "encoding", "text", "error", "linked_saved", "linked_errors")
