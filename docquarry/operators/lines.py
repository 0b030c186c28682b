"""Line operators: a text as rows (key, pos, line), cleaned by predicates and windows, and put together again.

Every window is partitioned by the text's key, so that texts are spread over the cluster; a text's own lines meet in
one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, counts_of, has_legal, let, lines, norm_space, strip_chars
from ..lexicons import BOILERPLATE_LINES, BOILERPLATE_PATTERNS, BOILERPLATE_STARTS, LEGAL_MARKERS, START_WORDS

SHORT, RUN, HEAD, LONG = 35, 3, 80, 45


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: every line, empty ones too, from pos 0."""
    return df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))


def strip_tags(html: Column) -> Column:
    """Text of a page by patterns alone: scripts and the like become a blank, other tags a line feed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg).*?>.*?</\1>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]+>", "\n")


def is_boilerplate(line: Column, exact: Iterable[str] = BOILERPLATE_LINES, starts: Iterable[str] = BOILERPLATE_STARTS, patterns: Iterable[str] = BOILERPLATE_PATTERNS) -> Column:
    """Lines of a page's frame: empty, listed, of one or two characters that aren't digits, or short and of a known
    shape. One pattern, so that the line is worked on once."""
    shapes = "|".join([*(f"{re.escape(s)}\\b.*" for s in starts), *(p.lstrip("^") if p.endswith("$") else p.lstrip("^") + ".*" for p in patterns)])
    words = "|".join(map(re.escape, exact))
    return strip_chars(F.lower(line), " .:;|").rlike(f"(?sU)^(?:{words}|(?!\\p{{Nd}}+$).{{0,2}}|(?=.{{0,35}}$)(?:{shapes}))$")


def drop_boilerplate(rows: DataFrame, **lists: Iterable[str]) -> DataFrame:
    return rows.withColumn("line", norm_space(F.col("line"))).where(~is_boilerplate(F.col("line"), **lists))


def drop_repeats(rows: DataFrame, key: str) -> DataFrame:
    """Without lines that equal the one before."""
    before = F.lag("line").over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("line"))).drop("_before")


def cap_short_runs(rows: DataFrame, key: str, markers: Iterable[str] = LEGAL_MARKERS) -> DataFrame:
    """At most RUN short lines in a row, which are those without a digit or a legal marker."""
    by = Window.partitionBy(key).orderBy("pos")
    short = (F.length("line") < SHORT) & ~has_legal(F.col("line"), markers) & ~F.col("line").rlike(r"\p{Nd}")
    marked = rows.withColumn("_short", short).withColumn("_run", F.sum(F.when(~F.col("_short"), 1).otherwise(0)).over(by))
    place = F.sum(F.when(F.col("_short"), 1).otherwise(0)).over(Window.partitionBy(key, "_run").orderBy("pos"))
    return marked.withColumn("_place", place).where(~F.col("_short") | (F.col("_place") <= RUN)).drop("_short", "_run", "_place")


def cleaned(text: Column, markers: Iterable[str] = LEGAL_MARKERS, **lists: Iterable[str]) -> Column:
    """A text without boilerplate and repeats and with its runs of short lines cut, each line ended by a line feed; empty
    where nothing is left. The same rules as those of the row operators, as one expression: no shuffle. A line is
    more than RUN deep in a run of short ones where the RUN lines before it are short too."""
    whole = F.filter(F.transform(lines(text), norm_space), lambda x: ~is_boilerplate(x, **lists))
    once = let(whole, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))
    is_short = lambda x: (F.length(x) < SHORT) & ~has_legal(x, markers) & ~x.rlike(r"\p{Nd}")

    def cut(a: Column) -> Column:
        def deep(short: Column, i: Column) -> Column:
            out = F.get(short, i) & (i >= RUN)
            for k in range(1, RUN + 1):
                out = out & F.get(short, i - k)
            return out

        return let(F.transform(a, is_short), lambda short: F.filter(a, lambda x, i: ~F.coalesce(deep(short, i), F.lit(False))))

    return let(let(once, cut), lambda a: F.when(F.size(a) > 0, F.concat(F.array_join(a, "\n"), F.lit("\n"))).otherwise(""))


def normalize(df: DataFrame, key: str, text: str, markers: Iterable[str] = LEGAL_MARKERS, **lists: Iterable[str]) -> DataFrame:
    """key, text of every row, cleaned(); keys may repeat or be null, and a null text is empty."""
    return df.select(key, cleaned(F.col(text), markers, **lists).alias("text"))


def trim_start(text: Column, starts: Iterable[str] = START_WORDS, markers: Iterable[str] = LEGAL_MARKERS) -> Column:
    """The text from where the document seems to begin: within the first lines, one that starts with a document's first
    words, else a long one with a legal marker, else the first line. A column expression: no shuffle."""
    rows = F.filter(lines(text), lambda x: norm_space(x) != "")
    head = F.slice(rows, 1, HEAD)
    opens = F.array_position(F.transform(head, lambda x: F.lower(x).rlike(f"(?U)^({'|'.join(starts)})\\b")), True)
    legal = F.array_position(F.transform(head, lambda x: any_of(F.lower(x), markers) & (F.length(x) > LONG)), True)
    at = F.when(opens > 0, opens).when(legal > 0, legal).otherwise(1)
    kept = F.slice(rows, at.cast("int"), F.greatest(F.size(rows), F.lit(1)))
    return F.when(F.size(rows) > 0, F.concat(F.btrim(F.array_join(kept, "\n"), F.lit(" \n\t\r ")), F.lit("\n"))).otherwise("")


def clean_pages(pages: DataFrame, key: str = "page_id", html: str = "html", **options: Iterable[str]) -> DataFrame:
    """key, text: tags stripped, lines normalised, trimmed to the document's start."""
    stripped = pages.select(key, strip_tags(F.coalesce(F.col(html), F.lit(""))).alias("_text"))
    return normalize(stripped, key, "_text", **options).select(key, trim_start(F.col("text")).alias("text"))


#: Starts of numbered points and articles; white space may be a line feed, so a number alone on its line takes the next.
POINT, ARTICLE = r"(?:[0-9]+[.)]|[а-я]\))", "статья"


def points(legal: Column, numbered: Column, articles: Column, long_lines: Column, short_lines: Column, menu: Column, n_chars: Column, content_like: Column | None = None, link_density: Column | None = None) -> Column:
    """The points of a text with such counts."""
    base = (n_chars + legal * 1200 + numbered * 220 + articles * 700 + long_lines * 70 - short_lines * 35).cast("double")
    if content_like is not None:
        base = base * F.when(content_like, 1.4).otherwise(1.0)
    if link_density is not None:
        base = base * F.when(link_density > 0.45, 0.08).when(link_density > 0.30, 0.20).when(link_density > 0.18, 0.55).otherwise(1.0)
    return base - menu * 450


def text_score(text: Column, markers: Iterable[str] = LEGAL_MARKERS, boilerplate: Iterable[str] = BOILERPLATE_LINES, content_like: Column | None = None, link_density: Column | None = None) -> Column:
    """How much a block of text looks like a document: struct of features and score."""
    low = F.lower(text)
    rows = F.filter(lines(text), lambda x: norm_space(x) != "")
    long_ = F.size(F.filter(rows, lambda x: F.length(x) > 80))
    short = F.size(F.filter(rows, lambda x: F.length(x) < SHORT))
    legal, menu = counts_of(low, markers), counts_of(low, boilerplate)
    numbered = F.regexp_count(text, F.lit(rf"(?imud)^\s*{POINT}\s+\S+"))
    articles = F.regexp_count(text, F.lit(rf"(?imud)^\s*{ARTICLE}\s+[0-9]+"))
    score = points(legal, numbered, articles, long_, short, menu, F.length(text), content_like, link_density)
    return F.struct(legal.alias("legal"), numbered.cast("long").alias("numbered"), articles.cast("long").alias("articles"), long_.cast("long").alias("long_lines"), short.cast("long").alias("short_lines"), menu.alias("menu"), score.alias("score"))


def marked(line: Column, markers: Iterable[str] = LEGAL_MARKERS, boilerplate: Iterable[str] = BOILERPLATE_LINES, **lists: Iterable[str]) -> Column:
    """What text_score() and cleaned() ask of a line, as a struct: the line with single blanks, and flags and counts of it.
    numbered and article: 1 if the line has a whole start of one, 2 if it is the part before the white space."""
    def of(x: Column) -> Column:
        low = F.lower(x)
        legal = counts_of(low, markers)
        short = (F.length(x) < SHORT) & (legal == 0) & ~x.rlike(r"\p{Nd}")
        numbered = F.when(x.rlike(rf"(?iu)^{POINT}\s+\S"), 1).when(x.rlike(rf"(?iu)^{POINT}$"), 2).otherwise(0)
        article = F.when(x.rlike(rf"(?iu)^{ARTICLE}\s+[0-9]"), 1).when(x.rlike(rf"(?iu)^{ARTICLE}$"), 2).otherwise(0)
        return F.struct(
            x.alias("line"), is_boilerplate(x, **lists).alias("frame"), short.alias("capped"), F.length(x).alias("n_chars"), legal.cast("int").alias("legal"), counts_of(low, boilerplate).cast("int").alias("menu"),
            numbered.alias("numbered"), article.alias("article"), x.rlike("^[0-9]").alias("digit"),
        )

    return let(norm_space(line), of)
