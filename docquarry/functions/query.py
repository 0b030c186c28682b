"""Search expressions: words of a query, and the relevance of a candidate to them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import BAD_TITLES, BAD_URL_PARTS, DOCUMENT_MARKERS, KEPT_WORDS, STOP_WORDS, SYNONYMS
from .text import any_of, norm_space, strip_chars, text
from .url import force_http, looks_like_snip, looks_like_sp, suffix


def _plain(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def query_words(q: Column, stop: Iterable[str] = STOP_WORDS, kept: Iterable[str] = KEPT_WORDS) -> Column:
    clean = F.regexp_replace(_plain(text(q)), r"[^а-яa-z0-9.\s\p{Z}-]+", " ")
    words = F.transform(F.split(norm_space(clean), " "), lambda w: strip_chars(w, " .,-_"))
    return F.array_distinct(F.filter(words, lambda w: w.isin(*kept) | ((F.length(w) >= 3) & ~w.isin(*stop))))


def expand_words(words: Column, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> Column:
    """Each word followed by its synonyms, without repeats, in order."""
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), none)))))


def sp_numbers(q: Column) -> Column:
    t = F.replace(F.lower(text(q)), F.lit(","), F.lit("."))
    found = [F.regexp_extract_all(t, F.lit(rf"(?U)\b{w}\s*([0-9]+(?:\.[0-9]+)*)"), F.lit(1)) for w in ("сп", "sp")]
    return F.array_distinct(F.transform(F.concat(*found), lambda n: F.replace(n, F.lit("."), F.lit("-"))))


def score(title: Column, url: Column, snippet: Column, words: Column, markers: Iterable[str] = DOCUMENT_MARKERS) -> Column:
    """struct(points, score, matched). Points are whole numbers; score is points / 100 between 0 and 1."""
    title, snippet = norm_space(title), norm_space(snippet)
    u = _plain(force_http(url))
    blob = F.concat_ws(" ", _plain(title), _plain(snippet), u)
    matched = F.filter(F.transform(words, _plain), lambda w: (w != "") & F.contains(blob, w))
    marks = F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(blob, m)))
    ext = suffix(url)
    n = lambda cond, points: F.when(cond, points).otherwise(0)
    # The points of each sign.
    shape = F.when(ext.isin(".pdf", ".doc", ".docx", ".rtf"), 18).when(ext == ".html", 10).when(u.rlike(r"/sp\d|/gost|/document|/docs?"), 16).otherwise(0)
    points = (
        14 * F.size(matched) + 10 * marks + n(blob.rlike(r"(?U)\bсп\s*\d+(?:\.\d+)*|/sp\d"), 30) + n(blob.rlike(r"(?U)\bгост\b|\bgost\b"), 25)
        + n(F.contains(blob, F.lit("свод правил")), 20) + shape + n(F.length(title) >= 20, 8) - n(F.contains(u, F.lit("search")), 35)
        - n(any_of(blob, ("контакты", "главная", "карта сайта")), 25) - n((F.size(matched) == 0) & (marks == 0), 30)
    )
    return F.struct(points.cast("int").alias("points"), (F.least(F.lit(100), F.greatest(F.lit(0), points)) / 100).alias("score"), F.array_distinct(matched).alias("matched"))


def is_bad_link(url: Column, title: Column, parts: Iterable[str] = BAD_URL_PARTS, titles: Iterable[str] = BAD_TITLES) -> Column:
    u, t = F.lower(force_http(url)), F.lower(norm_space(title))
    sp = looks_like_sp(u) | t.rlike(r"(?U)\bсп\s*\d+")
    snip = any_of(t, ("снип", "snip")) | any_of(u, ("снип", "snip")) | looks_like_snip(u)
    return (F.length(t) < 3) | any_of(u, parts) | t.isin(*titles) | (~sp & snip)


def document_type(title: Column, url: Column) -> Column:
    t, ext = F.lower(F.concat_ws(" ", text(title), text(url))), suffix(url)
    return (
        F.when(t.rlike(r"(?U)\bсп\s*\d+|/sp\d"), "СП").when(t.rlike(r"(?U)\bгост\b|\bgost\b"), "ГОСТ").when(F.contains(t, F.lit("свод правил")), "Свод правил")
        .when(ext == ".pdf", "PDF").when(ext.isin(".doc", ".docx", ".rtf"), "WORD").when(ext.isin(".xls", ".xlsx"), "EXCEL").otherwise("HTML")
    )
