"""Expressions for file names, paths and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, norm_space, safe_name, strip_chars, text
from .url import doc_id, unquote


def subpath(folder: Column) -> Column:
    """Backslash- or slash-separated folders as a clean relative path."""
    parts = F.filter(F.split(strip_chars(F.trim(text(folder)), "\\/"), r"[\\/]+"), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: safe_name(p, 80)), "/")


def _safe_to(c: Column, most: Column) -> Column:
    """safe_name() for a length that is a column."""
    clean = strip_chars(F.translate(norm_space(c), '<>:"/\\|?*', "_" * 9), " ._")
    return F.regexp_replace(strip_chars(F.left(clean, most), " ._"), "^$", "document")


def file_name(num: Column, title: Column, url: Column, ext: Column) -> Column:
    """num_title_id.ext with what there is of them; an id is kept whole where the name gets long."""
    n = F.when(text(num) == "", "").otherwise(safe_name(num, 20))

    def named(i: Column) -> Column:
        whole = F.concat_ws("_", F.nullif(n, F.lit("")), safe_name(title, 110), F.nullif(i, F.lit("")))
        keep = F.greatest(F.lit(40), 130 - F.length(i) - 1)
        short = lambda base: F.concat(_safe_to(F.left(base, keep), keep), F.lit("_"), i)
        return let(whole, lambda base: F.when((i != "") & (F.length(base) > 130), short(base)).otherwise(base))

    return F.concat(safe_name(let(doc_id(url), named), 140), ext)


def fit_path(folder: Column, name: Column, most: int = 200) -> Column:
    """folder/name in at most `most` characters where that can be: head and tail of the stem stay."""

    def cut(k: Column) -> Column:
        folder, stem, ext = k["folder"], k["stem"], k["ext"]
        allowed = F.greatest(F.lit(30), most - F.length(folder) - 1 - F.length(ext))
        tail = F.least(F.lit(36), F.greatest(F.lit(10), F.floor(allowed / 3).cast("int")))
        head = F.greatest(F.lit(10), allowed - tail - 1)
        halves = F.concat(_safe_to(F.left(stem, head), head), F.lit("_"), _safe_to(F.right(stem, tail), tail))
        new = F.when(F.length(stem) <= allowed, _safe_to(stem, allowed)).otherwise(halves)
        whole = F.concat(folder, F.lit("/"), stem, ext)
        return F.when(F.length(whole) <= most, whole).otherwise(F.concat(folder, F.lit("/"), _safe_to(new, allowed), ext))

    def parts(k: Column) -> Column:
        ext = F.regexp_extract(k["name"], r"[^.](\.[^.]+)$", 1)
        return let(F.struct(k["folder"].alias("folder"), F.left(k["name"], F.length(k["name"]) - F.length(ext)).alias("stem"), ext.alias("ext")), cut)

    return let(F.struct(folder.alias("folder"), name.alias("name")), parts)


def child_folder(folder: Column, parent_stem: Column, num: Column, word: str = "вложения") -> Column:
    i = F.when(text(num) != "", safe_name(num, 20)).otherwise(doc_id(parent_stem))
    name = safe_name(F.concat(F.when(i != "", i).otherwise(F.left(parent_stem, F.lit(40))), F.lit(f"_{word}")), 80)
    return F.concat_ws("/", F.nullif(subpath(folder), F.lit("")), name)


def disposition_name(header: Column) -> Column:
    """File name of a Content-Disposition header, or empty."""
    h = text(header)
    plain = F.regexp_extract(h, r"(?i);\s*filename\s*=\s*(\"(?:[^\"\\]|\\.)*\"|[^;]*)", 1)
    plain = F.regexp_replace(F.btrim(plain), r'^"|"$', "")
    coded = F.regexp_extract(h, r"(?i)filename\*=[^']*''([^;]+)", 1)
    return F.when(plain != "", safe_name(unquote(plain), 100)).when(coded != "", safe_name(unquote(coded), 100)).otherwise("")


def header_charset(content_type: Column) -> Column:
    return F.regexp_extract(text(content_type), r"(?i)charset\s*=\s*['\"]?([^;'\"\s]+)", 1)


def link_text(c: Column, most: int = 220) -> Column:
    return F.trim(F.left(norm_space(c), F.lit(most)))


def join_errors(a: Column, b: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(text(a), F.lit("")), F.nullif(text(b), F.lit("")))
