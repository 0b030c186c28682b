"""Text expressions: all take and return columns, treat null as empty and never return null."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import ALLOWED_GENERIC, LEGAL_MARKERS, MOJIBAKE, REPLACED, SHELL_MARKERS

#: White space with the no-break and other Unicode spaces, which \s alone leaves out.
WHITE = r"[\s\p{Z}]+"
#: Ends of lines; each of them alone, so that empty lines stay.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it stands in there: keeps generated code small."""
    return F.transform(F.array(value), then)[0]


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def norm_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), WHITE, " "))


def lines(c: Column) -> Column:
    return F.split(text(c), LINE_END, -1)


def count_of(c: Column, word: str) -> Column:
    """How often word stands in c, without overlaps."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def one_of(words: Iterable[str]) -> str:
    """A pattern for any of the words; beginnings that words share stand in it once, so that most places are passed by
    after a character."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        tails.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + one_of(rest) for c, rest in tails.items() if c]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
    return f"(?:{body})?" if "" in tails and body else body


def counts_of(c: Column, words: Iterable[str]) -> Column:
    """How often the words stand in c, summed; each without overlaps of its own, but different words may overlap.

    The words that begin at one place are beginnings of each other. So each word has a level, the number of the words that
    it begins with, and a place counts once for each level that a word there has: a pass over c for each level instead
    of one for each word. Words that can overlap themselves, and repeated ones, are counted on their own.
    """
    levels: dict[int, list[str]] = {}
    alone: list[str] = []
    for w, times in Counter(words).items():
        single = any(w.startswith(w[-k:]) for k in range(1, len(w)))
        alone += [w] * (times if single else times - 1)
        if not single:
            levels.setdefault(sum(w.startswith(x) for x in set(words) if x != w and not any(x.startswith(x[-k:]) for k in range(1, len(x)))), []).append(w)
    out = F.lit(0).cast("long")
    for same in levels.values():
        out = out + F.regexp_count(c, F.lit(f"(?={one_of(same)})"))
    for w in alone:
        out = out + count_of(c, w)
    return out.cast("long")


def any_of(c: Column, words: Iterable[str]) -> Column:
    """Whether c holds one of the words, as a part of it."""
    words = list(words)
    return c.rlike(one_of(words)) if words else F.lit(False)


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def safe_name(c: Column, most: int = 120) -> Column:
    """A name that every file system takes, of at most `most` characters."""
    clean = F.translate(norm_space(c), '<>:"/\\|?*', "_" * 9)
    return F.regexp_replace(strip_chars(F.substring(strip_chars(clean, " ._"), 1, most), " ._"), "^$", "document")


def normalize_extracted(c: Column) -> Column:
    """Lines with single blanks, without empty ones; a final line feed if anything is left."""
    rows = F.filter(F.transform(lines(c), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
    return F.when(F.size(rows) > 0, F.concat(F.array_join(rows, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def repair_wrapped_words(c: Column) -> Column:
    """Joins a line to the one before if both meet in a letter and the last word there has at most four characters."""
    letter = "[A-Za-z\\u0400-\\u04FF]"
    rows = F.filter(F.transform(lines(c), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        short = F.length(F.regexp_extract(last, r"([^ ]*)$", 1)) <= 4
        joins = (F.size(acc) > 0) & last.rlike(f"{letter}$") & line.rlike(f"^{letter}") & short
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.concat(last, line)))).otherwise(F.concat(acc, F.array(line)))

    return F.aggregate(rows, F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "\n"))


def _controls(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"))


def mojibake_features(c: Column, sample: int | None = None) -> dict[str, Column]:
    """Counts of signs of a wrong charset, in the first `sample` characters or in all."""
    part = text(c) if sample is None else F.substring(text(c), 1, sample)
    return {
        "replacements": count_of(part, "\ufffd") + count_of(part, REPLACED),
        "controls": _controls(part).cast("long"),
        "tokens": F.regexp_count(part, F.lit(f"(?d){MOJIBAKE}")).cast("long"),
        "cyrillic": F.regexp_count(part, F.lit(r"[\x{400}-\x{4FF}]")).cast("long"),
    }


def looks_like_mojibake(c: Column, sample: int | None = None) -> Column:
    f = mojibake_features(c, sample)
    return (f["replacements"] > 5) | (f["controls"] > 3) | ((f["tokens"] > 20) & (f["cyrillic"] < f["tokens"] * 2))


def looks_like_shell(c: Column, markers: Iterable[str] = SHELL_MARKERS, sample: int | None = None) -> Column:
    """A viewer's page around a document rather than the document: two markers, and neither articles nor five points, in
    the first `sample` characters or in all."""
    part = text(c) if sample is None else F.substring(text(c), 1, sample)
    found = F.size(F.filter(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(part, m)))
    articles = part.rlike(r"(?iU)\bСтатья\s+\d+\b|\bГлава\s+[IVXLC0-9]+\b")
    points = F.regexp_count(part, F.lit(r"(?md)^\s*\d+[.)]\s+\S+")) >= 5
    return (found >= 2) & ~(articles | points)


def is_allowed_generic(folder: Column, title: Column, markers: Iterable[str] = ALLOWED_GENERIC) -> Column:
    return any_of(F.lower(F.concat_ws(" ", text(folder), text(title))), markers)


def has_legal(c: Column, markers: Iterable[str] = LEGAL_MARKERS) -> Column:
    return any_of(F.lower(c), markers)
