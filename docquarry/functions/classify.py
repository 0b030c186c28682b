"""What a response is: type and file extension, from headers, URL and first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import disposition_name
from .text import let, text
from .url import suffix, suffix_of

# Extensions of content types without a better hint.
EXTENSIONS = {
    "application/json": ".json", "application/xml": ".xml", "application/zip": ".zip", "application/octet-stream": ".bin", "image/png": ".png",
    "image/jpeg": ".jpg", "image/gif": ".gif", "audio/mpeg": ".mp3", "video/mp4": ".mp4", "application/javascript": ".js",
}
WORD, EXCEL = (".doc", ".docx"), (".xls", ".xlsx", ".csv")


def starts_with(body: Column, magic: bytes) -> Column:
    return F.hex(F.substring(body, 1, len(magic))) == magic.hex().upper()


def response_type(url: Column, content_type: Column, body: Column, disposition: Column) -> Column:
    """struct(file_type, ext); the first rule that fits decides."""
    whole = F.lower(text(content_type))
    known = F.struct(whole.alias("whole"), F.trim(F.regexp_extract(whole, r"^([^;]*)", 1)).alias("ct"), suffix_of(disposition_name(disposition)).alias("cd"), suffix(url).alias("us"), F.coalesce(body, F.lit(b"")).alias("body"))
    return let(known, _decide)


def _decide(k: Column) -> Column:
    whole, ct, cd, us, body = (k[n] for n in ("whole", "ct", "cd", "us", "body"))
    # Bytes as characters of one byte each; hex keeps ASCII letters comparable without decoding errors.
    head = F.hex(F.substring(body, 1, 500))
    # ASCII letters in either case, byte by byte.
    tag = lambda t: head.rlike("^(..)*" + "".join(f"({c.lower().encode().hex().upper()}|{c.upper().encode().hex().upper()})" for c in t))
    html = ct.isin("text/html", "application/xhtml+xml") | tag("<html") | tag("<!doctype html")
    first = lambda default: F.coalesce(F.nullif(cd, F.lit("")), F.nullif(us, F.lit("")), F.lit(default))
    kind = lambda t, e: F.struct(F.lit(t).alias("file_type"), (F.lit(e) if isinstance(e, str) else e).alias("ext"))
    guessed = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ct), F.lit(".bin"))
    rest = first("")
    zipped = starts_with(body, b"PK\x03\x04")
    return (
        F.when(starts_with(body, b"%PDF") | F.contains(whole, F.lit("pdf")), kind("PDF", ".pdf"))
        .when(html, kind("HTML_TEXT", ".txt"))
        .when(F.contains(ct, F.lit("rtf")) | starts_with(body, b"{\\rtf") | (us == ".rtf") | (cd == ".rtf"), kind("WORD_RTF", ".rtf"))
        .when(us.isin(*WORD) | cd.isin(*WORD) | F.contains(ct, F.lit("word")), kind("WORD_DOC", first(".docx")))
        .when(us.isin(*EXCEL) | cd.isin(*EXCEL) | F.contains(ct, F.lit("excel")) | F.contains(ct, F.lit("spreadsheet")), kind("EXCEL_TABLE", first(".xlsx")))
        .when(zipped, kind("ZIP_OR_OFFICE", first(".zip")))
        .when(F.startswith(ct, F.lit("text/")), kind("TEXT", ".txt"))
        .otherwise(kind("BINARY_FILE", F.lower(F.when((rest == "") | (F.length(rest) > 10), guessed).otherwise(rest))))
    )


def is_valid_pdf(body: Column) -> Column:
    return starts_with(body, b"%PDF-")
