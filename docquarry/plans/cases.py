"""Small literal tables for operators whose inputs no table holds: as a DataFrame, and as VALUES for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URLS = (
    "http://publication.pravo.gov.ru/document/0001202301010001", "https://www.publication.pravo.gov.ru/Document/View/0001202301010002?index=1",
    "http://publication.pravo.gov.ru/file/pdf?eoNumber=0001202301010003", "http://pravo.gov.ru/proxy/ips/?docbody=&nd=102000001&lastdoc=1",
    "http://pravo.gov.ru/proxy/ips/?doc_itself=&nd=102000002", "https://vsrf.ru/documents/own/12345/", "https://www.vsrf.ru/documents/own?year=2020",
    "https://protect.gost.ru/v.aspx", "http://protect.gost.ru/search?search=gost", "https://minstroyrf.gov.ru/docs/", "http://minstroyrf.gov.ru/docs/123",
    "https://example.org:8080/a/b/file.PDF?x=1#top", "http://example.org", "ftp://example.org/x.doc", "http://example.org/path.d/.hidden",
    "http://example.org/uploaded/files/n.bin", "http://example.org/ru/documents/77", "http://sudexpert.ru/", "http://sniprf.ru/sp22-13330-2016",
    "http://sniprf.ru/razdel-1/2-03-01", "http://example.org/Report_2020", "http://user@Example.ORG/A/../b?q=1&nd=55", "not a url", "",
)
REFS = tuple((b, r) for b in ("http://a.org/b/c/d?q", "http://a.org") for r in ("g", "./g", "/g", "//h.org/x", "?y", "g?y", "#s", "../g", "../../g", "../../../g", "g;x=1/./y", "", "http://z.org/k", "mailto:x@y.z"))
QUERIES = (
    "какие документы нужны для фундамента дома", "СП 22.13330 основания зданий", "сп 63.13330 и sp 22.13330.2016", "бетон, железобетонные конструкции",
    "ГОСТ 27751", "", "  ", "search the the with", "Ёлка по-новому",
)
NAMES = ("  a  b<c>:d ", "..", "", "x" * 150, "Отчёт / 2020*.pdf", "a\\b|c?", " . _ ", "tab\tline\nend", "ends. ")
HEADERS = ('attachment; filename="a b.pdf"', "attachment; filename=x.doc", "attachment; filename*=UTF-8''%D0%B0.rtf", "inline", "", 'attachment; filename="a%20b.xlsx"; size=3')
TYPES = (
    ("http://a.org/x.pdf", "text/html", "<html>", ""), ("http://a.org/x", "application/pdf", "zz", ""), ("http://a.org/x", "application/octet-stream", "%PDF-1.4", ""),
    ("http://a.org/x.rtf", "application/octet-stream", "", ""), ("http://a.org/x", "", "{\\rtf1", ""), ("http://a.org/x.docx", "application/zip", "PK\x03\x04", ""),
    ("http://a.org/x.aspx", "application/msword", "", ""), ("http://a.org/x.csv", "text/csv", "a;b", ""), ("http://a.org/x", "application/vnd.ms-excel", "", ""),
    ("http://a.org/x", "", "PK\x03\x04", ""), ("http://a.org/x.zip", "", "PK\x03\x04", ""), ("http://a.org/x", "text/plain; charset=utf-8", "hello", ""),
    ("http://a.org/x", "image/png", "", ""), ("http://a.org/x.verylongextension", "unknown/unknown", "", ""), ("http://a.org/x", "", "  <!DocType HTML>", ""),
    ("http://a.org/x", "", "", "attachment; filename=b.doc"), ("http://a.org/x", "application/xhtml+xml", "", ""),
)
#: Letters for texts of the pages in Cyrillic, and charsets of one byte a letter to write them in.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопярстувшчыз"
TAIL = "\nзакон о порядке"
ONE_BYTE = ("windows-1251", "koi8-r", "iso-8859-5")
FOLDERS = (("05_Нормы\\01_Контрольные источники", "x"), ("a/b\\\\c", "Официальный раздел"), ("plain", "plain"), ("", ""))


def frame(spark: SparkSession, rows: tuple, ddl: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: tuple, names: str) -> str:
    """A CTE body: SELECT * FROM (VALUES ...) AS t(names)."""
    body = ", ".join("(" + ", ".join(map(_literal, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"
