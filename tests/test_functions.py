"""Expressions against the standard library and cases written by hand."""

from urllib.parse import parse_qs, quote, quote_plus, urlencode, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from docquarry.functions import classify, names, query, text, url
from docquarry.plans import cases


def column(spark, values, expr, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], ddl).select(expr).collect()]


def test_join_follows_the_standard(spark):
    got = column(spark, cases.REFS, url.join(F.col("b"), F.col("r")), "b string, r string")
    assert got == [urljoin(b, r) for b, r in cases.REFS]


def test_quotes(spark):
    xs = ["a b/c", "Ёж ~*", "x+y&z=1", "", "a.b_c-d"]
    assert column(spark, xs, url.quote_plus(F.col("x"))) == [quote_plus(x) for x in xs]
    assert column(spark, xs, url.quote(F.col("x"))) == [quote(x) for x in xs]


def test_docbody_is_rewritten(spark):
    u = "http://pravo.gov.ru/proxy/ips/?docbody=&nd=102&lastdoc=1&a=1&b=2&a=3#t"
    p = urlparse(u)
    pairs = [("doc_itself", ""), *((k, v) for k, vs in parse_qs(p.query, keep_blank_values=True).items() if k not in ("docbody", "lastdoc") for v in vs)]
    assert column(spark, [u], url.doc_itself(F.col("x"))) == [p._replace(query=urlencode(pairs)).geturl()]
    for same in ("http://pravo.gov.ru/proxy/ips/?doc_itself=&nd=1", "http://example.org/?docbody=1"):
        assert column(spark, [same], url.doc_itself(F.col("x"))) == [same]


def test_ajax_url(spark):
    got = column(spark, ["https://www.vsrf.ru/documents/own/?year=2020", "https://vsrf.ru/x"], url.vsrf_ajax(F.col("x")))
    assert got == ["https://www.vsrf.ru/documents/own/?year=2020&init=y", ""]


@pytest.mark.parametrize(
    ("ct", "body", "u", "cd", "want"),
    [
        ("text/html", b"%PDF-1", "http://a/x", "", ("PDF", ".pdf")), ("", b"   <HTML>", "http://a/x", "", ("HTML_TEXT", ".txt")),
        ("application/msword", b"", "http://a/x.aspx", "", ("WORD_DOC", ".aspx")), ("", b"PK\x03\x04", "http://a/x.xlsx", "", ("EXCEL_TABLE", ".xlsx")),
        ("", b"PK\x03\x04", "http://a/x", "", ("ZIP_OR_OFFICE", ".zip")), ("text/plain", b"x", "http://a/x", "", ("TEXT", ".txt")),
        ("image/png", b"", "http://a/x", "", ("BINARY_FILE", ".png")), ("", b"", "http://a/x.abcdefghijkl", "", ("BINARY_FILE", ".bin")),
        ("", b"", "http://a/x", "attachment; filename=q.RTF", ("WORD_RTF", ".rtf")), (None, None, None, None, ("BINARY_FILE", ".bin")),
    ],
)
def test_response_type(spark, ct, body, u, cd, want):
    df = spark.createDataFrame([(u, ct, body, cd)], "u string, ct string, b binary, cd string")
    got = df.select(classify.response_type(F.coalesce("u", F.lit("")), F.col("ct"), F.col("b"), F.col("cd")).alias("t")).select("t.*").first()
    assert tuple(got) == want


def test_disposition(spark):
    assert column(spark, cases.HEADERS, names.disposition_name(F.col("x"))) == ["a b.pdf", "x.doc", "а.rtf", "", "", "a b.xlsx"]


def test_long_file_name_keeps_its_id(spark):
    df = spark.createDataFrame([("1", "t" * 300, "http://a/?nd=12345")], "n string, t string, u string")
    got = df.select(names.file_name(F.col("n"), F.col("t"), F.col("u"), F.lit(".pdf"))).first()[0]
    assert got.endswith("_12345.pdf") and len(got) <= 144


def test_search_score(spark):
    q = F.lit("СП 22.13330 основания зданий")
    words = query.expand_words(query.query_words(q))
    df = spark.createDataFrame([("СП 22.13330.2016 Основания зданий и сооружений", "http://sniprf.ru/sp22-13330-2016"), ("x", "http://sniprf.ru/search")], "t string, u string")
    a, b = (r[0] for r in df.select(query.score(F.col("t"), F.col("u"), F.lit(""), words)).collect())
    assert a["score"] == 1.0 and "сп" in a["matched"] and b["score"] == 0.0


def test_sp_links_are_good_and_others_on_the_host_are_not(spark):
    df = spark.createDataFrame([("http://sniprf.ru/sp22", "СП 22 актуализированная редакция СНиП"), ("http://sniprf.ru/abc", "Некий документ"), ("http://a.org/d", "Некий документ"), ("http://a.org/d", "ab")], "u string, t string")
    assert [r[0] for r in df.select(query.is_bad_link(F.col("u"), F.col("t"))).collect()] == [False, True, False, True]


def test_wrapped_words(spark):
    assert column(spark, ["ab\ncd\nef g\nhi", "", None, "abcdef\ngh"], text.repair_wrapped_words(F.col("x"))) == ["abcdef ghi", "", "", "abcdef\ngh"]


def test_shell_page(spark):
    shell = "Текст документа: ... Загрузка документа"
    assert column(spark, [shell, shell + "\nСтатья 1 о том", "Загрузка документа", None], text.looks_like_shell(F.col("x"))) == [True, False, False, False]


def test_mojibake(spark):
    assert column(spark, ["Рџ Рё " * 30, "обычный текст", "�" * 6, None, "\x01\x02\x03\x04"], text.looks_like_mojibake(F.col("x"))) == [False, False, True, False, True]


def test_text_functions_never_return_null(spark):
    for f in (text.norm_space, text.safe_name, text.normalize_extracted, text.repair_wrapped_words):
        assert column(spark, [None], f(F.col("x")))[0] is not None
