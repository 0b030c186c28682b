"""Charsets judged on bytes against the same judgement of whole decodings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.lexicons import CHARSETS, DOMAIN_WORDS, FUNCTION_WORDS
from docquarry.sources import encoding

R = random.Random(8)
WORDS = [w.replace(r"\w*", "ого") for w in DOMAIN_WORDS] + list(FUNCTION_WORDS) + ["мир", "дом_1", "Россия2", "судебн", "п. 5", "«В»", "ЁЖ", "Рим", "Рост", "слово", "text", "И", "С.", "вЂ”", "Г", "\n", "В«", "x" * 9]
BYTES = [bytes(R.randrange(256) for _ in range(R.randint(0, 80))) for _ in range(60)] + [b"", bytes(range(256)), b"\xcf\xbf\xbd" * 7, "пїЅ".encode("cp1251") * 3]


def bodies():
    out = list(BYTES)
    for _ in range(150):
        text = " ".join(R.choice(WORDS) for _ in range(R.randint(1, 60)))
        text = text.upper() if R.random() < 0.15 else text
        out.append(text.encode(R.choice(["cp1251", "koi8-r", "iso8859-5", "utf-8", "cp866"]), "replace"))
    return out


@pytest.mark.parametrize("name", ["windows-1251", "cp1251", "koi8-r", "iso-8859-5", "iso-8859-1", "latin-1", "cp866", "ascii", "mac-cyrillic", "koi8-u", "cp1252"])
def test_points_of_bytes_equal_those_of_the_decoding(name):
    table = encoding.bytewise(name)
    for body in bodies():
        histogram = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
        assert table.points(body, histogram, name) == encoding.points(body.decode(name, "replace"), name), body


def test_charsets_of_more_bytes_have_no_table():
    assert [encoding.bytewise(n) for n in ("utf-8", "utf-16", "shift_jis", "gb18030", "cp932", "euc-kr", "utf-7", "idna", "rot13", "hex", "nothing", "unicode_escape")] == [None] * 12


def brute(body, header=None, http=None):
    """Every candidate decoded whole; a clean UTF-8 text before all."""
    try:
        text = body.decode("utf-8")
        tokens, cyrillic = len(encoding._TOKEN.findall(text)), len(encoding._CYRILLIC.findall(text))
        if text.count("�") + text.count("пїЅ") <= 5 and len(encoding._CONTROL.findall(text)) <= 3 and not (tokens > 20 and cyrillic < 2 * tokens):
            return text, "utf-8"
    except UnicodeDecodeError:
        pass
    best = None
    for name in encoding.candidates(body, header, http):
        text = encoding.decoded(body, name)
        if text is not None and (best is None or encoding.points(text, name) > best[0]):
            best = (encoding.points(text, name), text, name)
    return best[1:] if best else (body.decode("utf-8", "replace"), "utf-8-replace")


def test_decoding_equals_brute_force(spark):
    rows = [(k, b, R.choice([None, "koi8-r", "cp866", "nonsense", "utf-8"]), R.choice([None, "ISO-8859-1"])) for k, b in enumerate(bodies())]
    rows += [(900, None, None, None), (901, b"<meta charset=koi8-r>" + "суд и закон".encode("koi8-r"), None, None), (901, b"x", None, None), (None, "закон".encode("cp1251"), None, None), (902, b"a" * 60_000 + b"<meta charset=cp866>" + "закон о суде".encode("cp866"), None, None)]
    df = spark.createDataFrame(rows, "id long, body binary, h string, c string").withColumns({"text": F.lit("clash"), "charset": F.lit("clash")}).repartition(3)
    got = sorted(map(repr, ((r["id"], r["text"], r["charset"]) for r in encoding.decode(df, "id", header_charset=F.col("h"), http_charset=F.col("c")).collect())))
    assert got == sorted(repr((k, *brute(b or b"", h, c))) for k, b, h, c in rows)


def test_limits_are_parameters():
    body = "закон о суде ".encode("koi8-r") * 10
    named = b" " * 100 + b"<meta charset=x-made-up>"
    assert encoding.candidates(named)[0] == "x-made-up" and "x-made-up" not in encoding.candidates(named, head=50)
    text, name = encoding.choose(body, sample=0)
    assert encoding.choose(body)[0] == body.decode("koi8-r") and text == body.decode(name, "replace")


@pytest.mark.parametrize("text", ["<meta charset=utf-8>" + "EspaÑa, mañana y Ñandú. " * 30, "\ufffd и ещё " * 9, "ÐÑ " * 40 + "\x85" * 5, "Рис и Сыр " * 30])
def test_strict_utf8_is_never_read_as_another_charset(text):
    """Whatever signs of a wrong charset it has: Spanish capitals, C1 controls, replacement characters, Р and С."""
    got, name = encoding.choose(text.encode())
    assert got == text and encoding.normalized(name) == "utf-8"


def test_utf16_without_a_mark_is_no_utf8():
    text = "plain text of a page " * 10
    assert encoding.points(text, "utf-16-le") > encoding.points(text.encode("utf-16-le").decode(), "utf-8")


def test_small_letters_that_are_capitals_elsewhere_make_no_words():
    """KOI8-R read as windows-1251: each "он" is "ПО"."""
    text = "<meta charset=utf-8>" + "он даст хлеб " * 800 + "закон о порядке"
    got, name = encoding.choose(text.encode("koi8-r"))
    assert got == text and encoding.normalized(name) == "koi8-r"


def test_links_of_a_spanish_page_keep_their_titles(spark):
    """Their places follow from the titles' lengths."""
    from docquarry.plans import acquire

    html = "<html><p>" + "Ñandú mañana " * 30 + '</p><p><a href="/documents/own?page=1">ééelle</a></p><p><a href="/documents/own?page=2">oueuxen</a></p></html>'
    row = ("http://www.vsrf.ru/documents/own?page=9", None, 200, "text/html", None, "utf-8", html.encode())
    answers = spark.createDataFrame([row], "url string, final_url string, http_status int, content_type string, content_disposition string, http_encoding string, body binary")
    plan = acquire.planned_links(answers, acquire.Options()).orderBy("place").collect()
    assert [r["title"] for r in plan] == ["ééelle", "oueuxen"]
