"""Candidate blocks as ranges of lines against each block's text taken, cleaned and scored on its own."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docquarry.functions.text import count_of, counts_of, lines, norm_space
from docquarry.lexicons import BOILERPLATE_LINES, CONTENT_ATTR_WORDS, DROP_ATTR_WORDS, DROP_TAGS, LEGAL_MARKERS
from docquarry.operators.lines import cleaned, text_score, trim_start
from docquarry.sources import html_tree
from docquarry.sources.html_tree import _ordered, parse, remove

R = random.Random(12)
PIECES = [
    "12.", "3)", "а)", "1. первое", "2) второе дело", "Статья", "статья 5", "7", "9 слов", "новости", "рус", "x", "Меню", "короткая", "ещё короче", "слово", "закон", "постановление от 5 мая",
    "a\nb\r\nc", "два\x0bстроки три", "одинаковая", "одинаковая", "длинная строка текста, в которой больше восьмидесяти знаков и ничего иного не говорится вовсе, кроме этого",
    "Российская федерация решила", "ссылка", "1.", "2.", "3.", "Английский english eng en", "12 : 30", "  ",
]


def page(r, depth=0):
    out = []
    for _ in range(r.randint(1, 6)):
        k = r.random()
        if k < 0.45 and depth < 6:
            tag = r.choice(["div", "div", "section", "article", "td", "p", "a", "main", "span"])
            attrs = r.choice(["", "", ' class="content"', ' id="main"', ' class="menu"', ' role="main"', ' class="detail text"'])
            out.append(f"<{tag}{attrs}>{page(r, depth + 1)}" + (f"</{tag}>" if r.random() < 0.9 else ""))
        else:
            out.append(r.choice(PIECES) * 1 + r.choice(["", "<br>", "\n", " "]))
            if r.random() < 0.3:
                out.append("<br>".join(r.choice(PIECES[:9]) for _ in range(r.randint(1, 9))))
    return "".join(out)


def naive(html):
    root = parse(html)
    remove(root, DROP_TAGS, DROP_ATTR_WORDS)
    out = []
    for k, e in enumerate(_ordered(list(root.elements()), root)):
        out.append((k, e.label(), "\n".join(e.pieces()), len(" ".join(e.pieces())), sum(len(" ".join(a.pieces())) for a in e.elements() if a.tag == "a" and a is not e)))
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rows = [page(random.Random(k)) for k in range(250)] + [f"<body>{page(R)}</body>" for _ in range(50)] + [None, "", "<p>", "статья<br>5<br>1.<br>2.<br>3.<br>слово"]
    rows += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    return spark.createDataFrame(list(enumerate(rows)), "page_id long, html string").repartition(3)


@pytest.fixture(scope="module")
def apart(spark, pages):
    """page_id, ord, text, score of every block, from the text of each."""
    rows = [(r["page_id"], *b) for r in pages.collect() for b in naive(r["html"] or "")]
    blocks = spark.createDataFrame(rows, "page_id long, ord int, attrs string, text string, text_len long, link_len long").withColumn("clean", cleaned(F.col("text")))
    density = F.when(F.col("text_len") == 0, 1.0).otherwise(F.col("link_len") / F.col("text_len"))
    like = F.exists(F.array(*map(F.lit, CONTENT_ATTR_WORDS)), lambda w: F.contains(F.col("attrs"), w))
    return blocks.select("page_id", "ord", "clean", F.length("clean").alias("n_chars"), text_score(F.col("clean"), content_like=like, link_density=density)["score"].alias("score")).persist()


@pytest.mark.parametrize("least", [0, 180])
def test_scores_equal_those_of_each_text(pages, apart, monkeypatch, least):
    monkeypatch.setattr(html_tree, "LEAST_BLOCK", least)
    got = {(r["page_id"], r["ord"]): (r["n_chars"], r["score"]) for r in html_tree.block_scores(pages).collect()}
    want = {(r["page_id"], r["ord"]): (r["n_chars"], r["score"]) for r in apart.collect() if r["ord"] == 0 or r["n_chars"] >= least}
    assert got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if got[k][0] != want[k][0] or got[k][1] != pytest.approx(want[k][1])] == []


def test_main_text_is_the_best_blocks(pages, apart, monkeypatch):
    for least in (0, 180):
        monkeypatch.setattr(html_tree, "LEAST_BLOCK", least)
        best = apart.where((F.col("ord") == 0) | (F.col("n_chars") >= least)).groupBy("page_id").agg(F.max_by("clean", F.struct("score", -F.col("ord"))).alias("text"))
        want = {r["page_id"]: r["text"] for r in best.select("page_id", trim_start(F.col("text")).alias("text")).collect()}
        assert {r["page_id"]: r["text"] for r in html_tree.main_text(pages).collect()} == want


def test_repeated_and_null_page_ids(spark):
    html = "<body><div>" + "Постановление правительства о порядке. " * 9 + "</div></body>"
    rows = [(1, html), (1, "<p>иной текст страницы</p>"), (None, html), (2, None)]
    got = html_tree.main_text(spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit("clash") for c in ("found", "blocks", "lines", "at")})).collect()
    assert sorted((repr(r["page_id"]), r["text"][:4]) for r in got) == [("1", "Пост"), ("1", "иной"), ("2", ""), ("None", "Пост")]


def test_nested_blocks_take_linear_time():
    def took(n):
        html = "".join(f"<div>строка {k} of the page<a>link</a>" for k in range(n))
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            got = html_tree.intervals(html)
            best = min(best, time.perf_counter() - began)
        assert len(got["lines"]) == 2 * n and len(got["blocks"]) == n + 1 and got["blocks"][1]["link_len"] == 4 * n
        return best

    assert took(4000) < 10 * took(1000)


def test_a_page_of_two_thousand_nested_blocks(spark):
    html = "".join(f"<div>Строка {k} закона о порядке ведения дел в учреждениях" for k in range(2000))
    rows = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = html_tree.block_scores(rows).collect()
    assert len(got) > 1990 and max(r["score"] for r in got) == next(r["score"] for r in got if r["ord"] == 1)
    assert html_tree.main_text(rows).first()["text"].count("\n") == 2000


@pytest.mark.parametrize("words", [LEGAL_MARKERS, BOILERPLATE_LINES, ("ab", "abc", "a", "bc", "aa", "b", "abab", "a"), ("x.", "x.y", "(")])
def test_counts_of_many_words_equal_those_of_each(spark, words):
    r = random.Random(5)
    texts = ["".join(r.choice([*words, "a", "b", "c", " ", "x", ".", "(", "y"]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    each = sum((count_of(F.col("t"), w) for w in words), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", each.alias("each"), counts_of(F.col("t"), words).alias("all")).collect()
    assert all(x["each"] == x["all"] for x in rows)


def test_lines_are_those_of_the_pattern(spark):
    texts = ["a\r\nb\nc\x0bd\x0ce\rf\x1cg\x1dh\x1ei\x85j k l", "один\n\nдва"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines(F.col("t")).alias("l"), norm_space(F.col("t"))).collect()
    assert all(r["l"] == r["t"].splitlines() for r in rows)
