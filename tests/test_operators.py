"""Line, link and crawl operators, sources, sinks and streams on small inputs."""

import io
import zipfile

from pyspark.sql import functions as F

from docquarry.operators import crawl, lines, search
from docquarry.sources import encoding, fetch, formats, html_tree, registry, sinks
from docquarry.streaming import landing


def test_lines_of_a_legal_text(spark):
    body = "Меню\nПоиск\nФедеральный закон\nФедеральный закон\nкороткая\nещё одна\nтретья строка\nчетвёртая\nСтатья 1. Общие положения\n12:30\n \nконец\u0085после"
    df = spark.createDataFrame([(1, body), (2, None), (3, "Меню")], "id long, t string")
    got = {r["id"]: r["text"] for r in lines.normalize(df, "id", "t").collect()}
    assert got == {1: "Федеральный закон\nкороткая\nещё одна\nтретья строка\nСтатья 1. Общие положения\nконец\nпосле\n", 2: "", 3: ""}


def test_trim_start(spark):
    df = spark.createDataFrame([("шапка\nПриказ о том\nтекст",), ("первая\nвторая",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(lines.trim_start(F.col("t"))).collect()] == ["Приказ о том\nтекст\n", "первая\nвторая\n", "", ""]


def test_main_text_prefers_the_document(spark):
    law = "<p>Федеральный закон о том и о сём, принятый в установленном порядке и действующий поныне.</p>" * 5
    page = f"<html><body><div class='menu'><a href='/'>x</a></div><div>{'слово ' * 60}</div><div id='content'>{law.replace('</p>', ' пункт.</p>')}</div></body></html>"
    df = spark.createDataFrame([(1, "http://a.org/", page), (2, "http://a.org/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_tree.main_text(df).collect()}
    assert got[1].startswith("Федеральный закон") and "слово" not in got[1] and got[2] == ""


def test_anchors_take_the_text_around(spark):
    page = "<ul><li>Приказ о порядке <a href='/d/1'>тут</a></li></ul><a href='#x'>no</a><a href='mailto:a@b'>no</a>"
    df = spark.createDataFrame([(1, "http://a.org/b", page)], "page_id long, url string, html string")
    got = html_tree.anchors(df).collect()
    assert [(r["url"], r["title"]) for r in got] == [("http://a.org/d/1", "Приказ о порядке тут")]


def test_encodings(spark):
    s = "Постановление Правительства Российской Федерации о документах и приказ для суда"
    rows = [(i, bytearray(s.encode(c))) for i, c in enumerate(("utf-8", "cp1251", "koi8-r", "iso-8859-5"))] + [(9, None)]
    got = {r["id"]: r["text"] for r in encoding.decode(spark.createDataFrame(rows, "id long, body binary"), "id").collect()}
    assert got == {0: s, 1: s, 2: s, 3: s, 9: ""}


def docx(xml, rels=""):
    b = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{xml}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
    return b.getvalue()


def p(t):
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def row(*cells):
    return "<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in cells) + "</w:tr>"


def test_registry(spark, tmp_path):
    link = '<w:p><w:hyperlink r:id="r1"><w:r><w:t>см.</w:t></w:r></w:hyperlink><w:r><w:t> https://b.org/x). http://a.org/d</w:t></w:r></w:p>'
    table = "<w:tbl>" + row(p("№"), p("Документ"), p("Папка"), p("Ссылка")) + row(p(""), p("Закон"), p("01\\02"), link) + row(p(""), p(""), p("x"), p("http://c.org")) + row(p("7"), p("Приказ"), p("x"), p("http://c.org")) + row(p(""), p("Устав"), p("x"), p("http://e.org")) + "</w:tbl>"
    other = "<w:tbl>" + row(p("a"), p("b")) + row(p("http://d.org"), p("c")) + "</w:tbl>"
    (tmp_path / "r.docx").write_bytes(docx(table + other, '<Relationship Id="r1" Target="http://a.org/d"/>'))
    got = registry.registry_items(registry.table_rows(spark, str(tmp_path))).orderBy("row_no", "ord").collect()
    assert [(r["row_no"], r["num"], r["title"], r["original_url"], r["download_url"]) for r in got] == [
        (2, "1", "Закон", "http://a.org/d", "http://a.org/d"), (2, "1", "Закон", "https://b.org/x", "http://b.org/x"), (4, "7", "Приказ", "http://c.org", "http://c.org"), (5, "3", "Устав", "http://e.org", "http://e.org"),
    ]


def test_formats(spark):
    x = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(x, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>общая</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    rtf = rb"{\rtf1{\fonttbl{\f0 Arial;}}\uc1\u1071? \'ff\par 1\emdash y\tab \{z\}}"
    rows = [("d", ".docx", docx(p("Первый") + "<w:tbl>" + row(p("a"), p(""), p("b")) + "</w:tbl>")), ("x", ".xlsx", x.getvalue()), ("r", ".rtf", rtf), ("c", ".csv", "a;б\n\n1;2".encode("cp1251")), ("b", ".docx", b"broken"), ("o", ".doc", b""), ("n", None, None)]
    got = {r["k"]: (r["text"], r["error"]) for r in formats.texts(spark.createDataFrame(rows, "k string, ext string, body binary"), "k").collect()}
    assert got["d"] == ("Первый\na | b\n", "") and got["x"] == ("[sheet1]\nобщая | 5 | in\n", "") and got["r"][0] == "Я я\n1—y {z}\n"
    assert got["c"][0] == "a;б\n1;2\n" and "BadZipFile" in got["b"][1] and "legacy" in got["o"][1] and got["n"][1]


def test_fetcher_errors_are_rows_and_redirects_end(spark):
    def fetcher(u):
        if "bad" in u:
            raise ValueError("no")
        return {"final_url": u, "http_status": 200, "body": b"x"}

    got = {r["url"]: r["error"] for r in fetch.fetch(spark.createDataFrame([("http://a",), ("http://bad",)], "url string"), fetcher).collect()}
    assert got == {"http://a": None, "http://bad": "ValueError: no"}
    hops = spark.createDataFrame([("a", 301, "b"), ("b", 302, "c"), ("l", 301, "m"), ("m", 301, "l"), ("n", 301, None)], "url string, http_status int, location string")
    ends = {r["url"]: (r["final_url"], r["n_hops"], r["error"]) for r in fetch.redirect_chains(spark.createDataFrame([("a",), ("l",), ("n",), ("z",)], "url string"), hops).collect()}
    assert ends == {"a": ("c", 2, None), "l": ("m", 1, "redirect loop"), "n": ("n", 0, None), "z": ("z", 0, None)}


def test_ajax_takes_the_full_list_unless_it_is_shorter(spark):
    rows = [("u", False, '{"pages": {"before": 2}, "list": ["a"]}'), ("u", True, '{"list": ["a", "b"]}'), ("v", False, '{"list": ["a", "b"]}'), ("v", True, '{"list": ["c"]}'), ("w", False, "broken")]
    got = fetch.ajax_fragments(spark.createDataFrame(rows, "url string, full boolean, body string")).orderBy("url", "ord").collect()
    assert [(r["url"], r["fragment"]) for r in got] == [("u", "a"), ("u", "b"), ("v", "a"), ("v", "b")]


def test_error_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("OK_PDF", "a", ""), ("ERROR", 'multi\nline "q"', "http://x"), ("DRY_RUN", "", "")], "status string, error string, original_url string")
    assert sinks.write_error_log(df, str(tmp_path / "log"))
    got = sinks.read_error_log(spark, str(tmp_path / "log")).collect()
    assert [(r["status"], r["error"], r["original_url"], r["title"]) for r in got] == [("ERROR", 'multi\nline "q"', "http://x", "")]
    assert not sinks.write_error_log(df.where("status <> 'ERROR'"), str(tmp_path / "log2"))


def test_texts_are_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "target string, text string")
    sinks.write_texts(a, path)
    sinks.write_texts(spark.createDataFrame([("b", "x"), ("c", "3")], a.schema), path, spark.read.parquet(path))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_crawl_lets_siblings_share_a_child(spark):
    """Portals leave out what was visited on the way to them, other pages don't; a shared child comes once for each way."""
    edges = [("a", "b", 1, True), ("a", "c", 2, True), ("b", "d", 1, True), ("c", "d", 1, True), ("d", "a", 1, True), ("d", "e", 2, True), ("e", "d", 1, False), ("b", "a", 2, True)]
    u = lambda x: f"http://h.org/{x}"
    plan = spark.createDataFrame([(u(s), p, u(d), d, u(d), n) for s, d, p, n in edges], "src string, place int, url string, title string, link_key string, navigation boolean")
    items = spark.createDataFrame([(7, "7", "t", "f", u("a"))], "id long, num string, title string, folder string, original_url string")
    got = sorted((r["path"], r["title"], r["num"], r["depth"]) for r in crawl.walk(items, plan, max_depth=4).collect())
    assert got == [
        ("7", "t", "7", 0), ("7.01", "b", "7.01", 1), ("7.01.01", "d", "7.01.01", 2), ("7.01.01.02", "e", "7.01.01.02", 3), ("7.01.01.02.01", "d", "7.01.01.02.01", 4),
        ("7.02", "c", "7.02", 1), ("7.02.01", "d", "7.02.01", 2), ("7.02.01.02", "e", "7.02.01.02", 3), ("7.02.01.02.01", "d", "7.02.01.02.01", 4),
    ]


def test_states_follow_from_the_links_states(spark):
    """saved: a child that saved three below counts three, a failed one is an error with its message, at most as many as asked."""
    rows = [("r", None, 0, 0, "u", "", "page"), ("r.1", "r", 1, 1, "u1", "", "page"), ("r.2", "r", 1, 2, "u2", "gone", "bad"), ("r.3", "r", 1, 3, "u3", "lost", "bad"), *((f"r.1.{k}", "r.1", 2, k, f"v{k}", "", "file") for k in (1, 2, 3)), ("s", None, 0, 0, "x", "own", "page")]
    items = spark.createDataFrame(rows, "path string, parent string, depth int, place int, original_url string, error string, kind string")
    status = lambda n: F.when(F.col("kind") == "bad", "ERROR").when((F.col("kind") == "page") & (n == 0), "ERROR_NO_LINKED_DOCUMENTS").otherwise("OK")
    got = {r["path"]: (r["status"], r["linked_saved"], r["linked_errors"], r["error"]) for r in crawl.settled(items, status, 2, messages=1).collect()}
    assert got["r.1"] == ("OK", 3, 0, "") and got["r"] == ("OK", 3, 2, "errors of links: u2 -> ERROR: gone") and got["s"] == ("ERROR_NO_LINKED_DOCUMENTS", 0, 0, "own")


def test_linked_documents_of_a_portal(spark):
    """A section's documents are its children, named and numbered after it; the section is OK through them; a second
    section that leads back is not followed in circles."""
    from docquarry.plans.acquire import Options, acquire

    items = spark.createDataFrame([(1, "5", "Раздел", "a", "http://vsrf.ru/documents")], "id long, num string, title string, folder string, original_url string")
    top = '<ul><li>Обзор практики <a href="/documents/own/7">№ 7</a></li></ul><p><a href="/documents/own?page=2">далее</a></p><a href="/about">о нас</a><a href="/documents/own/9">нет</a>'
    more = '<a href="/documents">назад</a><a href="/documents/own/7">снова</a><a href="/documents/own/8.pdf">файл</a>'
    page = lambda u, body, kind="text/html": (u, None, 200, kind, None, None, body.encode())
    rows = [page("http://vsrf.ru/documents", top), page("http://vsrf.ru/documents/own/7", "<p>Постановление</p>"), page("http://vsrf.ru/documents/own?page=2", more), page("http://vsrf.ru/documents/own/8.pdf", "%PDF-1.4", "application/pdf")]
    resp = spark.createDataFrame(rows, "url string, final_url string, http_status int, content_type string, content_disposition string, http_encoding string, body binary")
    got = {r["path"]: r for r in acquire(items, resp).collect()}
    found = {k: (r["original_url"].removeprefix("http://vsrf.ru/documents"), r["status"], r["linked_saved"], r["linked_errors"]) for k, r in got.items()}
    assert found == {
        "1": ("", "OK_LINKED_DOCUMENTS", 3, 1), "1.01": ("/own/9", "ERROR", 0, 0), "1.02": ("/own/7", "OK_HTML_TEXT", 0, 0), "1.03": ("/own?page=2", "OK_LINKED_DOCUMENTS", 2, 0),
        "1.03.01": ("/own/8.pdf", "OK_PDF", 0, 0), "1.03.02": ("/own/7", "OK_HTML_TEXT", 0, 0),
    }
    assert got["1.02"]["num"] == "5.02" and "5_вложения" in got["1.02"]["saved_to"] and "Обзор практики № 7" in got["1.02"]["saved_to"].replace("_", " ")
    assert "http://vsrf.ru/documents/own/9 -> ERROR: no response" in got["1"]["error"]
    alone = acquire(items, resp, None, Options(follow_page_links=False)).collect()
    assert [(r["path"], r["status"]) for r in alone] == [("1", "ERROR_NO_LINKED_DOCUMENTS")]


def test_search_response(spark):
    anchors = spark.createDataFrame([(0, 0, "direct", "http://sniprf.ru/sp22-2016", "СП 22.13330 Основания зданий", ""), (0, 1, "catalog", "http://sniprf.ru/sp22-2016#x", "СП 22.13330 Основания зданий", ""), (1, 0, "catalog", "http://other.org/sp1", "СП 1 основания", "")], "page_ord int, anchor_ord int, mode string, url string, title string, snippet string")
    from docquarry.functions.query import expand_words, query_words

    found = search.candidates(anchors, expand_words(query_words(F.lit("основания"))))
    assert [(r["mode"], r["url"]) for r in found.collect()] == [("direct", "http://sniprf.ru/sp22-2016")]
    reports = search.page_reports(spark.createDataFrame([("direct", 0, "u", "ok", "")], "mode string, page_ord int, page_url string, status string, error string"), found)
    json = search.response("основания", search.page_of(found, "x"), reports, found).first()[0]
    assert '"total_candidates_found" : 1' in json and "СП 22" in json
    assert "empty query" in search.response(" ", found, reports, found).first()[0]


def test_search_in_three_phases(spark):
    import json

    from docquarry.plans import find

    query = "СП 22.13330 основания"
    planned = [tuple(r) for r in find.planned_urls(spark, query, 2).collect()]
    by_mode = {m: [u for k, _, u in planned if k == m] for m in search.MODES}
    assert all(by_mode.values()) and len(by_mode["site_search"]) == 6  # three forms of the search, two pages each
    named, catalog, site = by_mode["direct"][0], by_mode["catalog"][0], by_mode["site_search"][1]
    page = "<html><body><h1>СП 22.13330 Основания зданий</h1>" + "<p>Настоящий свод правил распространяется на основания зданий и сооружений.</p>" * 5 + "</body></html>"
    links = '<ul><li><a href="{}">СП 22.13330 Основания зданий</a></li><li><a href="/sp99-2011">СП 99 Основания сооружений</a></li><li><a href="/files/sp7.pdf">СП 7 Основания мостов</a></li></ul>'
    rows = [(named, page), (catalog, links.format(named + "#top")), (site, links.format("http://other.org/sp22")), (by_mode["catalog"][1], None), ("http://sniprf.ru/sp99-2011", page.replace("22.13330", "99"))]
    responses = spark.createDataFrame(rows, "url string, html string")
    got = json.loads(find.search_documents(responses, query, "x", 3, 2).first()[0])
    head = ["status", "query", "current_iteration", "max_pages", "limit", "min_score", "pages_checked", "page_reports", "total_candidates_found", "documents_returned", "has_more_documents", "documents"]
    assert list(got) == head and got["status"] == "success" and got["current_iteration"] == 1 and got["pages_checked"] == len(planned)
    assert list(got["documents"][0]) == ["title", "url", "document_type", "score", "matched_keywords", "snippet", "source_mode", "source_search_url", "content_status", "text_preview"]
    assert [(r["mode"].replace("_sp_url", ""), r["url"]) for r in got["page_reports"]] == [(m, u) for m in search.MODES for u in by_mode[m]]
    reports = {r["url"]: (r["status"], r["candidates_found"], r["error"]) for r in got["page_reports"]}
    # The first phase that finds a URL keeps it; other hosts are left out; only the direct phase doesn't report failures.
    assert reports[named] == ("ok", 1, "") and reports[catalog] == ("ok", 2, "") and reports[site] == ("ok", 0, "")
    assert reports[by_mode["direct"][1]] == ("ok", 0, "") and reports[by_mode["catalog"][1]] == ("error", 0, "no response")
    docs = {d["url"]: d for d in got["documents"]}
    assert got["documents"][0]["url"] == named and (got["total_candidates_found"], got["documents_returned"], got["has_more_documents"]) == (3, 3, False)
    assert docs[named]["source_mode"] == "direct_sp_url" and docs[named]["source_search_url"] == named and docs[named]["document_type"] == "СП"
    assert docs[named]["content_status"] == "html_text_extracted" and "свод правил" in docs[named]["text_preview"]
    assert docs["http://sniprf.ru/files/sp7.pdf"]["content_status"] == "binary_document_not_parsed_here" and docs["http://sniprf.ru/files/sp7.pdf"]["text_preview"] == ""
    second = json.loads(find.search_documents(responses, query, 2, 2, 2, include_full_text=True).first()[0])
    assert second["documents_returned"] == 1 and not second["has_more_documents"] and "text" in second["documents"][0]
    bare = json.loads(find.search_documents(responses, query, 1, 2, 2, include_text=False).first()[0])
    assert bare["has_more_documents"] and "content_status" not in bare["documents"][0]


def test_stream_cleans_each_url_once(spark, tmp_path):
    rows = [("http://a.org/x", "2024-01-01 00:00:00", "<b>hi</b>"), ("https://www.a.org/x#f", "2024-01-01 00:00:01", "<b>again</b>"), ("http://b.org/", "2024-01-01 00:00:02", None)]
    spark.createDataFrame(rows, "url string, fetched string, html string").withColumn("fetched", F.to_timestamp("fetched")).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    landing.start(landing.cleaned(landing.landing(spark, str(tmp_path / "in"))), lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(out).collect()) == ["http://a.org/x", "http://b.org/"]


def test_acquire(spark):
    from docquarry.plans.acquire import Options, acquire

    items = spark.createDataFrame([(1, "1", "Закон", "a\\b", "https://a.org/law"), (2, "2", "Файл", "a", "http://a.org/x.pdf"), (3, "", "Нет", "", "http://a.org/none"), (4, "4", "Портал", "x", "http://pravo.gov.ru/"), (5, "5", "Битый", "x", "http://a.org/bad.pdf")], "id long, num string, title string, folder string, original_url string")
    law = "<html><body><p>Федеральный закон о проверке</p></body></html>".encode("cp1251")
    rows = [("https://a.org/law", "https://a.org/law", 200, "text/html", None, None, law), ("http://a.org/law", None, 500, None, None, None, None), ("http://a.org/x.pdf", None, 200, "application/pdf", None, None, b"%PDF-1.4"), ("http://pravo.gov.ru/", None, 200, "text/html", None, None, b"<html>x</html>"), ("http://a.org/bad.pdf", None, 200, "application/pdf", None, None, b"oops")]
    resp = spark.createDataFrame(rows, "url string, final_url string, http_status int, content_type string, content_disposition string, http_encoding string, body binary")
    got = {r["id"]: r for r in acquire(items, resp).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "OK_HTML_TEXT", 2: "OK_PDF", 3: "ERROR", 4: "ERROR_NO_LINKED_DOCUMENTS", 5: "ERROR"}
    assert got[1]["text"] == "Федеральный закон о проверке\n" and got[1]["saved_to"] == "/archive/a/b/1_Закон.txt" and got[1]["encoding"] in ("cp1251", "windows-1251")
    old = spark.createDataFrame([("/archive/a/b/1_Закон.txt", "﻿текст"), ("/archive/a/2_Файл_x.pdf", None)], "saved_to string, text string")
    assert {r["id"]: r["status"] for r in acquire(items, resp, old).collect()}[1] == "SKIPPED_EXISTS"
    assert {r["status"] for r in acquire(items, resp, None, Options(dry_run=True)).collect()} == {"DRY_RUN"}


def test_html_files(spark, tmp_path):
    from docquarry.sources import files

    (tmp_path / "a.html").write_bytes("﻿<p>Приказ о файлах</p>".encode())
    got = files.cleaned_files(files.html_files(spark, str(tmp_path))).collect()
    assert [(r["target"].rpartition("/")[2], r["text"]) for r in got] == [("a.clean.txt", "Приказ о файлах\n")]


def test_planned_links(spark):
    from docquarry.operators import links

    rows = [(1, 0, "http://a.org/page", "page"), (1, 1, "http://a.org/x.pdf", "file"), (1, 2, "http://pravo.gov.ru/", "p"), (2, 0, "http://a.org/page", "page"), (2, 1, "http://a.org/y.pdf", "")]
    df = spark.createDataFrame(rows, "page_id long, ord int, url string, title string")
    got = links.planned(df, F.col("page_id") == 1).orderBy("page_id", "place").collect()
    assert [(r["page_id"], r["ord"]) for r in got] == [(1, 1), (1, 0), (1, 2), (2, 1)]
    assert {r["page_id"]: r["text"] for r in links.summary(df).collect()}[2] == "- page: http://a.org/page\n- http://a.org/y.pdf"


def test_decoded_pages_are_whole(spark, tmp_path):
    """Against brute force: pages are valid UTF-8, so each comes back as it is, beyond 2,000 characters too."""
    from docquarry.plans.queries import QUERIES

    pages = {1: "<p>краткая</p>", 2: "<p>" + "длинная страница " * 500 + "конец</p>", 3: "x" * 2001, 4: ""}
    spark.createDataFrame(list(pages.items()), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["charset"]) for r in QUERIES["decoded_pages"](spark, str(tmp_path)).collect()}
    assert got == {k: (t, "utf-8") for k, t in pages.items()}


def test_links_followed_takes_links_of_pages(spark, tmp_path):
    from docquarry.plans.queries import QUERIES

    link = lambda u, t: f"<a href='{u}'>{t}</a>"
    html = link("/a.pdf", "Приказ о документах") + link("/a.pdf#x", "Другое название") + link("/b.pdf", "") + link("javascript:void(0)", "x")
    spark.createDataFrame([(7, "http://vsrf.ru/documents", html), (8, "http://vsrf.ru/", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["links_followed"](spark, str(tmp_path)).collect()
    assert sorted((r["ord"], r["url"], r["title"]) for r in got if r["page_id"] == 7) == [(0, "http://vsrf.ru/a.pdf", "Приказ о документах"), (2, "http://vsrf.ru/b.pdf", "b")]
    assert {r["page_id"] for r in got} >= {-1, 7}


def test_cleaning_keeps_rows_apart_and_follows_the_row_operators(spark):
    texts = ["a line of some length that stays here as it is\nshort one\nshort two\nshort three\nshort four\n1 short\nshort five\nshort six", "x y z\nx y z\n\nother", None, "", "same line here\n" * 3]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[0]), (3, texts[2]), (4, texts[3]), (5, texts[4])], "id long, t string")
    got = {(r["id"], r["text"]) for r in lines.normalize(df, "id", "t").collect()}
    one = {}
    for k, t in enumerate(texts):
        rows = lines.cap_short_runs(lines.drop_repeats(lines.drop_boilerplate(lines.explode_lines(spark.createDataFrame([(k, t)], "id long, t string"), "id", "t")), "id"), "id")
        one[k] = "".join(f"{r['line']}\n" for r in rows.orderBy("pos").collect())
    assert got == {(1, one[0]), (1, one[1]), (None, one[0]), (3, ""), (4, ""), (5, one[4])} and "short four" not in one[0]


def test_a_clean_run_removes_the_error_log(spark, tmp_path):
    from docquarry.sources import sinks

    path = f"{tmp_path}/log"
    assert sinks.write_error_log(spark.createDataFrame([("ERROR",)], "status string"), path) and (tmp_path / "log").exists()
    assert not sinks.write_error_log(spark.createDataFrame([("OK",)], "status string"), path) and not (tmp_path / "log").exists()


def test_pages_that_share_an_id_keep_their_own_main_text(spark):
    page = "<html><body><nav>menu</nav><article><p>{}</p></article></body></html>"
    texts = ["Федеральный закон о первом. " * 12, "Федеральный закон о втором. " * 12, "Федеральный закон о третьем. " * 12]
    df = spark.createDataFrame([(1, page.format(texts[0])), (1, page.format(texts[1])), (None, page.format(texts[2])), (None, None)], "page_id int, html string")
    got = sorted((r["page_id"] or 0, r["text"].strip()) for r in html_tree.main_text(df).collect())
    assert got == sorted([(1, texts[0].strip()), (1, texts[1].strip()), (0, texts[2].strip()), (0, "")])


def test_pages_of_noise_alone_fall_back_to_all_their_lines(spark):
    df = spark.createDataFrame([(1, "<body><script>x()</script><div class='menu'>one  two</div><footer>three</footer></body>")], "page_id int, html string")
    assert html_tree.main_text(df).first()["text"].strip() == "" and html_tree.readable_text(df).first()["text"] == "one two\nthree\n"


def test_redirects_are_relative_to_their_page(spark):
    hops = spark.createDataFrame([("http://a.org/x/y", 302, "../z"), ("http://a.org/z", 301, "//b.org/")], "url string, http_status int, location string")
    start = spark.createDataFrame([("http://a.org/x/y",)], "url string")
    assert tuple(fetch.redirect_chains(start, hops).first()) == ("http://a.org/x/y", "http://b.org/", 2, None)
