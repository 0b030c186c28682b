"""A registry's documents from a server of this machine to files, states and the error log."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from docquarry import __main__ as command
from docquarry.sources import sinks
from docquarry.sources.fetch import http_fetcher
from tests.test_operators import docx, p, row
from tests.test_sinks import listed

LAW = '<html><body><p>Федеральный закон о проверке</p><p><a href="/files/a.pdf">Приложение</a></p><a href="/about">о нас</a><a href="/files/none.pdf">нет</a></body></html>'


class Pages(BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        Pages.asked.append(self.path)
        found = {
            "/law": (200, "text/html; charset=windows-1251", LAW.encode("cp1251")), "/files/a.pdf": (200, "application/pdf", b"%PDF-1.4 x"), "/notes": (200, "text/plain", "Заметки\n".encode()),
            "/flaky": (200, "text/plain", b"late") if Pages.asked.count("/flaky") > 1 else (503, "text/plain", b""), "/moved": (302, "/notes", b""), "/round": (301, "/round2", b""), "/round2": (301, "/round", b""),
        }
        status, kind, body = found.get(self.path, (404, "text/plain", b""))
        self.send_response(status)
        self.send_header("Location" if status in (301, 302) else "Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetcher_follows_redirects(server):
    get = http_fetcher(2, 2, most=3)
    assert get(f"{server}/moved")["final_url"] == f"{server}/notes" and get(f"{server}/law")["http_encoding"] == "windows-1251"
    with pytest.raises(ValueError, match="redirect loop"):
        get(f"{server}/round")
    with pytest.raises(ValueError, match="too many"):
        http_fetcher(2, 2, most=0)(f"{server}/moved")
    with pytest.raises(Exception, match="404"):
        get(f"{server}/nothing")


def test_a_registry_becomes_files(spark, server, tmp_path, capsys):
    table = "<w:tbl>" + row(p("№"), p("Документ"), p("Папка"), p("Ссылка"))
    table += row(p("1"), p("Закон"), p("01\\Законы"), p(f"{server}/law")) + row(p("2"), p("Заметки"), p("02"), p(f"{server}/moved")) + row(p("3"), p("Нет"), p("02"), p(f"{server}/gone")) + row(p("4"), p("Позже"), p("02"), p(f"{server}/flaky")) + "</w:tbl>"
    (tmp_path / "r.docx").write_bytes(docx(table, ""))
    root, log = str(tmp_path / "out"), str(tmp_path / "errors.csv")
    common = ["acquire", str(tmp_path / "r.docx"), root, "--retries", "2", "--retry-pause", "0", "--pause", "0", "--connect-timeout", "2", "--read-timeout", "2", "--error-log", log]
    Pages.asked.clear()
    command.main(common)
    assert "new: 3, there already: 0, errors: 1" in capsys.readouterr().out
    files = listed(root)
    assert len(files) == 4
    law, notes = (next(f for f in files if k in f) for k in ("Закон", "Заметки"))
    assert open(f"{root}/{law}", "rb").read().decode("utf-8-sig").startswith("Федеральный закон о проверке") and open(f"{root}/{notes}", "rb").read() == "﻿Заметки\n".encode()
    pdf = next(f for f in files if f.endswith(".pdf"))
    assert "1_вложения" in pdf and open(f"{root}/{pdf}", "rb").read() == b"%PDF-1.4 x"
    errors = sinks.read_error_log(spark, log).collect()
    assert [(r["num"], r["status"], r["registry"]) for r in errors] == [("3", "ERROR", "r.docx")] and "HTTPError" in errors[0]["error"] and errors[0]["error"].count("attempt") == 4
    assert Pages.asked.count("/law") == 1 and Pages.asked.count("/flaky") == 2 and Pages.asked.count("/files/a.pdf") == 1

    command.main([*common, "--only-nums", "1,2", "--no-error-log"])
    assert "new: 0, there already: 2, errors: 0" in capsys.readouterr().out and listed(root) == files
    command.main([*common, "--dry-run", "--limit", "2", "--start-index", "3", "--no-error-log"])
    assert "DRY_RUN: 2" in capsys.readouterr().out and listed(root) == files
