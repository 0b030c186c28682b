"""Requests in rounds, and ways of redirects, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry.operators.crawl import fetch_fallback
from docquarry.sources import fetch


def loop(url, forms, script, retries, keep=6):
    """One item, one request after another."""
    errors, made = [], 0
    for form in forms:
        for n in range(1, retries + 1):
            made += 1
            status, error = script.get((form, n), (None, "no answer"))
            if error is None and status is not None and status < 400:
                return form, " | ".join(errors[-keep:]), "OK", made
            errors.append(f"{form} attempt {n}/{retries}: {error or f'HTTP {status}'}")
    return None, " | ".join(errors[-keep:]), "ERROR", made


def test_rounds_equal_a_loop_over_items(spark):
    r = random.Random(6)
    urls = [f"http://h{k % 7}.org/p{k % 23}" for k in range(60)]  # many items share a URL
    items = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(99, "")], "item long, url string")
    forms = {u: [u, "https" + u[4:]] for u in urls}
    script = {(f, n): r.choice([(200, None), (404, None), (500, None), (None, "Timeout: x")]) for u in forms for f in forms[u] for n in (1, 2, 3) if r.random() < 0.9}
    answers = spark.createDataFrame([(*k, *v) for k, v in script.items()], "url string, try_no int, http_status int, error string")
    asked, rounds = Counter(), []

    def ask(due):
        rows = due.collect()
        asked.update((x["url"], x["try_no"]) for x in rows)
        rounds.append(len(rows))
        assert all(x["wait"] == (1.5 if x["try_no"] > 1 else 0) for x in rows)
        return due.join(answers, ["url", "try_no"])

    made = fetch.attempts(items.where("url <> ''"), ask, retries=3, pause=1.5)
    n = {x["item"]: x["n"] for x in made.groupBy("item").agg(F.count("*").alias("n")).collect()}
    got = {x["item"]: (x["url"], x["errors"], x["status"], n[x["item"]]) for x in fetch_fallback(made).collect()}
    assert got == {k: loop(u, forms[u], script, 3) for k, u in enumerate(urls)}
    assert max(asked.values()) == 1 and len(rounds) <= 6 and rounds == sorted(rounds, reverse=True)


def test_items_that_share_a_url_get_answers_of_their_own(spark, tmp_path):
    """Pages of one URL, whose script follows from their own html; and a URL asked once for each user."""
    import duckdb

    from docquarry.plans.oracles import ORACLES
    from docquarry.plans.queries import QUERIES

    spark.createDataFrame([(k, "http://a.org/x", "h" * k) for k in range(1, 8)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["item", "url", "errors", "status", "requests", "waited"]
    want = con.execute(f"select {', '.join(names)} from ({ORACLES['fetch_fallback']}) order by item").fetchall()
    assert [tuple(x) for x in QUERIES["fetch_fallback"](spark, str(tmp_path)).select(names).orderBy("item").collect()] == want
    items = spark.createDataFrame([(1, "http://b.org/", "u"), (2, "http://b.org/", "u"), (3, "http://b.org/", "v")], "item long, url string, user string")
    made = fetch.attempts(items, lambda due: due.select("url", "try_no", "user", F.when(F.col("user") == "v", 403).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("error")), 1, by=("user",))
    assert sorted((x["item"], x["user"], x["ok"]) for x in made.collect()) == [(1, "u", True), (2, "u", True), (3, "v", False), (3, "v", False)]


def test_links_of_odd_pages(spark, tmp_path):
    """Ids with gaps, which links may lead into, and a page that leaves a script open."""
    import duckdb

    from docquarry.plans.oracles import ORACLES
    from docquarry.plans.queries import QUERIES

    a = '<p><a href="/x">{}</a></p>'
    html = [a.format("one") + a.format("two three") * 2 + ("<script>" if k % 5 == 1 else "") for k in range(12)]
    spark.createDataFrame([(k if k < 8 else k + 93, "http://a.org/x", h) for k, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    names = ["path", "depth", "num", "original_url", "file_type", "status", "linked_saved", "linked_errors", "error"]
    want = con.execute(f"select {', '.join(names)} from ({ORACLES['linked_saved']}) order by path").fetchall()
    assert len(want) > 12 and [tuple(x) for x in QUERIES["linked_saved"](spark, str(tmp_path)).select(names).orderBy("path").collect()] == want


def test_no_items_make_no_requests(spark):
    none = spark.createDataFrame([], "item long, url string")
    assert fetch.attempts(none, lambda due: due.withColumns({"http_status": F.lit(200), "error": F.lit(None).cast("string")})).count() == 0


def test_a_fetcher_drives_the_rounds(spark):
    """fetch() answers: what a fetcher raises is tried again, then the other form is."""

    def get(u):
        if u.startswith("http:"):
            raise TimeoutError("slow")
        return {"final_url": u, "http_status": 200}

    def ask(due):
        return due.select("url", "try_no").join(fetch.fetch(due.withColumn("wait", F.col("wait") * 0), get), "url")

    items = spark.createDataFrame([(1, "http://a.org/x"), (2, "https://a.org/y")], "item long, url string")
    got = {x["item"]: (x["url"], x["status"], x["errors"].count("TimeoutError: slow")) for x in fetch_fallback(fetch.attempts(items, ask, retries=2, pause=0.0)).collect()}
    assert got == {1: ("https://a.org/x", "OK", 2), 2: ("https://a.org/y", "OK", 2)}


def follow(url, to, most):
    """One URL: a request for each hop, loops seen before the next request."""
    at, seen = url, []
    for n in range(most + 1):
        if at in seen:
            return seen[-1], n - 1, "redirect loop"
        seen.append(at)
        if at not in to:
            return at, n, None
        at = to[at]
    return at, most + 1, "too many redirects"


@pytest.mark.parametrize("most", [1, 3, 8])
def test_ways_equal_a_loop_over_hops(spark, most):
    r = random.Random(most)
    to = {f"http://h.org/{k}": f"http://h.org/{r.choice([k + 1, k + 1, k + 1, k + 1, r.randrange(150)])}" for k in range(150) if k % 17}
    rows = [(u, 301, v if r.random() < 0.5 else v.removeprefix("http://h.org")) for u, v in to.items()] + [("http://h.org/500", 200, "/1"), ("http://h.org/501", 302, None), ("http://h.org/502", 301, "")]
    hops = spark.createDataFrame(rows, "url string, http_status int, location string")
    start = spark.createDataFrame([(u,) for u in [*to, "http://h.org/0", "http://h.org/500", "http://h.org/501", "http://h.org/502", "http://x.org/"]] + [(None,)], "url string")
    got = {x["url"]: (x["final_url"], x["n_hops"], x["error"]) for x in fetch.redirect_chains(start, hops, most).collect()}
    assert got.pop(None) == (None, 0, None)
    assert got == {u: follow(u, to, most) for u in got} and len(got) == start.count() - 1


def test_hosts_are_checked_before_and_after(spark):
    rows = [("http://sniprf.ru/a", "http://www.sniprf.ru/b"), ("http://sniprf.ru/a", "http://evil.org/"), ("http://evil.org/", "http://sniprf.ru/"), ("http://sniprf.ru/", None)]
    got = spark.createDataFrame(rows, "u string, f string").select(fetch.is_allowed(F.col("u"), F.col("f")).alias("a")).collect()
    assert [x["a"] for x in got] == [True, False, False, False]


def test_lists_of_sections_lead_to_documents(spark):
    """The whole list counts if it isn't shorter; fragments' links in order, each key once, other hosts left out."""
    import json

    base = "http://vsrf.ru/documents/own"
    part = json.dumps({"pages": {"before": 2}, "list": ['<a href="/documents/own/9">Девять</a>']})
    whole = json.dumps({"list": ['<div><a href="/documents/own/2">Второй</a><a href="#x">нет</a></div>', '<a href="http://www.vsrf.ru/documents/own/2">снова</a><a href="http://a.org/1.pdf">чужой</a><a href="/documents/own/3"></a>', "<a name=x>"]})
    rows = [(base, False, part), (base, True, whole), ("http://vsrf.ru/documents/reviews", False, "no json"), ("http://vsrf.ru/documents/reviews/", False, json.dumps({"list": []}))]
    got = fetch.ajax_links(spark.createDataFrame(rows, "url string, full boolean, body string")).orderBy("ord").collect()
    assert [(r["page_id"], r["url"], r["title"]) for r in got] == [(base, "http://vsrf.ru/documents/own/2", "Второй"), (base, "http://vsrf.ru/documents/own/3", "linked_document")]
