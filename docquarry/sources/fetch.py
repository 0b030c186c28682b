"""Fetched responses as a table. The network is a source like any other: a fetcher is passed in, or the responses are
already there."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import link_text
from ..functions.url import candidates, host, join
from ..lexicons import ALLOWED_HOSTS
from ..operators.links import followable
from ..storage import stored
from .html_tree import anchored

RESPONSE = "url string, final_url string, http_status int, content_type string, content_disposition string, http_encoding string, body binary, error string"
Fetcher = Callable[[str], dict]


def fetch(urls: DataFrame, fetcher: Fetcher, url: str = "url") -> DataFrame:
    """A response for each URL by fetcher, which returns the columns of RESPONSE; what it raises becomes an error. If there
    is a column wait, so many seconds pass before a request."""

    def one(u: str, wait: float) -> dict:
        try:
            time.sleep(max(wait or 0, 0))
            return {"url": u, "error": None} | fetcher(u)
        except Exception as e:  # noqa: BLE001  a failed request is a row
            return {"url": u, "error": f"{type(e).__name__}: {e}"}

    names = [x.split()[0] for x in RESPONSE.split(", ")]
    waits = F.col("wait").cast("double") if "wait" in urls.columns else F.lit(0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(u, w) for u, w in zip(b[url], b["wait"], strict=True)], columns=names).astype(object).where(lambda d: d.notna(), None)

    return urls.select(url, waits.alias("wait")).mapInPandas(run, RESPONSE)


def http_fetcher(connect: float = 60, read: float = 90, most: int = 8, headers: dict[str, str] | None = None) -> Fetcher:
    """A fetcher by HTTP, which follows redirects itself: loops, more than `most` of them and statuses from 400 on are
    errors. The longer of the two times limits each wait."""

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a: object) -> None:
            return None

    def get(first: str) -> dict:
        opener, at, seen = urllib.request.build_opener(Stay), first, set()
        for _ in range(most + 1):
            if at in seen:
                raise ValueError(f"redirect loop: {at}")
            seen.add(at)
            try:
                answer = opener.open(urllib.request.Request(urllib.parse.quote(at, safe="%/:=&?~#+!$,;'@()*[]"), headers=headers or {}), timeout=max(connect, read))
            except urllib.error.HTTPError as e:
                if e.code not in (301, 302, 303, 307, 308) or not e.headers.get("Location"):
                    raise
                at = urllib.parse.urljoin(at, e.headers["Location"])
                continue
            with answer:
                kind = answer.headers.get("Content-Type")
                return {
                    "final_url": at, "http_status": answer.status, "content_type": kind, "content_disposition": answer.headers.get("Content-Disposition"), "http_encoding": answer.headers.get_content_charset(), "body": answer.read(),
                }
        raise ValueError(f"too many redirects: {first}")

    return get


def attempts(items: DataFrame, ask: Callable[[DataFrame], DataFrame], retries: int = 3, pause: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """items: item, url. Every request that is made: item, cand_ord, try_no, url, ok, error, wait.

    A URL's forms are tried in order, each up to `retries` times, until one goes well. A round asks what every open item
    needs next, each URL once however many items need it; settled items are left out of the next round, and the
    others move to their next try, after a pause, or to the next form. ask gets url, try_no and wait (seconds that the
    request has to hold back) and returns url, try_no, http_status and error; no row, an error or a status beyond
    399 is a failure. A round is a stored table; there are at most forms x retries of them.
    by: columns of items, not null, that an answer depends on besides its URL; a URL is then asked once for each of their
    values, ask gets and returns them too, and so does the result.
    """
    kept = [c for c in by if c != "item"]
    forms = stored(items.select("item", *kept, candidates(F.col("url")).alias("forms")), "forms")
    open_ = forms.select("item", *kept, "forms", F.lit(0).alias("cand_ord"), F.lit(1).alias("try_no"), F.lit(0.0).alias("wait")).where(F.size("forms") > 0)
    out = None
    while True:
        due = open_.withColumn("url", F.get("forms", F.col("cand_ord")))
        asked = due.groupBy("url", "try_no", *by).agg(F.max("wait").alias("wait"))
        got = ask(asked).select("url", "try_no", *by, "http_status", F.col("error").alias("_error"))
        ok = F.col("_error").isNull() & F.coalesce(F.col("http_status") < 400, F.lit(False))
        what = F.coalesce(F.col("_error"), F.concat(F.lit("HTTP "), F.col("http_status").cast("string")), F.lit("no answer"))
        error = F.when(~ok, F.format_string(f"%s attempt %d/{retries}: %s", "url", "try_no", what)).otherwise("")
        turn = stored(due.join(got, ["url", "try_no", *by], "left").select("item", *kept, "forms", "cand_ord", "try_no", "url", ok.alias("ok"), error.alias("error"), "wait"), "attempts")
        out = turn if out is None else out.unionByName(turn)
        again = F.col("try_no") < retries
        after = turn.where(~F.col("ok") & (again | (F.col("cand_ord") + 1 < F.size("forms"))))
        open_ = after.select(
            "item", *kept, "forms", F.when(again, F.col("cand_ord")).otherwise(F.col("cand_ord") + 1).alias("cand_ord"), F.when(again, F.col("try_no") + 1).otherwise(1).alias("try_no"), F.when(again, pause).otherwise(0.0).alias("wait"),
        )
        if open_.isEmpty():
            return out.drop("forms")


def redirect_chains(start: DataFrame, hops: DataFrame, most: int = 8) -> DataFrame:
    """start: url; hops, one for each URL: url, http_status, location, which may be relative to url. Follows redirects: url,
    final_url, n_hops, error (loop, too many redirects).

    Every redirect knows the URLs that follow it; in a round each doubles its way by that of the URL where it ends, so ways of
    most + 1 hops take a logarithm of that in rounds, each over a stored table. Loops are URLs that come twice on a way.
    """
    to = join(F.col("url"), F.col("location"))
    redirects = hops.where(F.col("http_status").isin(301, 302, 303, 307, 308) & (F.coalesce("location", F.lit("")) != ""))
    ways = stored(redirects.select(F.col("url").alias("at"), F.array(to).alias("way")), "ways")
    far = 1
    while far <= most:
        next_ = ways.select(F.col("at").alias("_last"), F.col("way").alias("_more"))
        longer = ways.join(next_, F.element_at("way", -1) == F.col("_last"), "left")
        ways = stored(longer.select("at", F.slice(F.concat("way", F.coalesce("_more", F.array().cast("array<string>"))), 1, most + 1).alias("way")), "ways")
        far *= 2
    found = start.select("url").join(ways.withColumnRenamed("at", "url"), "url", "left").select("url", F.concat(F.array("url"), F.coalesce("way", F.array().cast("array<string>"))).alias("way"))
    # The first place whose URL stands before it; a loop that would be seen after the last request isn't.
    again = F.get(F.filter(F.transform("way", lambda u, i: F.when(F.array_position(F.col("way"), u) <= i, i)), lambda x: x.isNotNull()), 0)
    hop = found.select("url", "way", again.alias("again"), (F.size("way") - 1).alias("n"))
    loop, over = F.coalesce(F.col("again") <= most, F.lit(False)), F.col("n") > most
    n = F.when(loop, F.col("again") - 1).otherwise(F.col("n"))
    return hop.select("url", F.get("way", n).alias("final_url"), n.alias("n_hops"), F.when(loop, "redirect loop").when(over, "too many redirects").alias("error"))


def is_allowed(url: Column, final_url: Column, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    """Whether the host is allowed before and after redirects."""
    return F.coalesce(host(url).isin(*hosts) & host(final_url).isin(*hosts), F.lit(False))


def ajax_fragments(answers: DataFrame) -> DataFrame:
    """answers: url, full (whether it is the second request), body (JSON). The HTML fragments of each URL: the full
    list if it is not shorter than the first one. Answers that can't be read give none."""
    parsed = answers.withColumn("_j", F.from_json(F.col("body").cast("string"), "pages struct<before: int>, list array<string>"))
    n = F.coalesce(F.size("_j.list"), F.lit(-1))
    best = parsed.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(n.desc(), F.col("full").desc()))).where("_n = 1")
    return best.select("url", F.posexplode("_j.list").alias("ord", "fragment"))


def ajax_links(answers: DataFrame) -> DataFrame:
    """answers of sections, url being the section's page: the documents that their lists lead to, in the lists' order, as
    links.plan() takes them: page_id and base (the section), ord, url, title, link_key."""
    fragments = ajax_fragments(answers).select(F.struct("url", "ord").alias("page_id"), "url", F.col("fragment").alias("html"))
    rows = anchored(fragments).select(
        F.col("base").alias("page_id"), "base", F.struct(F.col("page_id.ord").alias("part"), F.col("ord").alias("anchor")).alias("ord"), "url", link_text(F.col("title")).alias("title"),
    )
    return followable(rows)
