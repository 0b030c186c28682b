"""URL expressions. A URL is taken apart by one regular expression (RFC 3986, appendix B), which never fails."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import ALLOWED_HOSTS, BASE_URL, BINARY_SUFFIXES, DOCUMENT_SUFFIXES, FOLLOW_WORDS, GENERIC_PATHS, SECTION_ITEMS, SECTION_NAMES, YEARS
from .text import any_of, let, safe_name, text

PARTS = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
PUBLICATION = "publication.pravo.gov.ru"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, PARTS, 2))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 4)


def path(u: Column) -> Column:
    """The path without parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(u, PARTS, 5), r";[^/]*$", "")


def query(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 7)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 9)


def host(u: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(u), r"^.*@", ""), r":[0-9]*$", ""))


def normalized_host(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^www\.", "")


def is_allowed_host(u: Column, hosts: Iterable[str] = ALLOWED_HOSTS) -> Column:
    return host(u).isin(*hosts)


def force_scheme(u: Column, to: str) -> Column:
    return F.when(scheme(u).isin("http", "https"), F.concat(F.lit(to), F.regexp_replace(u, r"^[^:]+", ""))).otherwise(u)


def force_http(u: Column) -> Column:
    return F.regexp_replace(F.btrim(text(u), F.lit(" \t\r\n\f\x0b")), r"^https://", "http://")


def strip_fragment(u: Column) -> Column:
    return F.regexp_replace(u, r"(?s)#.*$", "")


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves plus signs alone; text that isn't well encoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def suffix_of(p: Column) -> Column:
    """.ext of the last segment, in lower case; none for leading or final dots."""
    return F.lower(F.regexp_extract(F.regexp_replace(p, r"/+$", ""), r"[^/](\.[^./]+)$", 1))


def suffix(u: Column) -> Column:
    return suffix_of(unquote(path(u)))


def is_binary(u: Column, suffixes: Iterable[str] = BINARY_SUFFIXES) -> Column:
    return suffix(u).isin(*suffixes)


def query_value(u: Column, key: str) -> Column:
    """First non-empty value of a query key, decoded; empty if there is none."""
    raw = F.regexp_extract(query(u), rf"(?:^|&){key}=([^&]+)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def is_ips(u: Column) -> Column:
    return normalized_host(u).endswith("pravo.gov.ru") & F.contains(F.lower(path(u)), F.lit("/proxy/ips"))


def pravo_nd(u: Column) -> Column:
    return F.when((normalized_host(u) == "pravo.gov.ru") & F.contains(F.lower(path(u)), F.lit("/proxy/ips")), query_value(u, "nd")).otherwise("")


def canonical_key(u: Column) -> Column:
    nd, q = pravo_nd(u), query(u)
    p = F.when(path(u) == "", "/").otherwise(path(u))
    return F.when(nd != "", F.concat(F.lit("pravo-nd:"), nd)).otherwise(F.concat(F.lit("http://"), normalized_host(u), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def eo_number(u: Column) -> Column:
    value = F.coalesce(F.nullif(query_value(u, "eoNumber"), F.lit("")), query_value(u, "eonumber"))
    found = F.when(value != "", safe_name(value, 40)).otherwise(F.regexp_extract(path(u), r"(?i)/(?:document|document/view)/([0-9]{10,})", 1))
    return F.when(normalized_host(u) == PUBLICATION, found).otherwise("")


def candidates(u: Column) -> Column:
    """The URLs to try, in order: publication forms by http and https, then the URL itself by http and https."""
    forms = F.array(*(F.lit(f"{s}://{PUBLICATION}/{p}") for s in ("http", "https") for p in ("file/pdf?eoNumber=", "document/", "Document/View/")))
    own = F.array(force_scheme(u, "http"), force_scheme(u, "https"))
    return let(eo_number(u), lambda eo: F.array_distinct(F.concat(F.when(eo != "", F.transform(forms, lambda f: F.concat(f, eo))).otherwise(F.array().cast("array<string>")), own)))


def doc_itself(u: Column) -> Column:
    """The document's own page instead of the viewer around it. Repeated keys move up to their first place."""
    pairs = F.filter(F.split(query(u), "&"), lambda x: x != "")
    key = lambda x: F.regexp_extract(x, r"^([^=]*)", 1)
    names = F.transform(pairs, lambda x: F.lower(key(x)))
    rest = F.filter(pairs, lambda x: ~F.lower(key(x)).isin("docbody", "doc-body", "firstdoc", "lastdoc"))
    grouped = F.flatten(F.transform(F.array_distinct(F.transform(rest, key)), lambda k: F.filter(rest, lambda x: key(x) == k)))

    def encoded(x: Column) -> Column:
        value = F.regexp_extract(x, r"^[^=]*=(.*)$", 1)
        plus = lambda v: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(v), v)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return F.concat(plus(key(x)), F.lit("="), plus(value))

    new = F.array_join(F.concat(F.array(F.lit("doc_itself=")), F.transform(grouped, encoded)), "&")
    rewritten = F.concat(F.regexp_extract(u, r"(?s)^([^?#]*)", 1), F.lit("?"), new, F.regexp_extract(u, r"(?s)(#.*)?$", 0))
    return F.when(is_ips(u) & ~F.array_contains(names, "doc_itself") & (F.array_contains(names, "docbody") | F.array_contains(names, "doc-body")), rewritten).otherwise(u)


def preferred_content(u: Column) -> Column:
    return let(eo_number(u), lambda eo: F.when(eo != "", F.concat(F.lit(f"http://{PUBLICATION}/file/pdf?eoNumber="), eo)).otherwise(doc_itself(u)))


def doc_id(u: Column) -> Column:
    """An id that the URL itself names, or empty."""
    named = F.coalesce(F.nullif(query_value(u, "eoNumber"), F.lit("")), query_value(u, "nd"))
    last = unquote(F.regexp_extract(F.regexp_replace(path(u), r"/+$", ""), r"([^/]*)$", 1))

    def choose(k: Column) -> Column:
        named, last = k["named"], k["last"]
        stem = F.when(last.rlike(r"^.+\.[^.]+$"), F.regexp_replace(last, r"\.[^.]+$", "")).otherwise(last)
        return F.when(named != "", safe_name(named, 60)).when(F.contains(last, F.lit(".")), safe_name(stem, 60)).when(last.rlike(r"^[0-9A-Za-z_-]{6,}$"), safe_name(last, 60)).otherwise("")

    return let(F.struct(named.alias("named"), last.alias("last")), choose)


def is_direct_document(u: Column, suffixes: Iterable[str] = DOCUMENT_SUFFIXES) -> Column:
    p, h = F.lower(path(u)), normalized_host(u)
    return (
        suffix_of(unquote(p)).isin(*suffixes) | F.contains(p, F.lit("/uploaded/files/")) | p.rlike(r"/(?:ru/)?documents/\d+/?$")
        | ((h == "vsrf.ru") & p.rlike(rf"/documents/(?:{'|'.join(SECTION_ITEMS)})/\d+/?$"))
        | ((h == PUBLICATION) & (p.rlike(r"/(?:document|document/view)/\d{10,}") | (p == "/file/pdf")))
    )


def is_section(p: Column) -> Column:
    return p.rlike(rf"^/documents/(?:{'|'.join(SECTION_NAMES)})/?$")


def is_generic(u: Column, table: Iterable[tuple[str, str]] = GENERIC_PATHS) -> Column:
    """A portal or a catalogue rather than one document."""
    h, p, q = normalized_host(u), F.regexp_replace(F.lower(path(u)), r"/+$", ""), F.trim(query(u))
    search = (h == "protect.gost.ru") & p.isin("/search", "/search.aspx") & query(u).rlike(r"(?i)(^|&)search=[^&]")
    place = F.concat(h, F.lit(" "), F.when(p == "", "/").otherwise(p))
    return search | ((h == PUBLICATION) & (p == "/search")) | ((h == "vsrf.ru") & is_section(p)) | ((q == "") & place.isin(*(f"{a} {b}" for a, b in table)))


def requires_link_target(u: Column, allowed: Column, allow_generic_pages: bool = False) -> Column:
    """Whether an item's own page doesn't do, because it is a portal that isn't wanted for itself."""
    return is_generic(u) & ~allowed & F.lit(not allow_generic_pages)


def is_followable(u: Column, title: Column, base: Column, words: Iterable[str] = FOLLOW_WORDS) -> Column:
    h, p = normalized_host(u), F.lower(path(u))
    nd = pravo_nd(u)
    section = (h == "vsrf.ru") & F.startswith(F.lower(path(base)), F.lit("/documents")) & (is_section(p) | ((p == "/documents/own") & (query(u) != "")))
    named = (nd != "") & (nd != pravo_nd(base))
    # A publication's PDF form is followed from a portal's page only; all other direct forms always.
    pdf_form = (h == PUBLICATION) & (p == "/file/pdf")
    direct = is_direct_document(u) & (~pdf_form | is_generic(base) | suffix_of(unquote(p)).isin(*DOCUMENT_SUFFIXES))
    wordy = (F.length(title) >= 40) & any_of(F.lower(title), words)
    return scheme(u).isin("http", "https") & (h == normalized_host(base)) & (named | direct | section | wordy)


def is_skipped_href(h: Column) -> Column:
    return (h == "") | h.rlike(r"^(#|mailto:|tel:|javascript:)")


def _dots(p: Column) -> Column:
    """Without . and .. segments."""
    segments = F.split(p, "/", -1)
    body = F.slice(segments, 1, F.size(segments) - 1)

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(s == "..", up).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    full = F.aggregate(F.concat(body, F.array(F.element_at(segments, -1))), F.array().cast("array<string>"), step)
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(full, F.array(F.lit("")))).otherwise(full)
    return F.array_join(closed, "/")


def join(base: Column, ref: Column) -> Column:
    """The reference resolved against the base (RFC 3986, section 5.2), natively."""
    root = F.concat(F.regexp_extract(base, PARTS, 1), F.regexp_extract(base, PARTS, 3))
    base_path = F.regexp_extract(base, PARTS, 5)
    base_path = F.when(base_path == "", "/").otherwise(base_path)
    p, tail = F.regexp_extract(ref, PARTS, 5), F.concat(F.regexp_extract(ref, PARTS, 6), F.regexp_extract(ref, PARTS, 8))
    merged = F.concat(F.regexp_extract(base_path, r"(?s)^(.*/)", 1), p)
    return (
        F.when(ref == "", base).when(F.regexp_extract(ref, PARTS, 1) != "", ref).when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, PARTS, 1), ref))
        .when(F.startswith(p, F.lit("/")), F.concat(root, _dots(p), tail))
        .when((p == "") & F.startswith(ref, F.lit("?")), F.concat(root, F.regexp_extract(base, PARTS, 5), tail))
        .when(p == "", F.concat(strip_fragment(base), tail)).otherwise(F.concat(root, _dots(merged), tail))
    )


def looks_like_sp(u: Column) -> Column:
    return F.lower(path(u)).rlike(r"/sp\d")


def looks_like_snip(u: Column) -> Column:
    p = F.lower(path(u))
    return F.contains(p, F.lit("/razdel-")) | p.rlike(r"/\d+-\d+-\d+")


def quote_plus(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def quote(c: Column) -> Column:
    return F.replace(F.replace(quote_plus(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def direct_sp_urls(numbers: Column, base: str = BASE_URL, years: Iterable[int] = YEARS) -> Column:
    return F.array_distinct(F.flatten(F.transform(numbers, lambda n: F.array(*(F.concat(F.lit(f"{base}/sp"), n, F.lit(f"-{y}")) for y in years)))))


def catalog_urls(base: str = BASE_URL, years: Iterable[int] = YEARS) -> list[str]:
    return [f"{base}/", f"{base}/sp", *(f"{base}/sp{y}" for y in years)]


def search_urls(q: Column, max_pages: int = 3, base: str = BASE_URL) -> Column:
    q = F.btrim(text(q), F.lit(" \t\r\n\f\x0b"))
    forms = []
    for page in range(max_pages):
        forms.append(F.concat(F.lit(f"{base}/search/node/"), quote(q), F.lit(f"?page={page}" if page else "")))
        forms += [F.concat(F.lit(f"{base}/{f}?do=search&subaction=search&story="), quote_plus(q), F.lit(f"&page={page}" if page else "")) for f in ("", "index.php")]
    return F.array_distinct(F.array(*forms))


def vsrf_ajax(u: Column) -> Column:
    """The URL that lists a section's documents as JSON, or empty. Blank values stay; init=y replaces an older value."""
    p = F.lower(F.regexp_replace(path(u), r"/+$", ""))
    kept = F.filter(F.split(query(u), "&"), lambda x: (x != "") & ~x.rlike(r"^init="))
    new = F.array_join(F.concat(kept, F.array(F.lit("init=y"))), "&")
    return F.when((normalized_host(u) == "vsrf.ru") & is_section(p), F.concat(F.regexp_extract(u, r"(?s)^([^?#]*)", 1), F.lit("?"), new)).otherwise("")
