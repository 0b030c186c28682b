"""SQL (DuckDB) for the queries that SQL can express, written on its own terms."""

from __future__ import annotations

from ..lexicons import (
    ALLOWED_GENERIC, ALLOWED_HOSTS, BAD_TITLES, BAD_URL_PARTS, BASE_URL, BINARY_SUFFIXES, BOILERPLATE_LINES, DOCUMENT_SUFFIXES, GENERIC_PATHS, KEPT_WORDS, LEGAL_MARKERS,
    MOJIBAKE, SECTION_ITEMS, SECTION_NAMES, START_WORDS, STOP_WORDS, SYNONYMS, YEARS,
)
from . import cases, site
from .cases import values

MARKERS, BOILERPLATE, STARTS = ("the", "tion", "des", "ung"), ("is.", "of.", "it.", "that it."), ("the", "that", "les", "der")
WORDS, MARKS = ("thing", "ing", "oner", "tion", "eau", "ung"), ("the", "en", "er")


def _in(xs) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs)


def _list(xs) -> str:
    return f"[{_in(xs)}]"


SPLIT = r"'\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
WS = r"'[\s\p{Z}]+'"
norm = lambda x: f"trim(regexp_replace({x}, {WS}, ' ', 'g'))"
counts = lambda x, xs: " + ".join(f"(length({x}) - length(replace({x}, '{w}', ''))) // {len(w)}" for w in xs)
anyof = lambda x, xs: f"len(list_filter({_list(xs)}, lambda w: contains({x}, w))) > 0"
safe = lambda x, n: f"coalesce(nullif(trim(left(trim(translate({norm(x)}, '<>:\"/\\|?*', '_________'), ' ._'), {n}), ' ._'), ''), 'document')"
LINES = f"SELECT doc_id, unnest(string_split_regex(text, {SPLIT})) AS line, generate_subscripts(string_split_regex(text, {SPLIT}), 1) - 1 AS pos FROM documents"
ANCHOR = r"(?is)<a\b[^>]*href=[''\"]([^''\"]+)[''\"][^>]*>(.*?)</a>"
LINKS = f"""a AS (SELECT page_id, url AS base, regexp_extract_all(html, '{ANCHOR}') AS m FROM pages),
    b AS (SELECT page_id, base, unnest(m) AS x, generate_subscripts(m, 1) - 1 AS ord FROM a),
    links AS (SELECT page_id, base, ord, trim(regexp_extract(x, '{ANCHOR}', 1)) AS href, trim(left({norm("regexp_replace(regexp_extract(x, '" + ANCHOR + "', 2), '(?s)<[^>]+>', ' ', 'g')")}, 220)) AS title FROM b),
    found AS (SELECT *, regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || href AS url FROM links WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)'))"""

URLS = f"u AS (SELECT url FROM pages UNION ALL ({values(cases.URLS, 'url')}))"
# Parts of a URL, as one CTE.
PARTS = f"""{URLS}, p AS (SELECT url, lower(regexp_extract(url, '^([^:/?#]+):', 1)) AS scheme, regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1) AS net,
    regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM u),
    h AS (SELECT *, lower(regexp_replace(regexp_replace(net, '^.*@', ''), ':[0-9]*$', '')) AS host FROM p),
    n AS (SELECT *, regexp_replace(host, '^www\\.', '') AS nhost, lower(path) AS low, lower(regexp_extract(rtrim(path, '/'), '[^/](\\.[^./]+)$', 1)) AS suffix FROM h)"""
ND = "CASE WHEN nhost = 'pravo.gov.ru' AND contains(low, '/proxy/ips') THEN regexp_extract(q, '(?:^|&)nd=([^&]+)', 1) ELSE '' END"
EO = f"""CASE WHEN nhost <> 'publication.pravo.gov.ru' THEN '' WHEN regexp_matches(q, '(?:^|&)eo[Nn]umber=[^&]') THEN {safe("regexp_extract(q, '(?:^|&)eo[Nn]umber=([^&]+)', 1)", 40)}
    ELSE regexp_extract(path, '(?i)/(?:document|document/view)/([0-9]{{10,}})', 1) END"""
_swap = lambda s: f"CASE WHEN scheme IN ('http', 'https') THEN '{s}' || regexp_replace(url, '^[^:]+', '') ELSE url END"
DIRECT = f"""suffix IN ({_in(DOCUMENT_SUFFIXES)}) OR contains(low, '/uploaded/files/') OR regexp_matches(low, '/(?:ru/)?documents/[0-9]+/?$')
    OR (nhost = 'vsrf.ru' AND regexp_matches(low, '/documents/(?:{"|".join(SECTION_ITEMS)})/[0-9]+/?$'))
    OR (nhost = 'publication.pravo.gov.ru' AND (regexp_matches(low, '/(?:document|document/view)/[0-9]{{10,}}') OR low = '/file/pdf'))"""
GENERIC = f"""(nhost = 'protect.gost.ru' AND rtrim(low, '/') IN ('/search', '/search.aspx') AND regexp_matches(q, '(?i)(^|&)search=[^&]'))
    OR (nhost = 'publication.pravo.gov.ru' AND rtrim(low, '/') = '/search') OR (nhost = 'vsrf.ru' AND regexp_matches(rtrim(low, '/'), '^/documents/(?:{"|".join(SECTION_NAMES)})/?$'))
    OR (trim(q) = '' AND nhost || ' ' || coalesce(nullif(rtrim(low, '/'), ''), '/') IN ({_in(f"{a} {b}" for a, b in GENERIC_PATHS)}))"""

BOILER_RE = r"^открыть панель([^\p{L}\p{N}_]|$)|^поделиться([^\p{L}\p{N}_]|$)|^версия для слабовидящих([^\p{L}\p{N}_]|$)|^version for visually impaired([^\p{L}\p{N}_]|$)|^личный кабинет([^\p{L}\p{N}_]|$)|^выполняется запрос([^\p{L}\p{N}_]|$)|^помним и гордимся победой!?$|^[0-9]{1,2}\s*:\s*[0-9]{1,2}(\s*:\s*[0-9]{1,2})?$|^99\s*:\s*99"


def _boiler(line: str, exact) -> str:
    low = f"trim(lower({line}), ' .:;|')"
    return f"({low} = '' OR {low} IN ({_in(exact)}) OR (length({low}) <= 2 AND NOT regexp_matches({low}, '^\\p{{Nd}}+$')) OR (length({low}) <= 35 AND regexp_matches({low}, '{BOILER_RE}')))"


def _short_cap(source: str, key: str, markers) -> str:
    return f"""f AS (SELECT *, length(line) < 35 AND NOT ({anyof("lower(line)", markers)}) AND NOT regexp_matches(line, '\\p{{Nd}}') AS short FROM {source}),
    g AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY pos) AS run FROM f),
    k AS (SELECT *, sum(CASE WHEN short THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, run ORDER BY pos) AS place FROM g),
    capped AS (SELECT {key}, pos, line FROM k WHERE NOT short OR place <= 3)"""


def _trim(text: str, starts, markers) -> str:
    rows = f"list_filter(string_split_regex({text}, {SPLIT}), lambda x: trim(regexp_replace(x, {WS}, ' ', 'g')) <> '')"
    opens = f"list_position(list_transform({rows}[1:80], lambda x: regexp_matches(lower(x), '^({'|'.join(starts)})([^\\p{{L}}\\p{{N}}_]|$)')), true)"
    legal = f"list_position(list_transform({rows}[1:80], lambda x: length(x) > 45 AND len(list_filter({_list(markers)}, lambda w: contains(lower(x), w))) > 0), true)"
    return f"CASE WHEN len({rows}) = 0 THEN '' ELSE trim(array_to_string({rows}[coalesce(nullif({opens}, 0), nullif({legal}, 0), 1):], chr(10)), ' ' || chr(10) || chr(9) || chr(13)) || chr(10) END"


STRIP = r"regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>|<noscript.*?>.*?</noscript>|<svg.*?>.*?</svg>', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g')"
SCORED = f"""{LINKS}, c AS (SELECT page_id AS page_ord, ord AS anchor_ord, CASE page_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'catalog' ELSE 'site_search' END AS mode,
        regexp_replace(regexp_replace(url, '^https://', 'http://'), '#.*$', '') AS url, title FROM found),
    d AS (SELECT *, lower(regexp_replace(url, '^https://', 'http://')) AS low, lower(title) || '  ' || lower(regexp_replace(url, '^https://', 'http://')) AS blob FROM c),
    s AS (SELECT *, len(list_filter({_list(WORDS)}, lambda w: contains(blob, w))) AS m, len(list_filter({_list(MARKS)}, lambda w: contains(blob, w))) AS k,
        lower(regexp_extract(rtrim(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), '[^/](\\.[^./]+)$', 1)) AS suffix FROM d),
    t AS (SELECT *, CAST(14 * m + 10 * k + CASE WHEN regexp_matches(blob, '(^|[^\\p{{L}}\\p{{N}}_])сп\\s*[0-9]|/sp[0-9]') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(blob, '(^|[^\\p{{L}}\\p{{N}}_])(гост|gost)([^\\p{{L}}\\p{{N}}_]|$)') THEN 25 ELSE 0 END
        + CASE WHEN contains(blob, 'свод правил') THEN 20 ELSE 0 END + CASE WHEN suffix IN ('.pdf', '.doc', '.docx', '.rtf') THEN 18 WHEN suffix = '.html' THEN 10 WHEN regexp_matches(low, '/sp[0-9]|/gost|/document|/docs?') THEN 16 ELSE 0 END
        + CASE WHEN length(title) >= 20 THEN 8 ELSE 0 END - CASE WHEN contains(low, 'search') THEN 35 ELSE 0 END - CASE WHEN {anyof("blob", ("контакты", "главная", "карта сайта"))} THEN 25 ELSE 0 END
        - CASE WHEN m = 0 AND k = 0 THEN 30 ELSE 0 END AS INTEGER) AS points FROM s)"""
SNIP = "(contains(title_low, 'снип') OR contains(title_low, 'snip') OR contains(url_low, 'снип') OR contains(url_low, 'snip') OR contains(path_low, '/razdel-') OR regexp_matches(path_low, '/[0-9]+-[0-9]+-[0-9]+'))"
FOUND = f"""{SCORED}, b1 AS (SELECT *, lower(title) AS title_low, low AS url_low, regexp_extract(low, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) AS path_low FROM t),
    ok AS (SELECT *, list_position(['direct', 'catalog', 'site_search'], mode) AS mode_ord FROM b1 WHERE points >= 5 AND NOT (length(title_low) < 3 OR {anyof("url_low", BAD_URL_PARTS)} OR title_low IN ({_in(BAD_TITLES)})
        OR (NOT (regexp_matches(path_low, '/sp[0-9]') OR regexp_matches(title_low, '(^|[^\\p{{L}}\\p{{N}}_])сп\\s*[0-9]')) AND {SNIP}))),
    kept AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY url ORDER BY mode_ord, page_ord, anchor_ord) = 1)"""
_page = lambda off: f"WITH {FOUND} SELECT page_ord, anchor_ord, url, least(100, greatest(0, points)) AS points FROM kept ORDER BY least(100, greatest(0, points)) DESC, mode_ord, page_ord, anchor_ord LIMIT 10 OFFSET {off}"
RESULTS = "r AS (SELECT o_orderkey AS ord, CAST(o_custkey % 50 AS VARCHAR) AS num, CASE WHEN o_orderstatus = 'O' THEN 'OK_PDF' WHEN o_orderstatus = 'F' THEN 'SKIPPED_EXISTS' WHEN o_totalprice < 100000 THEN 'DRY_RUN' ELSE 'ERROR' END AS status FROM orders)"
QWORDS = f"""q AS ({values(cases.QUERIES, 'query')}),
    w AS (SELECT query, list_filter(list_transform(string_split({norm("regexp_replace(replace(lower(query), 'ё', 'е'), '[^а-яa-z0-9.\\s\\p{Z}-]+', ' ', 'g')")}, ' '), lambda x: trim(x, ' .,-_')),
        lambda x: x IN ({_in(KEPT_WORDS)}) OR (length(x) >= 3 AND x NOT IN ({_in(STOP_WORDS)}))) AS ws FROM q),
    e AS (SELECT query, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)"""
_first = lambda src: f"SELECT q.query, coalesce(string_agg(word, ' ' ORDER BY i), '') AS words FROM q LEFT JOIN (SELECT query, word, min(i) AS i FROM {src} GROUP BY ALL) USING (query) GROUP BY q.query"
SYN = values(tuple((k, j, s) for k, v in SYNONYMS.items() for j, s in enumerate(v, 1)), "word, j, syn")
SP = f"""q AS ({values(cases.QUERIES, 'query')}), x AS (SELECT query, list_concat(list_transform(regexp_extract_all(replace(lower(query), ',', '.'), '(?:^|[^\\p{{L}}\\p{{N}}_])сп\\s*([0-9]+(?:\\.[0-9]+)*)', 1), lambda v: replace(v, '.', '-')),
        list_transform(regexp_extract_all(replace(lower(query), ',', '.'), '(?:^|[^\\p{{L}}\\p{{N}}_])sp\\s*([0-9]+(?:\\.[0-9]+)*)', 1), lambda v: replace(v, '.', '-'))) AS ns FROM q),
    e AS (SELECT query, unnest(ns) AS word, generate_subscripts(ns, 1) AS i FROM x), f AS (SELECT query, word, min(i) AS i FROM e GROUP BY ALL)"""
NAME_EXPR = f"coalesce({safe('CAST(p_size AS VARCHAR)', 20)}, '') || '_' || {safe('p_name', 110)} || '_' || CAST(1000 AS VARCHAR) || CAST(p_partkey AS VARCHAR)"

ORACLES: dict[str, str] = {
    "clean_pages": f"""WITH s AS (SELECT page_id, string_split_regex({STRIP}, {SPLIT}) AS ls FROM pages), e AS (SELECT page_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM s),
        c AS (SELECT page_id, pos, {norm("raw")} AS line FROM e), d AS (SELECT * FROM c WHERE NOT {_boiler("line", BOILERPLATE_LINES)}),
        l AS (SELECT *, lag(line) OVER (PARTITION BY page_id ORDER BY pos) AS prev FROM d), m AS (SELECT page_id, pos, line FROM l WHERE prev IS NULL OR prev <> line),
        {_short_cap("m", "page_id", LEGAL_MARKERS)}, j AS (SELECT page_id, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS t FROM capped GROUP BY page_id),
        z AS (SELECT p.page_id, coalesce(j.t, '') AS t FROM pages p LEFT JOIN j USING (page_id))
        SELECT page_id, {_trim("t", START_WORDS, LEGAL_MARKERS)} AS text FROM z""",
    "html_strip": f"SELECT page_id, {STRIP} AS text FROM pages",
    "line_split": f"WITH l AS ({LINES}) SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM l GROUP BY doc_id",
    "norm_space": f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents",
    "boilerplate_drop": f"WITH l AS ({LINES}), c AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {norm('line')} AS line FROM l) SELECT * FROM c WHERE NOT {_boiler('line', BOILERPLATE)}",
    "consecutive_dedupe": f"WITH l AS ({LINES}), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l) SELECT doc_id, count(*) AS n_lines FROM p WHERE prev IS NULL OR prev <> line GROUP BY doc_id",
    "short_run_cap": f"WITH l AS ({LINES}), {_short_cap('l', 'doc_id', MARKERS)} SELECT doc_id, count(*) AS n_lines, CAST(sum(pos) AS BIGINT) AS pos_sum FROM capped GROUP BY doc_id",
    "normalize_documents": f"""WITH l AS ({LINES}), c AS (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS line FROM l),
        j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS t FROM c WHERE line <> '' GROUP BY doc_id) SELECT doc_id, coalesce(t, '') AS text FROM documents LEFT JOIN j USING (doc_id)""",
    "trim_start": f"SELECT doc_id, {_trim('text', STARTS, MARKERS)} AS text FROM documents",
    "text_score": f"""WITH b AS (SELECT doc_id, text, lower(text) AS low, list_filter(string_split_regex(text, {SPLIT}), lambda x: trim(regexp_replace(x, {WS}, ' ', 'g')) <> '') AS ls FROM documents),
        f AS (SELECT doc_id, length(text) AS n, {counts("low", MARKERS)} AS legal, CAST(len(regexp_extract_all(text, '(?im)^\\s*(?:[0-9]+[.)]|[а-я]\\))\\s+\\S+')) AS BIGINT) AS numbered, CAST(len(regexp_extract_all(text, '(?im)^\\s*статья\\s+[0-9]+')) AS BIGINT) AS articles,
        CAST(len(list_filter(ls, lambda x: length(x) > 80)) AS BIGINT) AS long_lines, CAST(len(list_filter(ls, lambda x: length(x) < 35)) AS BIGINT) AS short_lines, {counts("low", BOILERPLATE_LINES)} AS menu FROM b)
        SELECT doc_id, legal, numbered, articles, long_lines, short_lines, menu, CAST(n + legal * 1200 + numbered * 220 + articles * 700 + long_lines * 70 - short_lines * 35 AS DOUBLE) - menu * 450 AS score FROM f""",
    "mojibake_flag": f"""WITH f AS (SELECT doc_id, {counts("text", ("�", "пїЅ"))} AS replacements, len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]')) AS controls,
        len(regexp_extract_all(text, '{MOJIBAKE}')) AS tokens, len(regexp_extract_all(text, '[\\x{{400}}-\\x{{4FF}}]')) AS cyrillic FROM documents)
        SELECT *, replacements > 5 OR controls > 3 OR (tokens > 20 AND cyrillic < 2 * tokens) AS mojibake FROM f""",
    "shell_flag": """SELECT doc_id, len(list_filter(['the', 'ing', 'des'], lambda m: contains(text, m))) >= 2 AND NOT (regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(Статья\\s+\\d+|Глава\\s+[IVXLC0-9]+)([^\\p{L}\\p{N}_]|$)')
        OR len(regexp_extract_all(text, '(?m)^\\s*\\d+[.)]\\s+\\S+')) >= 5) AS shell FROM documents""",
    "wrapped_word_repair": f"""WITH RECURSIVE l AS ({LINES}), c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, line FROM (SELECT doc_id, pos, regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS line FROM l) WHERE line <> ''),
        r AS (SELECT doc_id, i, line AS last, '' AS done FROM c WHERE i = 1 UNION ALL
            SELECT c.doc_id, c.i, CASE WHEN j THEN last || c.line ELSE c.line END, CASE WHEN j THEN done ELSE done || last || chr(10) END
            FROM (SELECT r.*, c.line AS nxt, regexp_matches(last, '[A-Za-z\\x{{400}}-\\x{{4FF}}]$') AND regexp_matches(c.line, '^[A-Za-z\\x{{400}}-\\x{{4FF}}]') AND length(regexp_extract(last, '([^ ]*)$', 1)) <= 4 AS j FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1) x JOIN c ON c.doc_id = x.doc_id AND c.i = x.i + 1),
        z AS (SELECT doc_id, done || last AS t FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) SELECT doc_id, coalesce(t, '') AS text FROM documents LEFT JOIN z USING (doc_id)""",
    "url_canonical": f"""WITH {PARTS} SELECT url, CASE WHEN {ND} <> '' THEN 'pravo-nd:' || {ND} ELSE 'http://' || nhost || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key, nhost AS host, scheme,
        regexp_replace(url, '#.*$', '') AS bare, regexp_replace(trim(url), '^https://', 'http://') AS by_http, {_swap("https")} AS by_https FROM n""",
    "url_candidates": f"""WITH {PARTS}, e AS (SELECT url, {EO} AS eo, {_swap("http")} AS a, {_swap("https")} AS b FROM n),
        c AS (SELECT url, CASE WHEN eo <> '' THEN ['http://publication.pravo.gov.ru/file/pdf?eoNumber=' || eo, 'http://publication.pravo.gov.ru/document/' || eo, 'http://publication.pravo.gov.ru/Document/View/' || eo,
            'https://publication.pravo.gov.ru/file/pdf?eoNumber=' || eo, 'https://publication.pravo.gov.ru/document/' || eo, 'https://publication.pravo.gov.ru/Document/View/' || eo, a, b] ELSE [a, b] END AS cs, row_number() OVER () AS rn FROM e),
        x AS (SELECT rn, url, unnest(cs) AS candidate, generate_subscripts(cs, 1) AS i FROM c), f AS (SELECT rn, url, candidate, min(i) AS i FROM x GROUP BY ALL)
        SELECT url, CAST(row_number() OVER (PARTITION BY rn ORDER BY i) - 1 AS INTEGER) AS ord, candidate FROM f""",
    "url_doc_id": f"""WITH {PARTS}, e AS (SELECT *, coalesce(nullif(regexp_extract(q, '(?:^|&)eoNumber=([^&]+)', 1), ''), regexp_extract(q, '(?:^|&)nd=([^&]+)', 1)) AS named, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS last FROM n)
        SELECT url, CASE WHEN named <> '' THEN {safe("named", 60)} WHEN contains(last, '.') THEN {safe("CASE WHEN regexp_matches(last, '^.+\\.[^.]+$') THEN regexp_replace(last, '\\.[^.]+$', '') ELSE last END", 60)}
        WHEN regexp_matches(last, '^[0-9A-Za-z_-]{{6,}}$') THEN {safe("last", 60)} ELSE '' END AS doc, {EO} AS eo FROM e""",
    "url_suffix": f"WITH {PARTS} SELECT url, suffix, suffix IN ({_in(BINARY_SUFFIXES)}) AS is_binary, regexp_matches(low, '/sp[0-9]') AS sp, contains(low, '/razdel-') OR regexp_matches(low, '/[0-9]+-[0-9]+-[0-9]+') AS snip, host IN ({_in(ALLOWED_HOSTS)}) AS allowed FROM n",
    "url_generic": f"WITH {PARTS} SELECT url, {GENERIC} AS generic FROM n",
    "url_direct_doc": f"WITH {PARTS} SELECT url, {DIRECT} AS direct FROM n",
    "catalog_urls": f"SELECT 0 AS ord, '{BASE_URL}/' AS url UNION ALL SELECT 1, '{BASE_URL}/sp' UNION ALL SELECT CAST({YEARS[0]} - y + 2 AS INTEGER), '{BASE_URL}/sp' || y FROM range({YEARS[-1]}, {YEARS[0] + 1}) AS t(y)",
    "direct_sp_urls": f"""WITH {SP}, y AS (SELECT query, '{BASE_URL}/sp' || word || '-' || y AS url, i, {YEARS[0]} - y AS k FROM f, range({YEARS[-1]}, {YEARS[0] + 1}) AS t(y))
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY i, k) - 1 AS INTEGER) AS ord, url FROM y""",
    "safe_names": f"WITH r AS (SELECT DISTINCT p_name AS name FROM part UNION ALL ({values(cases.NAMES, 'name')})) SELECT name, {safe('name', 40)} AS safe FROM r",
    "sub_paths": f"""WITH r AS ({values(cases.FOLDERS, 'folder, title')}) SELECT folder, array_to_string(list_transform(list_filter(string_split_regex(trim(trim(folder), '\\/'), '[\\\\/]+'), lambda p: trim(p) <> ''), lambda p: {safe("p", 80)}), '/') AS path,
        {anyof("lower(folder || ' ' || title)", ALLOWED_GENERIC)} AS allowed FROM r""",
    "file_names": f"WITH b AS (SELECT p_partkey, {NAME_EXPR} AS base FROM part) SELECT p_partkey, {safe('base', 140)} || '.pdf' AS name FROM b",
    "fit_paths": f"""WITH b AS (SELECT p_partkey, repeat(p_name, p_size % 9 + 1) AS stem, 80 - length('/data/archive') - 1 - 4 AS allowed FROM part),
        c AS (SELECT *, least(36, greatest(10, allowed // 3)) AS tail FROM b), d AS (SELECT *, greatest(10, allowed - tail - 1) AS head FROM c),
        e AS (SELECT *, CASE WHEN length(stem) <= allowed THEN {safe("stem", "allowed")} ELSE {safe("left(stem, head)", "head")} || '_' || {safe("right(stem, tail)", "tail")} END AS new FROM d)
        SELECT p_partkey, CASE WHEN length('/data/archive/' || stem || '.pdf') <= 80 THEN '/data/archive/' || stem || '.pdf' ELSE '/data/archive/' || {safe("new", "allowed")} || '.pdf' END AS path FROM e""",
    "header_charset": f"WITH r AS ({values(('text/html; charset=utf-8', 'text/html; Charset = ' + chr(39) + 'windows-1251' + chr(39), 'text/html', ''), 'header')}) SELECT header, regexp_extract(header, '(?i)charset\\s*=\\s*[''\"]?([^;''\"\\s]+)', 1) AS charset FROM r",
    "page_links": f"WITH {LINKS} SELECT page_id, CAST(ord AS INTEGER) AS ord, href, title, url FROM found",
    "links_dedup": f"WITH {LINKS}, k AS (SELECT page_id, ord, 'http://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') || regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS link_key FROM found) SELECT page_id, CAST(min(ord) AS INTEGER) AS ord, link_key FROM k GROUP BY page_id, link_key",
    "links_top_n": f"WITH {LINKS} SELECT page_id, CAST(ord AS INTEGER) AS ord, title FROM found QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) <= 3",
    "links_ranked": f"WITH {LINKS} SELECT page_id, CAST(ord AS INTEGER) AS ord, CAST(row_number() OVER (PARTITION BY page_id ORDER BY length(title), url, ord) AS INTEGER) AS place FROM found",
    "links_numbered": f"WITH {LINKS} SELECT page_id, CAST(ord AS INTEGER) AS ord, page_id || '.' || format('{{:02d}}', row_number() OVER (PARTITION BY page_id ORDER BY ord)) AS child_num FROM found",
    "query_words": f"WITH {QWORDS} {_first('e')}",
    "query_synonyms": f"WITH {QWORDS}, y AS ({SYN}), x AS (SELECT query, word, i * 100 AS i FROM e UNION ALL SELECT query, syn, i * 100 + j FROM e JOIN y USING (word)) {_first('x')}",
    "sp_numbers": f"WITH {SP} SELECT q.query, coalesce(string_agg(word, ' ' ORDER BY i), '') AS numbers FROM q LEFT JOIN f USING (query) GROUP BY q.query",
    "candidate_score": f"WITH {SCORED} SELECT page_ord, CAST(anchor_ord AS INTEGER) AS anchor_ord, points, least(100, greatest(0, points)) / 100 AS score FROM t",
    "search_topk": _page(0),
    "search_page2": _page(10),
    "search_deep_page": "SELECT CAST(greatest(0, least(100, trunc(l_quantity))) AS INTEGER) AS points, 1 AS mode_ord, l_orderkey AS page_ord, l_linenumber AS anchor_ord FROM lineitem ORDER BY 1 DESC, 3, 4 LIMIT 5 OFFSET 49995",
    "page_reports": f"WITH {FOUND} SELECT a.mode, a.page_ord, count(k.url) AS candidates_found FROM (SELECT DISTINCT mode, page_ord FROM c) a LEFT JOIN kept k ON k.mode = a.mode AND k.page_ord = a.page_ord GROUP BY a.mode, a.page_ord",
    "search_totals": f"WITH {FOUND} SELECT count(*) AS total_candidates_found, least(10, greatest(0, count(*) - 10)) AS documents_returned, count(*) > 20 AS has_more_documents FROM kept",
    "status_rollup": f"WITH {RESULTS} SELECT status, count(*) AS n FROM r GROUP BY status",
    "outcome_totals": f"WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (status LIKE 'OK%') AS ok, count(*) FILTER (status LIKE 'SKIPPED%') AS skipped, count(*) FILTER (status = 'ERROR') AS errors FROM r",
    "error_log": f"WITH {RESULTS} SELECT num, 't' AS title, status, '' AS error, CAST(NULL AS VARCHAR) AS note FROM r WHERE status = 'ERROR'",
    "registry_select": f"WITH {RESULTS} SELECT ord, num, status FROM r WHERE num IN ('1', '2', '3') ORDER BY ord LIMIT 40 OFFSET 4",
    "skip_existing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}

#: The character references that the pages hold, cut-off ones too.
_plain = lambda x: f"regexp_replace(regexp_replace({x}, '&amp;?', '&', 'g'), '&quot;?', '\"', 'g')"
ORACLES |= {
    "search_urls": f"""WITH q AS ({values(cases.QUERIES, 'query')}), e AS (SELECT query, replace(url_encode(trim(query)), '%2F', '/') AS path, replace(url_encode(trim(query)), '%20', '+') AS plus FROM q),
        c AS (SELECT query, p, k, CASE k WHEN 0 THEN '{BASE_URL}/search/node/' || path || CASE WHEN p > 0 THEN '?page=' || p ELSE '' END WHEN 1 THEN '{BASE_URL}/?do=search&subaction=search&story=' || plus || CASE WHEN p > 0 THEN '&page=' || p ELSE '' END
            ELSE '{BASE_URL}/index.php?do=search&subaction=search&story=' || plus || CASE WHEN p > 0 THEN '&page=' || p ELSE '' END END AS url FROM e, range(3) AS a(p), range(3) AS b(k))
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY p, k) - 1 AS INTEGER) AS ord, url FROM c""",
    "content_disposition": f"""WITH r AS ({values(cases.HEADERS, 'header')}), x AS (SELECT header, url_decode(trim(regexp_extract(header, '(?i);\\s*filename\\s*=\\s*([^;]*)', 1), '" ')) AS plain, url_decode(regexp_extract(header, '(?i)filename\\*=[^'']*''''([^;]+)', 1)) AS coded FROM r)
        SELECT header, CASE WHEN plain <> '' THEN {safe("plain", 100)} WHEN coded <> '' THEN {safe("coded", 100)} ELSE '' END AS name FROM x""",
    "response_type": f"""WITH r AS ({values(cases.TYPES, 'url, content_type, body, disposition')}), x AS (SELECT *, lower(content_type) AS whole, trim(split_part(lower(content_type), ';', 1)) AS ct, lower(left(body, 500)) AS head,
            lower(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '[^/](\\.[^./]+)$', 1)) AS us, lower(regexp_extract(trim(regexp_extract(disposition, 'filename=([^;]*)', 1), '" '), '[^/](\\.[^./]+)$', 1)) AS cd FROM r),
        y AS (SELECT *, coalesce(nullif(cd, ''), us) AS e FROM x),
        z AS (SELECT *, CASE WHEN starts_with(body, '%PDF') OR contains(whole, 'pdf') THEN 'PDF' WHEN ct IN ('text/html', 'application/xhtml+xml') OR contains(head, '<html') OR contains(head, '<!doctype html') THEN 'HTML_TEXT'
            WHEN contains(ct, 'rtf') OR starts_with(body, '{{\\rtf') OR us = '.rtf' OR cd = '.rtf' THEN 'WORD_RTF' WHEN us IN ('.doc', '.docx') OR cd IN ('.doc', '.docx') OR contains(ct, 'word') THEN 'WORD_DOC'
            WHEN us IN ('.xls', '.xlsx', '.csv') OR cd IN ('.xls', '.xlsx', '.csv') OR contains(ct, 'excel') OR contains(ct, 'spreadsheet') THEN 'EXCEL_TABLE' WHEN starts_with(body, 'PK' || chr(3) || chr(4)) THEN 'ZIP_OR_OFFICE' WHEN starts_with(ct, 'text/') THEN 'TEXT' ELSE 'BINARY_FILE' END AS file_type FROM y)
        SELECT url, content_type, hex(encode(body)) AS body, disposition, file_type, CASE file_type WHEN 'PDF' THEN '.pdf' WHEN 'HTML_TEXT' THEN '.txt' WHEN 'WORD_RTF' THEN '.rtf' WHEN 'WORD_DOC' THEN coalesce(nullif(e, ''), '.docx') WHEN 'EXCEL_TABLE' THEN coalesce(nullif(e, ''), '.xlsx')
            WHEN 'ZIP_OR_OFFICE' THEN coalesce(nullif(e, ''), '.zip') WHEN 'TEXT' THEN '.txt' ELSE CASE WHEN e = '' OR length(e) > 10 THEN CASE ct WHEN 'image/png' THEN '.png' ELSE '.bin' END ELSE e END END AS ext FROM z""",
    "bad_links": f"""WITH {PARTS}, t AS (SELECT url, suffix, regexp_replace(lower(url), '^https://', 'http://') AS url_low, lower(trim(regexp_replace('title ' || left(url, 12), '\\s+', ' ', 'g'))) AS title_low, low AS path_low, lower('title ' || left(url, 12) || ' ' || url) AS txt FROM n)
        SELECT url, length(title_low) < 3 OR {anyof("url_low", BAD_URL_PARTS)} OR title_low IN ({_in(BAD_TITLES)}) OR (NOT (regexp_matches(path_low, '/sp[0-9]') OR regexp_matches(title_low, '(^|[^\\p{{L}}\\p{{N}}_])сп\\s*[0-9]')) AND {SNIP}) AS bad,
            CASE WHEN regexp_matches(txt, '(^|[^\\p{{L}}\\p{{N}}_])сп\\s*[0-9]|/sp[0-9]') THEN 'СП' WHEN regexp_matches(txt, '(^|[^\\p{{L}}\\p{{N}}_])(гост|gost)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'ГОСТ' WHEN suffix = '.pdf' THEN 'PDF' WHEN suffix IN ('.doc', '.docx', '.rtf') THEN 'WORD' WHEN suffix IN ('.xls', '.xlsx') THEN 'EXCEL' ELSE 'HTML' END AS document_type FROM t""",
    "decoded_pages": "SELECT page_id, html AS text, 'utf-8' AS charset FROM pages",
    "decoded_charsets": f"""SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g') || chr(10) || translate(lower(regexp_replace(html, '[^\\x00-\\x7F]', ' ', 'g')), '{cases.LATIN}', '{cases.CYRILLIC}') || '{cases.TAIL}' AS text,
        ['windows-1251', 'koi8-r', 'iso-8859-5'][1 + page_id % 3] AS charset FROM pages""",
    "page_titles": f"SELECT page_id, {norm(_plain('''regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)'''))} AS title FROM pages",
}

#: The site of site.py: links of each page that are tried, in place; pages of another host lead nowhere.
_SITE = f"""{LINKS}, n AS (SELECT count(*) AS n FROM pages),
    t AS (SELECT page_id, ord, title, {site.TARGET_SQL.format("(SELECT n FROM n)")} AS to_page FROM found WHERE page_id % 7 <> 3),
    u AS (SELECT *, {site.URL_SQL.format("to_page")} AS url FROM t WHERE to_page % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY page_id, to_page ORDER BY ord) = 1),
    plan AS (SELECT * FROM (SELECT *, true AS navigation, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN to_page % 3 = 0 THEN 0 ELSE 2 END, length(title), url, ord) AS place FROM u WHERE page_id % 3 <> 0) WHERE place <= 4
        UNION ALL SELECT * FROM (SELECT *, false AS navigation, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS place FROM u WHERE page_id % 3 = 0 AND to_page % 3 = 0) WHERE place <= 3)"""
_WALK = """walk AS (SELECT CAST(page_id AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, page_id AS id, page_id AS page, 't' AS title, 'r' AS folder, [page_id] AS seen, CAST(0 AS BIGINT) AS place FROM pages
    UNION ALL SELECT w.path || '.' || lpad(CAST(p.place AS VARCHAR), 2, '0'), w.path, w.depth + 1, w.id, p.to_page, p.title, w.folder || '/' || w.path || '_вложения', list_append(w.seen, p.to_page), p.place
    FROM walk w JOIN {0} p ON p.page_id = w.page WHERE w.depth < 2 AND NOT (p.navigation AND list_contains(w.seen, p.to_page)))"""
_STATE = """CASE WHEN NOT ok THEN 'ERROR' WHEN file_type = 'TEXT' THEN CASE WHEN found THEN 'SKIPPED_EXISTS' ELSE 'OK_TEXT' END WHEN generic AND linked_saved = 0 THEN 'ERROR_NO_LINKED_DOCUMENTS'
    WHEN found THEN CASE WHEN linked_saved > 0 THEN 'SKIPPED_EXISTS_LINKS_PROCESSED' ELSE 'SKIPPED_EXISTS' END WHEN generic AND linked_saved > 0 THEN 'OK_LINKED_DOCUMENTS' ELSE 'OK_HTML_TEXT' END AS status"""
_BELOW = """g{0} AS (SELECT *, CASE WHEN ok THEN '' ELSE 'no response' END AS own_error FROM s{0}),
    c{0} AS (SELECT parent AS path, sum(CASE WHEN status LIKE 'OK%' OR status LIKE 'SKIPPED_EXISTS%' THEN greatest(1, linked_saved) ELSE 0 END) AS ls, count(*) FILTER (status LIKE 'ERROR%') AS le,
        array_to_string(list(url || ' -> ' || status || ': ' || error ORDER BY place) FILTER (status LIKE 'ERROR%')[1:5], ' | ') AS told FROM g{0} GROUP BY parent),
    s{1} AS (SELECT *, {2}, concat_ws(' | ', CASE WHEN ok THEN NULL ELSE 'no response' END, CASE WHEN linked_errors > 0 THEN 'errors of links: ' || told END) AS error
        FROM (SELECT i.*, CAST(coalesce(ls, 0) AS BIGINT) AS linked_saved, coalesce(le, 0) AS linked_errors, told FROM i LEFT JOIN c{0} USING (path) WHERE depth = {1}))"""
_PLACE = lambda x: f"({site.HOST_SQL.format(x)} || '/p/' || {x})"
ORACLES |= {
    "fetch_fallback": f"""WITH f AS (SELECT page_id AS item, html, unnest(range(2)) AS cand_ord, unnest(['http' || regexp_replace(url, '^[^:]+', ''), 'https' || regexp_replace(url, '^[^:]+', '')]) AS url FROM pages),
        t AS (SELECT *, {site.ANSWER_SQL} AS http_status FROM f, unnest(range(1, 4)) AS x(try_no)),
        n2 AS (SELECT *, coalesce(http_status < 400, false) AS ok, row_number() OVER (PARTITION BY item ORDER BY cand_ord, try_no) AS k FROM t),
        h AS (SELECT item, min(k) FILTER (ok) AS hit FROM n2 GROUP BY item), m AS (SELECT n2.* FROM n2 JOIN h USING (item) WHERE k <= coalesce(hit, 6)),
        e AS (SELECT *, url || ' attempt ' || try_no || '/3: ' || coalesce('HTTP ' || http_status, 'Timeout') AS error FROM m WHERE NOT ok)
        SELECT item, max(url) FILTER (ok) AS url, coalesce(max(errors), '') AS errors, CASE WHEN bool_or(ok) THEN 'OK' ELSE 'ERROR' END AS status, count(*) AS requests, CAST(2 * count(*) FILTER (try_no > 1) AS DOUBLE) AS waited
        FROM m LEFT JOIN (SELECT item, string_agg(error, ' | ' ORDER BY k) AS errors FROM e GROUP BY item) USING (item) GROUP BY item""",
    "redirects": f"""WITH RECURSIVE g AS (SELECT page_id AS p, {site.HOP_SQL.format("page_id")} AS q FROM pages), h AS (SELECT {_PLACE("p")} AS place, CASE WHEN q IS NOT NULL THEN {_PLACE("q")} END AS next FROM g),
        r AS (SELECT place AS url, place, 0 AS n, [place] AS seen, CAST(NULL AS VARCHAR) AS error FROM h UNION ALL
            SELECT r.url, CASE WHEN list_contains(seen, next) AND n < 8 THEN r.place ELSE next END, CASE WHEN list_contains(seen, next) AND n < 8 THEN n ELSE n + 1 END, list_append(seen, next),
                CASE WHEN list_contains(seen, next) AND n < 8 THEN 'redirect loop' WHEN n = 8 THEN 'too many redirects' END FROM r JOIN h USING (place) WHERE next IS NOT NULL AND error IS NULL)
        SELECT url, place AS final_url, n AS n_hops, error, place LIKE 'http://sniprf.ru/%' AND url LIKE 'http://sniprf.ru/%' AS allowed FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY len(seen) DESC) = 1""",
    "crawl_depth2": f"""WITH RECURSIVE {_SITE}, {_WALK.format("plan")}
        SELECT path, parent, depth, id, path AS num, title, folder, {site.URL_SQL.format("page")} AS original_url FROM walk""",
    "linked_saved": f"""WITH RECURSIVE {_SITE}, html AS (SELECT * FROM plan WHERE page_id % 11 <> 0 AND page_id % 6 <> 0), {_WALK.format("html")},
        i AS (SELECT w.*, {site.URL_SQL.format("page")} AS url, page % 11 <> 0 AS ok, CASE WHEN page % 11 = 0 THEN '' WHEN page % 6 = 0 AND page % 7 <> 3 THEN 'TEXT' ELSE 'HTML_TEXT' END AS file_type, page % 7 <> 3 AND page % 3 <> 0 AS generic,
            depth = 0 AND length(p.html) % 4 = 1 AS found FROM walk w JOIN pages p ON p.page_id = w.page),
        s2 AS (SELECT *, {_STATE}, CASE WHEN ok THEN '' ELSE 'no response' END AS error FROM (SELECT *, CAST(0 AS BIGINT) AS linked_saved, CAST(0 AS BIGINT) AS linked_errors, '' AS told FROM i WHERE depth = 2)),
        {_BELOW.format(2, 1, _STATE)}, {_BELOW.format(1, 0, _STATE)}
        SELECT path, depth, path AS num, url AS original_url, file_type, status, linked_saved, linked_errors, error FROM (SELECT * FROM s0 UNION ALL BY NAME SELECT * FROM s1 UNION ALL BY NAME SELECT * FROM s2)""",
    "status_machine": """WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'HTML_TEXT' WHEN 'F' THEN 'TEXT' ELSE 'PDF' END AS file_type, o_orderkey % 2 = 0 AS found, o_orderkey // 2 % 2 = 0 AS bad_text, o_orderkey // 4 % 2 = 0 AS has_bom,
            o_orderkey // 8 % 2 = 0 AS follow, o_orderkey // 16 % 2 = 0 AS generic, o_orderkey // 32 % 2 = 0 AS needs_links, o_custkey % 3 AS linked_saved, o_custkey % 5 = 0 AS failed FROM orders)
        SELECT o_orderkey, CASE WHEN failed THEN 'ERROR' WHEN found AND file_type = 'PDF' THEN 'SKIPPED_EXISTS' WHEN found AND file_type = 'TEXT' AND has_bom AND NOT bad_text THEN 'SKIPPED_EXISTS'
            WHEN found AND file_type = 'HTML_TEXT' AND has_bom AND NOT bad_text AND NOT follow THEN 'SKIPPED_EXISTS'
            WHEN file_type = 'PDF' THEN 'OK_PDF' WHEN file_type = 'TEXT' THEN CASE WHEN found THEN 'OK_TEXT_REPAIRED' ELSE 'OK_TEXT' END
            WHEN needs_links AND linked_saved = 0 THEN 'ERROR_NO_LINKED_DOCUMENTS' WHEN found AND has_bom AND NOT bad_text THEN CASE WHEN linked_saved > 0 THEN 'SKIPPED_EXISTS_LINKS_PROCESSED' ELSE 'SKIPPED_EXISTS' END
            WHEN generic AND linked_saved > 0 AND follow THEN 'OK_LINKED_DOCUMENTS' WHEN found THEN 'OK_HTML_TEXT_REPAIRED' ELSE 'OK_HTML_TEXT' END AS status FROM s""",
}
