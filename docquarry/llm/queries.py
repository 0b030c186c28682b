"""The queries opN_<name> of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contamination
from .exact_dedup import exact_dedup
from .heap_lloyd import compress
from .html_extract import main_text
from .jaccard_join import jaccard_components
from .kneser_ney import lm_scores
from .langid import identify
from .mixing import mix
from .neighbours import quality
from .records import token_records
from .runs import text_runs
from .sharding import kd_shards
from .shared import table
from .toxicity import toxicity


#: Weights of the mixture; names that aren't listed weigh 1.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}}
TOKENIZER = "word_bpe_49k.json"


def domain() -> Column:
    """A source's domain: a fixed deal of the sources, as the documents name none themselves."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as the table itself, of at most two epochs of each source: doc_id, source, lang, epoch, mix_tokens."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, Fraction(1), domain(), MIX_WEIGHTS, epochs=2, seed="mix-1").select("doc_id", "lang", "source", "epoch", "mix_tokens")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=24)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def periodic(doc_id: Column, text: Column) -> Column:
    """The texts that op12 reads: where h = crc32(doc_id) ends in the digit 0, the words from a on repeat the p words from
    a on; a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10), of n words."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a), again))

    found = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.transform(F.array(found), repeated)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = text_runs(docs.select("doc_id", periodic(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    picked = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("b.length"), -F.col("b.col3")
    return picked.select(
        "doc_id", "n_runs", (-F.col("b.col2")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * b.length div -b.col3").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_mixing": op5_mixing,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_records": op7_token_records,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_quality": op11_quality,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}

#: crc32 of a number's decimal digits: a byte is taken in, then eight bits are shifted out.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END))"""

_LLOYD_ROUND = """
        n{r} AS (SELECT vec_id, any_value(label) AS label, part, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m
            FROM v JOIN c{r} c USING (part) GROUP BY vec_id, part),"""
_LLOYD_MOVE = """
        m{r} AS (SELECT part, e, list(y ORDER BY j) AS x FROM (SELECT part, m.e AS e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS y FROM n{r}, unnest(range(1, len(x) + 1)) AS t(j) GROUP BY part, m.e, j) GROUP BY part, e),
        c{s} AS (SELECT part, e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, e)),"""

ORACLES: dict[str, str] = {
    "op2_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        k AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS key, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(s) WHERE len(w) > 0),
        p AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS key FROM d, unnest(range(1, len(w) + 1)) AS t(s), (SELECT DISTINCT n FROM k) WHERE s + n - 1 <= len(w)),
        m AS (SELECT DISTINCT p.doc_id, p.s, p.n, k.item_id FROM p JOIN k USING (key, n)),
        h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM m, unnest(range(s, s + n)) AS t(x) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
    "op6_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
    """,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY norm)
    """,
    "op12_periodic_runs": f"""
        WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w0, {_CRC32} AS h FROM documents),
        k AS (SELECT doc_id, w0, len(w0) AS n, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a, (h // 10) % 8 AS e FROM h),
        d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_concat(w0[1:a], list_transform(range(n - a), lambda i: w0[1 + a + i % (1 + (n - a) // (3 + e))])) END AS w FROM k),
        x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
        p AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
        g AS (SELECT doc_id, count(*) AS n_runs, max({{'length': length, 'start': -start, 'period': -period}}) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
        o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM x ANTI JOIN o USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, -b.start AS start, b.length AS length, -b.period AS period, 1000 * b.length // -b.period AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op13_vector_codes": f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT vec_id, label, part, w[part * (len(w) // 4) + 1:(part + 1) * (len(w) // 4)] AS x FROM k, unnest(range(4)) AS t(part)),
        c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM v QUALIFY e < 256),
        {"".join(_LLOYD_ROUND.format(r=r) + _LLOYD_MOVE.format(r=r, s=r + 1) for r in range(4))}{_LLOYD_ROUND.format(r=4)}
        f AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n4 GROUP BY vec_id),
        b AS (SELECT sha256(string_agg(y, ',' ORDER BY part, e)) AS codebooks_sha256 FROM (SELECT part, e, array_to_string(x, ',') AS y FROM c4))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, b
    """,
}
