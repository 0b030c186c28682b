"""Character encodings: clean UTF-8 is found natively; for other bodies every candidate is judged and the best one wins."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_mojibake
from ..lexicons import CHARSET_BONUS, CHARSET_NAMED, CHARSET_POINTS, CHARSETS, CONTROLS, DOMAIN_WORDS, FUNCTION_WORDS, MOJIBAKE, REPLACED

META = tuple(re.compile(p.encode(), re.I) for p in CHARSET_NAMED)


def normalized(name: str | None) -> str:
    return (name or "").strip().lower().replace("_", "-")


def candidates(body: bytes, header: str | None = None, http: str | None = None, fixed: Iterable[str] = CHARSETS, head: int | None = None) -> list[str]:
    """Charsets to try, in order: those the document names (in its first `head` bytes, or anywhere), the header's, the
    client's, a detector's, the usual ones."""
    named = [m[1].decode("ascii", "ignore").strip() for p in META for m in p.finditer(body if head is None else body[:head])]
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(body).best()
        guess = best.encoding if best else ""
    except ImportError:
        guess = ""
    seen: dict[str, str] = {}
    for c in (*named, header or "", http or "", guess, *fixed):
        if c and c.strip():
            seen.setdefault(normalized(c), c.strip())
    return list(seen.values())


def decoded(body: bytes, name: str) -> str | None:
    """None if the charset is unknown, or strict UTF-8 fails."""
    try:
        return body.decode(name, "strict" if normalized(name) in ("utf-8", "utf-8-sig") else "replace")
    except (LookupError, UnicodeDecodeError, ValueError):
        return None


_CONTROL = re.compile(CONTROLS)
_TOKEN = re.compile(MOJIBAKE)
_CYRILLIC = re.compile(r"[\u0400-\u04FF]")
_MULTIBYTE = re.compile(r"[^\x00-\x7F\ufeff]")
_DOMAIN = re.compile(rf"\b(?:{'|'.join(DOMAIN_WORDS)})\b", re.I)
#: In lower case alone: KOI8-R and the others have small letters where windows-1251 has capitals.
_FUNCTION = re.compile(rf"\b(?:{'|'.join(FUNCTION_WORDS)})\b")


def bonus(name: str, controls: int, replaced: int) -> int:
    if controls or replaced:
        return 0
    return CHARSET_BONUS.get(normalized(name), 0)


def points(text: str, name: str) -> int:
    """Points of a decoding: words of the field, function words and Cyrillic letters, less signs of a wrong charset. In
    UTF-8, which is strict, characters of several bytes count as well."""
    controls, replaced = len(_CONTROL.findall(text)), text.count("\ufffd") + text.count(REPLACED)
    found = {"domain": len(_DOMAIN.findall(text)), "function": len(_FUNCTION.findall(text)), "cyrillic": len(_CYRILLIC.findall(text)), "controls": controls, "replaced": replaced, "tokens": len(_TOKEN.findall(text))}
    if normalized(name) in ("utf-8", "utf-8-sig"):
        found["multibyte"] = len(_MULTIBYTE.findall(text))
    return sum(CHARSET_POINTS[k] * n for k, n in found.items()) + bonus(name, controls, replaced)


@dataclass(frozen=True)
class Bytewise:
    """What points() asks of a text in a charset of one byte a character, asked of the bytes themselves: counts of single
    characters by a histogram, words and tokens by patterns of bytes."""

    kinds: np.ndarray  #: 256 x 3: whether a byte is Cyrillic, a control character, unknown
    domain: re.Pattern[bytes] | None
    function: re.Pattern[bytes] | None
    tokens: re.Pattern[bytes] | None
    replaced: bytes | None

    def points(self, body: bytes, histogram: np.ndarray, name: str) -> int:
        cyrillic, controls, unknown = (int(n) for n in histogram @ self.kinds)
        count = lambda p: sum(1 for _ in p.finditer(body)) if p else 0
        replaced = unknown + (body.count(self.replaced) if self.replaced else 0)
        found = {"domain": count(self.domain), "function": count(self.function), "cyrillic": cyrillic, "controls": controls, "replaced": replaced, "tokens": count(self.tokens)}
        return sum(CHARSET_POINTS[k] * n for k, n in found.items()) + bonus(name, controls, replaced)


_ONE_BYTE = re.compile(r"ascii|cp\d+|iso8859-\d+|koi8-[rtu]|latin[-_]?1|mac-\w+|kz1048|ptcp154|hp-roman8|tis-620")


@lru_cache(64)
def bytewise(name: str) -> Bytewise | None:
    """The tables and patterns of a charset, or None if it isn't one of one byte a character."""
    if not is_known(name) or not _ONE_BYTE.fullmatch(codecs.lookup(name).name):
        return None
    table = [bytes([b]).decode(name, "replace") for b in range(256)]
    if any(len(c) != 1 for c in table) or bytes(range(256)).decode(name, "replace") != "".join(table):
        return None

    def one_of(chars: Iterable[str]) -> bytes:
        wanted = set(chars)
        members = [b for b, c in enumerate(table) if c in wanted]
        return b"[" + b"".join(b"\\x%02x" % b for b in members) + b"]" if members else b"(?!)"

    word = one_of(c for c in table if c.isalnum() or c == "_")

    def words(listed: Iterable[str], any_case: bool) -> re.Pattern[bytes] | None:
        out = []
        for w in listed:
            stem = w.removesuffix(r"\w*")
            letters = [one_of({c.lower(), c.upper()} if any_case else c) for c in stem]
            if b"(?!)" not in letters:
                out.append(b"".join(letters) + (word + b"*" if stem != w else b""))
        return re.compile(b"(?<!%s)(?:%s)(?!%s)" % (word, b"|".join(out), word)) if out else None

    pairs = [b"".join(b"[^\\n]" if c == "." else one_of(c) for c in p) for p in MOJIBAKE.split("|") if all(c == "." or c in table for c in p)]
    kinds = np.array([(bool(_CYRILLIC.match(c)), bool(_CONTROL.match(c)), c == "\ufffd") for c in table], np.int64)
    lost = bytes(table.index(c) for c in REPLACED) if all(c in table for c in REPLACED) else None
    return Bytewise(kinds, words(DOMAIN_WORDS, True), words(FUNCTION_WORDS, False), re.compile(b"|".join(pairs)) if pairs else None, lost)


def choose(body: bytes, header: str | None = None, http: str | None = None, head: int | None = None, sample: int | None = None) -> tuple[str, str]:
    """(text, charset): the candidate with the most points, the earliest of equals. Charsets of one byte a character are
    judged on the bytes, so that the winner alone is decoded. sample: how many characters are judged, by default all."""
    part = body if sample is None else body[:sample]
    histogram = np.bincount(np.frombuffer(part, np.uint8), minlength=256)
    best: tuple[int, str, str | None] | None = None
    for name in candidates(body, header, http, head=head):
        if (table := bytewise(name)) is not None:
            text, got = None, table.points(part, histogram, name)
        elif (text := decoded(body, name)) is not None:
            got = points(text if sample is None else text[:sample], name)
        else:
            continue
        if best is None or got > best[0]:
            best = (got, name, text)
    if best is None:
        return body.decode("utf-8", "replace"), "utf-8-replace"
    return best[2] if best[2] is not None else body.decode(best[1], "replace"), best[1]


def _chosen(rows: Iterator[pa.RecordBatch], key: str, head: int | None, sample: int | None) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            got = [(t, "utf-8") if t is not None else choose(b or b"", header, http, head, sample) for t, b, header, http in zip(*(part[c].to_pylist() for c in ("text", "body", "header_charset", "http_charset")), strict=True)]
            yield pa.RecordBatch.from_arrays([part[key], *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], names=[key, "text", "charset"])


def decode(df: DataFrame, key: str, body: str = "body", header_charset: Column | None = None, http_charset: Column | None = None, head: int | None = None, sample: int | None = None) -> DataFrame:
    """key, text, charset for each row of df. A body that is UTF-8 and gives a clean text is that, natively; of any other
    body the decoding with the most points counts, the earliest of equals. A null body is empty; keys may repeat or be
    null. head, sample: how many bytes may name a charset, and how many characters are judged; by default all."""
    none = F.lit(None).cast("string")
    ready = df.select(key, F.coalesce(F.col(body), F.lit(b"")).alias("body"), (header_charset if header_charset is not None else none).alias("header_charset"), (http_charset if http_charset is not None else none).alias("http_charset"))
    utf8 = F.when(F.is_valid_utf8(F.col("body").cast("string")), F.col("body").cast("string"))
    ready = ready.withColumn("text", utf8).withColumn("text", F.when(~looks_like_mojibake(F.col("text"), sample), F.col("text")))
    ready = ready.withColumn("body", F.when(F.col("text").isNull(), F.col("body")))
    kind = df.schema[key].dataType.simpleString()
    return ready.mapInArrow(lambda it: _chosen(it, key, head, sample), f"{key} {kind}, text string, charset string")


def is_known(name: str) -> bool:
    try:
        codecs.lookup(name)
    except LookupError:
        return False
    return True
