"""HTML trees in Arrow batches: candidate blocks, titles and anchors as rows; lines are judged and blocks chosen natively.

The tree is built as lenient parsers do it: an end tag closes the nearest open element of its name or is ignored, and
unclosed elements nest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.names import link_text
from ..functions.text import any_of, lines, norm_space
from ..lexicons import CANDIDATE_SELECTORS, CANDIDATE_TAGS, CONTENT_ATTR_WORDS, DROP_ATTR_WORDS, DROP_TAGS
from ..operators.lines import RUN, SHORT, marked, points, trim_start

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED_ATTRS = ("id", "class", "role", "aria-label", "data-block", "data-area")
LEAST_BLOCK = 180


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def label(self) -> str:
        return " ".join(self.attrs[n] for n in NAMED_ATTRS if self.attrs.get(n)).lower()

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def pieces(self) -> Iterator[str]:
        """Stripped, non-empty texts below the element, in order."""
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if x := x.strip():
                    yield x
            else:
                todo.extend(reversed(x.parts))

    def elements(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(p for p in reversed(x.parts) if isinstance(p, Element))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def remove(root: Element, tags: tuple[str, ...], words: tuple[str, ...] = ()) -> None:
    """Drops elements of the tags, and those whose attributes hold one of the words."""
    todo = [root]
    while todo:
        x = todo.pop()
        x.parts = [p for p in x.parts if isinstance(p, str) or not (p.tag in tags or (words and (label := p.label()) and any(w in label for w in words)))]
        todo.extend(p for p in x.parts if isinstance(p, Element))


def _parsed(pages: DataFrame, find: Callable[[str], object], kind: pa.DataType, ddl: str, *keep: str) -> DataFrame:
    """The columns to keep, and `found`: what find() gives for html, some pages at a time."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                found = pa.array([find(h or "") for h in part["html"].to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), found], names=[*keep, "found"])

    kept = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{kept}, found {ddl}")


def _matches(e: Element, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in e.classes()
    if selector[0] == "#":
        return e.attrs.get("id") == selector[1:]
    if selector[0] == "[":
        name, _, value = selector[1:-1].partition("=")
        return e.attrs.get(name) == value
    return e.tag == selector


def _ordered(every: list[Element], root: Element) -> Iterator[Element]:
    """The body, then what the selectors and tags find, each element once; the body's own turn as the first one doesn't
    use up its place among the others."""
    yield next((e for e in every if e.tag == "body"), root)
    seen: set[int] = set()
    for e in (*(e for s in CANDIDATE_SELECTORS for e in every if e is not root and _matches(e, s)), *(e for e in every if e.tag in CANDIDATE_TAGS)):
        if id(e) not in seen:
            seen.add(id(e))
            yield e


def intervals(html: str) -> dict:
    """The page's text once, as lines, and its candidate blocks as ranges of them.

    Elements are numbered as they begin; what is below one lies between the numbers at its begin and at its end, so the
    lengths of its text and of its links are differences of sums up to these. Linear in the page's size at any depth.
    """
    root = parse(html)
    remove(root, DROP_TAGS, DROP_ATTR_WORDS)
    rows: list[str] = []
    n_pieces = n_chars = n_linked = 0
    span: dict[int, list[int]] = {}  # lines, pieces and characters before an element and its end, and characters of links
    every: list[Element] = []
    todo: list[tuple[Element | str, bool]] = [(root, False)]
    while todo:
        x, ended = todo.pop()
        if isinstance(x, str):
            if x := x.strip():
                rows += x.splitlines()
                n_pieces += 1
                n_chars += len(x)
        elif not ended:
            every.append(x)
            span[id(x)] = [len(rows), n_pieces, n_chars, n_linked]
            todo.append((x, True))
            todo.extend((p, False) for p in reversed(x.parts))
        else:
            at = span[id(x)]
            at += [len(rows), n_linked - at[3], _joined(n_chars - at[2], n_pieces - at[1])]
            if x.tag == "a":
                n_linked += at[6]
    found = []
    for e in _ordered(every, root):
        lo, _, _, _, hi, linked, size = span[id(e)]
        found.append({"ord": len(found), "attrs": e.label(), "lo": lo, "hi": hi, "text_len": size, "link_len": linked})
    return {"lines": rows, "blocks": found}


def _joined(chars: int, pieces: int) -> int:
    return chars + max(pieces - 1, 0)


def _whole(html: str) -> str:
    """All text of a page but scripts and the like."""
    root = parse(html)
    remove(root, ("script", "style", "noscript", "svg"))
    return "\n".join(root.pieces())


_PLACE = [("ord", "int"), ("attrs", "string"), ("lo", "int"), ("hi", "int"), ("text_len", "long"), ("link_len", "long")]
_FOUND = "struct<lines: array<string>, blocks: array<struct<" + ", ".join(f"{n}: {k}" for n, k in _PLACE) + ">>>"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_PAGE = pa.struct([("lines", pa.list_(pa.string())), ("blocks", pa.list_(pa.struct([(n, _ARROW[k]) for n, k in _PLACE])))])
_COUNTS = ("n_chars", "legal", "menu", "long_lines", "short_lines", "numbered", "articles")


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


class _Lines:
    """A page's lines as cleaned() leaves them, with sums up to each, so that counts of a range take the same time at any
    length. A range differs from the page only where it begins: in a run of short lines, of which its own first RUN
    stay, and after a number that stands alone on its line, whose next line belongs to it."""

    def __init__(self, m: dict[str, np.ndarray], line: list[str]) -> None:
        some = np.flatnonzero(~m["frame"])
        self.some = _sums(~m["frame"])
        fresh = np.array([k == 0 or line[i] != line[some[k - 1]] for k, i in enumerate(some.tolist())], bool)
        self.at = some[fresh]  # the first of equal lines in a row
        self.last = np.append(some[np.flatnonzero(fresh)[1:] - 1], some[-1:]) if len(some) else some  # and the last one
        n = len(self.at)
        self.m = {k: v[self.at] for k, v in m.items()}
        capped = self.m["capped"]
        place = np.arange(n) - np.maximum.accumulate(np.where(capped, -1, np.arange(n))) if n else np.zeros(0, np.int64)
        self.kept = ~capped | (place <= RUN)
        self.ends = np.minimum.accumulate(np.where(capped, n, np.arange(n))[::-1])[::-1]  # where the run of short lines ends
        self.before = _sums(self.kept)
        k = np.flatnonzero(self.kept)
        size = self.m["n_chars"]
        bare, follows = self.m["numbered"][k] == 2, np.append(self.m["digit"][k][1:], False)
        index = np.arange(len(k))
        begin = np.maximum.accumulate(np.where(bare, -1, index)) + 1 if len(k) else index  # of the run of lone numbers
        self.bare, self.stop = bare, np.minimum.accumulate(np.where(bare, len(k), index)[::-1])[::-1] if len(k) else index
        odd = np.append(False, bare & ((index - begin) % 2 == 0))[:-1] if len(k) else bare  # the line before takes this one
        self.takes = bare & ((index - begin) % 2 == 0)
        self.own = self.m["numbered"][k] == 1
        sums = {
            "n_chars": size[k] + 1, "legal": self.m["legal"][k], "menu": self.m["menu"][k], "long_lines": size[k] > 80, "short_lines": size[k] < SHORT,
            "numbered": self.takes | (self.own & ~odd), "articles": (self.m["article"][k] == 1) | ((self.m["article"][k] == 2) & follows),
        }
        self.sums, self.k = {name: _sums(x) for name, x in sums.items()}, k

    def range(self, lo: int, hi: int) -> tuple[int, int, int, int]:
        """Of lines lo to hi: the first and the end of those that stay, by place among the page's; before `rest`, the first
        RUN stay, from there on the page's own."""
        a, b = int(np.searchsorted(self.last, lo)), int(np.searchsorted(self.at, hi))
        if self.some[lo] == self.some[hi]:  # between equal lines there may be others, none of which stays
            return a, a, a, a
        rest = min(int(self.ends[a]), b)
        return a, min(a + RUN, rest), rest, b

    def counts(self, a: int, head: int, rest: int, b: int) -> dict[str, int]:
        x, y = int(self.before[rest]), int(self.before[b])
        out = {name: int(s[y] - s[x]) for name, s in self.sums.items()}
        if x < y:  # the last line has no next one
            out["numbered"] -= int(self.takes[y - 1])
            out["articles"] -= int(self.m["article"][self.k[y - 1]] == 2 and self.sums["articles"][y] > self.sums["articles"][y - 1])
        first = range(a, head)
        taken = False
        for i in first:
            m = {k: v[i] for k, v in self.m.items()}
            more = i + 1 < head or x < y
            follows = self.m["digit"][i + 1] if i + 1 < head else bool(x < y and self.m["digit"][self.k[x]])
            out["n_chars"] += int(m["n_chars"]) + 1
            out["legal"] += int(m["legal"])
            out["menu"] += int(m["menu"])
            out["long_lines"] += int(m["n_chars"] > 80)
            out["short_lines"] += int(m["n_chars"] < SHORT)
            out["articles"] += int(m["article"] == 1 or (m["article"] == 2 and follows))
            starts = not taken and (m["numbered"] == 1 or (m["numbered"] == 2 and more))
            out["numbered"] += int(starts)
            taken = bool(starts and m["numbered"] == 2)
        if x < y:
            out["numbered"] += self._shifted(x, y, taken)
        return out

    def _shifted(self, x: int, y: int, taken: bool) -> int:
        """What the numbered points of kept lines x to y gain if counting begins there, the first line taken or not."""
        end = min(int(self.stop[x]), y)  # lone numbers from x on, then a line of another kind, if it is in the range
        gain = self._taking(x, end, not taken) - self._taking(x, end, bool(self.takes[x]))
        if end == y:  # the last number in the range takes no next line; counts() has left it out if it does on the page
            gain += int(self.takes[y - 1]) - int(self._takes_last(x, end, not taken))
        elif self.own[end]:
            gain += int(self.takes[end - 1] if end else 0) - int(self._takes_last(x, end, not taken) if end > x else taken)
        return gain

    @staticmethod
    def _taking(x: int, end: int, first: bool) -> int:
        return (end - x + 1) // 2 if first else (end - x) // 2

    @staticmethod
    def _takes_last(x: int, end: int, first: bool) -> bool:
        return end > x and ((end - 1 - x) % 2 == 0) == first


def _ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with marked lines: their blocks with the counts of their cleaned text, and which lines that has."""
    kind = pa.list_(pa.struct([("ord", pa.int32()), *((c, pa.int64()) for c in _COUNTS), *((c, pa.int32()) for c in ("a", "head", "rest", "b"))]))
    for batch in rows:
        offsets = batch["marks"].offsets.to_numpy()
        flat = batch["marks"].flatten()
        marks = {f.name: flat.field(f.name) for f in flat.type}
        text = marks.pop("line").to_pylist()
        numbers = {k: v.to_numpy(zero_copy_only=False) for k, v in marks.items()}
        shift = int(offsets[0]) if len(offsets) else 0
        blocks, at, kept = [], [], []
        for i, places in enumerate(batch["blocks"].to_pylist()):
            lo, hi = int(offsets[i]) - shift, int(offsets[i + 1]) - shift
            page = _Lines({k: v[lo:hi] for k, v in numbers.items()}, text[lo:hi])
            found = []
            for b in places:
                span = page.range(b["lo"], b["hi"])
                found.append({"ord": b["ord"], **page.counts(*span), **dict(zip(("a", "head", "rest", "b"), span, strict=True))})
            blocks.append(found)
            at.append(page.at)
            kept.append(page.kept)
        others = [c for c in batch.schema.names if c != "found"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), pa.array(blocks, kind), pa.array(at, pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.bool_()))], names=[*others, "counts", "at", "kept"])


def _scored(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, the columns to keep, and blocks: ord, n_chars, score and the range of lines of each; a row for each page.
    lines, at and kept tell the lines that stay. Lines are judged natively, once each; only blocks that are long enough, and
    the body, are there."""
    got = _parsed(pages, intervals, _PAGE, _FOUND, "page_id", *keep)
    judged = got.select("page_id", *keep, F.col("found.blocks").alias("blocks"), F.transform("found.lines", lambda x: marked(x)).alias("marks"))
    kinds = {f.name: f.dataType.simpleString() for f in judged.schema.fields}
    ints = ", ".join(f"{c}: bigint" for c in _COUNTS)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in judged.columns) + f", counts array<struct<ord: int, {ints}, a: int, head: int, rest: int, b: int>>, at array<int>, kept array<boolean>"
    counted = judged.mapInArrow(_ranges, ddl)

    def of(p: Column, c: Column) -> Column:
        density = F.when(p["text_len"] == 0, 1.0).otherwise(p["link_len"] / p["text_len"])
        score = points(c["legal"], c["numbered"], c["articles"], c["long_lines"], c["short_lines"], c["menu"], c["n_chars"], any_of(p["attrs"], CONTENT_ATTR_WORDS), density)
        return F.struct(score.alias("score"), (-p["ord"]).alias("later"), p["ord"].alias("ord"), c["n_chars"].alias("n_chars"), c["a"].alias("a"), c["head"].alias("head"), c["rest"].alias("rest"), c["b"].alias("b"))

    scored = F.filter(F.zip_with("blocks", "counts", of), lambda x: (x["ord"] == 0) | (x["n_chars"] >= LEAST_BLOCK))
    return counted.select("page_id", *keep, F.col("marks.line").alias("lines"), "at", "kept", scored.alias("blocks"))


def block_scores(pages: DataFrame) -> DataFrame:
    """page_id, ord, n_chars, score of each candidate block, its text normalised; short blocks but the body are out."""
    return _scored(pages).select("page_id", F.inline(F.transform("blocks", lambda b: F.struct(b["ord"].alias("ord"), b["n_chars"].alias("n_chars"), b["score"].alias("score")))))


def _best(pages: DataFrame, *keep: str) -> DataFrame:
    """A row for each row of pages: page_id, the columns to keep, text."""
    rows = _scored(pages, *keep).withColumn("best", F.array_max("blocks"))
    part = lambda c, lo, hi: F.slice(c, F.col(lo) + 1, F.col(hi) - F.col(lo))
    after = F.filter(F.arrays_zip(part("at", "best.rest", "best.b").alias("at"), part("kept", "best.rest", "best.b").alias("kept")), lambda x: x["kept"])
    places = F.concat(part("at", "best.a", "best.head"), F.transform(after, lambda x: x["at"]))
    text = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    return rows.select("page_id", *keep, trim_start(text).alias("text"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, text: the block with the most points, the earliest of equals, trimmed to the document's start. A row for
    each row of pages, whose ids may repeat or be null."""
    return _best(pages)


def readable_text(pages: DataFrame) -> DataFrame:
    """page_id, text: the main text, or all lines of the page but scripts and the like where there is none."""
    whole = _parsed(pages.withColumn("page", F.col("html")), _whole, pa.string(), "string", "page_id", "page")
    both = _best(whole.select("page_id", F.col("page").alias("html"), F.col("found").alias("whole")), "whole")
    every = F.concat(F.array_join(F.filter(F.transform(lines(F.col("whole")), norm_space), lambda x: x != ""), "\n"), F.lit("\n"))
    return both.select("page_id", F.when(norm_space(F.col("text")) != "", F.col("text")).otherwise(every).alias("text"))


_ANCHOR = pa.struct([("ord", pa.int32()), ("href", pa.string()), ("title", pa.string()), ("around", pa.string()), ("near", pa.string())])


def _found(html: str) -> list[dict]:
    root = parse(html)
    remove(root, ("script", "style", "noscript", "svg", "iframe"))
    out = []
    for a in root.elements():
        if a.tag == "a" and "href" in a.attrs:
            up, around, near = a.parent, "", ""
            while up is not None and not (around and near):
                if not around and up.tag in ("p", "li", "div"):
                    around = " ".join(up.pieces())
                if not near and up.tag in ("li", "div", "article", "section", "p", "td"):
                    near = " ".join(up.pieces())
                up = up.parent
            out.append({"ord": len(out), "href": a.attrs["href"].strip(), "title": " ".join(a.pieces()), "around": around, "near": near})
    return out


def anchored(pages: DataFrame) -> DataFrame:
    """page_id, base, ord, href, title (the anchor's own text), around, near, url of the anchors that lead somewhere."""
    got = _parsed(pages.withColumn("base", F.col("url")), _found, pa.list_(_ANCHOR), "array<struct<ord int, href string, title string, around string, near string>>", "page_id", "base")
    return got.select("page_id", "base", F.inline("found")).where(~U.is_skipped_href(F.col("href"))).withColumn("url", U.join(F.col("base"), F.col("href")))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, base, ord, href, url, title, snippet. title: the anchor's text; where it is short, what stands around it."""
    own, near = link_text(F.col("title")), norm_space(F.col("near"))
    title = F.when((F.length(own) < 8) & (near != ""), F.left(near, F.lit(180))).otherwise(own)
    return anchored(pages).select("page_id", "base", "ord", "href", "url", title.alias("title"), F.left(near, F.lit(500)).alias("snippet"), norm_space(F.col("around")).alias("around"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, base, ord, url, title of all anchors, for a crawl. title: the paragraph around an anchor if it holds the
    anchor's text and is short enough, else that text."""
    own, around = link_text(F.col("title")), norm_space(F.col("around"))
    fits = (own != "") & F.contains(around, own) & (F.length(around) <= 260) & (U.pravo_nd(F.col("url")) == "")
    return anchored(pages).select("page_id", "base", "ord", "url", F.when(fits, link_text(around)).otherwise(own).alias("title"))


def _title(html: str) -> str:
    root = parse(html)
    first = {}
    for e in root.elements():
        first.setdefault(e.tag, e)
    for tag in ("h1", "title"):
        if tag in first:
            text = " ".join(first[tag].pieces())
            return text if tag == "h1" else text.split("|")[0].rstrip()
    return ""


def titles(pages: DataFrame) -> DataFrame:
    """page_id, title: the first h1, else the page's title up to a bar."""
    return _parsed(pages, _title, pa.string(), "string", "page_id").select("page_id", norm_space(F.col("found")).alias("title"))
