"""Main text of web pages: gradient-boosted trees judge each block element, a dynamic programme keeps whole branches.

Features of a node: its tag, what its class, id and role tokens say, the same of its ancestors, density of text, links
and tags in its subtree, depth, and statistics of its siblings. The trees are trained on pages that Maker invents
with labels: articles of many shapes among menus, headers, footers, sidebars, notices, adverts, forms and comments.

Judged one by one, an element could be kept within one that is dropped. Decoding rules that out: over all choices in
which a kept node's parent is kept too, it takes the one with the largest likelihood, from the leaves up.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Node, parse, walk

TAGS = [("article", "main"), ("section",), ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dd", "dt"), ("table", "tbody", "thead", "tr", "td", "th"), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset"), ("blockquote", "pre"), ("figure", "figcaption")]
# What tokens of class, id and role attributes speak of.
WORDS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs pagination pager toc tabs navigation",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer copyright legal colophon bottom contentinfo",
    "side": "sidebar side aside widget rail complementary related recommended more popular trending",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense",
    "notice": "cookie cookies consent notice alert warning gdpr popup modal overlay message toast",
    "form": "form newsletter subscribe signup login search contact",
    "comment": "comment comments reply replies respond discussion disqus reader readers",
    "share": "share social sharing buttons tags meta author byline date follow",
    "content": "content article post entry main story body text articlebody blogposting prose maincontent",
}
GROUP = {w: i for i, words in enumerate(WORDS.values()) for w in words.split()}
SPLIT = re.compile(r"[^a-z0-9]+")
SENTENCE = re.compile(r"[.!?]")
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.2
MADE_PAGES = 500
#: Blocks of an invented article: long ones are rarer.
BLOCKS = [*[1, 1, 2, 3, 4, 6, 9, 14] * 5, 25, 45, 80, 140, 250]
BATCH_PAGES = 200


def groups(node: Node) -> set[int]:
    out = {GROUP[t] for t in SPLIT.split(node.attrs) if t in GROUP} if node.attrs else set()
    for k, tags in ((0, ("nav", "menu")), (1, ("header",)), (2, ("footer",)), (3, ("aside",)), (6, ("form", "fieldset"))):
        if node.tag in tags:
            out.add(k)
    return out


_TAG_AT = {t: i for i, tags in enumerate(TAGS) for t in tags}


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node of a page, as walk() orders them."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    own = np.array([sum(len(t) for _, t in x.texts) for x in nodes], float)
    stops = np.array([sum(len(SENTENCE.findall(t)) for _, t in x.texts) for x in nodes], float)
    text, links, tags, dots, deep = own.copy(), np.array([float(x.links) for x in nodes]), np.array([1.0 + x.inline for x in nodes]), stops.copy(), np.zeros(n)
    paras = np.array([float(x.tag == "p") for x in nodes])
    for i in range(n - 1, 0, -1):
        p = at[id(nodes[i].parent)]
        text[p] += text[i]
        links[p] += links[i]
        tags[p] += tags[i]
        dots[p] += dots[i]
        paras[p] += paras[i]
        deep[p] = max(deep[p], deep[i] + 1)
    k_tags, k_words = len(TAGS), len(WORDS)
    out = np.zeros((n, k_tags + 2 * k_words + 20))
    total = max(text[0], 1.0)
    above: list[set[int]] = []
    articles = np.zeros(n)
    places, alike = np.zeros(n, np.int64), np.ones(n, np.int64)  # among siblings: the node's place, and how many have its tag
    for x in nodes:
        same = Counter(s.tag for s in x.children)
        for k, s in enumerate(x.children):
            places[at[id(s)]], alike[at[id(s)]] = k, same[s.tag]
    for i, x in enumerate(nodes):
        mine = groups(x)
        p = at[id(x.parent)] if x.parent is not None else -1
        up = above[p] if p >= 0 else set()
        above.append(up | mine)
        articles[i] = (articles[p] if p >= 0 else 0) + (x.tag in ("article", "main"))
        if x.tag in _TAG_AT:
            out[i, _TAG_AT[x.tag]] = 1
        for g in mine:
            out[i, k_tags + g] = 1
        for g in up:
            out[i, k_tags + k_words + g] = 1
        sib = x.parent.children if x.parent is not None else [x]
        first = at[id(sib[0])]
        place = int(places[i])
        before, after = (sib[place - 1] if place else None), (sib[place + 1] if place + 1 < len(sib) else None)
        f = out[i, k_tags + 2 * k_words :]
        f[0], f[1], f[2] = x.depth, np.log1p(text[i]), np.log1p(own[i])
        f[3] = links[i] / max(text[i], 1)
        f[4] = text[i] / max(tags[i], 1)
        f[5] = dots[i] / max(text[i], 1) * 100
        f[6], f[7] = paras[i], deep[i]
        f[8] = text[i] / total
        f[9] = text[i] / max(text[p], 1) if p >= 0 else 1
        f[10], f[11] = len(sib), place / max(len(sib) - 1, 1)
        f[12] = np.log1p(text[at[id(before)]]) if before is not None else -1
        f[13] = np.log1p(text[at[id(after)]]) if after is not None else -1
        f[14] = articles[i]
        f[15] = links[p] / max(text[p], 1) if p >= 0 else 0
        f[16] = np.log1p(text[p]) if p >= 0 else 0
        f[17] = alike[i]
        f[18] = tags[i]
        f[19] = nodes[first].tag == x.tag
    return out


class Boosted:
    """Trees on binned features for the logistic loss; each level of a tree is grown from one histogram."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        n, k = b.shape
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(n, self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        flat = np.arange(k) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, border = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (k * BINS) + flat + b).ravel()
                sums = [np.bincount(key, np.repeat(v, k), width * k * BINS).reshape(width, k, BINS).cumsum(axis=2) for v in (g, h)]
                gl, hl = sums
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                split = gain.reshape(width, -1).max(axis=1) > 1e-6
                feature[first : first + width] = best // BINS
                border[first : first + width] = np.where(split, best % BINS, BINS)
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > border[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((feature, border, value))
            f += value[leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node belongs to the main text."""
        b = self.binned(x)
        rows = np.arange(len(b))
        f = np.full(len(b), self.start)
        for feature, border, value in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > border[node])
            f += value[node - (2**DEPTH - 1)]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the likeliest choice without a kept node below a dropped one. The root is always kept."""
    at = {id(x): i for i, x in enumerate(nodes)}
    gain = odds.astype(float).copy()  # of keeping the node and the best below it, over dropping the branch
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[at[id(nodes[i].parent)]] += gain[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[at[id(nodes[i].parent)]] and gain[i] > 0
    return keep


class Maker:
    """Invents pages with a label for each node, by writing them as trees of (tag, attributes, label, parts)."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choice("bcdfghjklmnprstvw") + r.choice("aeiouyéö") for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        text = " ".join(out)
        stop = r.choice([".", ".", ".", "!", "", "!!", "***"])
        return (text.upper() if r.random() < 0.08 else text.capitalize()) + stop

    def prose(self) -> str:
        r = self.r
        text = " ".join(self.words(2, 18) for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8])))
        if r.random() < 0.1:
            text = text.replace(" ", ' <a href="/x">', 1).replace(" ", "</a> ", 1) if text.count(" ") > 2 else text
        return f"<b>{text}</b>" if r.random() < 0.1 else text

    def links(self, n: int) -> list:
        return [("li", "", 0, [f'<a href="/{i}">{self.words(1, 3)}</a>']) for i in range(n)]

    def attr(self, group: str, chance: float = 0.75) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        word = r.choice(WORDS[group].split())
        word = r.choice([word, word, f"{word}-{r.choice(['box', 'list', 'wrapper', 'area', 'item', 'block'])}", f"{r.choice(['site', 'page', 'main' if group == 'menu' else 'the'])}-{word}"])
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def noise(self, where: str) -> tuple:
        r = self.r
        kind = r.choice({"top": ["menu", "menu", "header", "advert", "notice", "form"], "bottom": ["footer", "footer", "side", "comment", "form", "advert", "menu"], "in": ["advert", "share", "comment", "side", "notice", "form"]}[where])
        if kind == "menu":
            parts = [("ul", "", 0, self.links(r.randint(1, 9)))] if r.random() < 0.8 else [f'<a href="/{i}">{self.words(1, 2)}</a> ' for i in range(5)]
            return ("nav", self.attr("menu", 0.3), 0, parts) if r.random() < 0.6 else ("div", self.attr("menu", 0.85), 0, parts)
        if kind == "header":
            parts = [r.choice([("h1", "", 0, [self.words(1, 4)]), ("div", self.attr("header"), 0, [self.words(1, 4)]), self.words(1, 5)])]
            if r.random() < 0.5:
                parts.append(("ul", "", 0, self.links(r.randint(2, 6))))
            if r.random() < 0.4:
                parts.append(("p", "", 0, [self.words(2, 12)]))
            return ("header", self.attr("header", 0.3), 0, parts) if r.random() < 0.7 else ("div", self.attr("header", 1), 0, parts)
        if kind == "footer":
            parts = [f"&copy; {self.words(1, 3)} &middot; {self.prose()}"] if r.random() < 0.6 else [("p", "", 0, [self.prose()]), ("ul", "", 0, self.links(r.randint(0, 4)))]
            return ("footer", self.attr("footer", 0.3), 0, parts) if r.random() < 0.8 else ("div", self.attr("footer", 1), 0, parts)
        if kind == "side":
            parts = [("h3", "", 0, [self.words(1, 3)]), r.choice([("ul", "", 0, self.links(r.randint(2, 8))), ("p", "", 0, [self.prose()]), ("div", "", 0, [self.prose()])])]
            return ("aside", self.attr("side", 0.5), 0, parts) if r.random() < 0.6 else ("div", self.attr("side", 1), 0, parts)
        if kind == "comment":
            one = lambda: r.choice([("li", self.attr("comment", 0.4), 0, [("p", "", 0, [self.prose()])]), ("div", self.attr("comment", 0.8), 0, [("p", "", 0, [self.prose()])]), ("p", "", 0, [self.prose()]), ("article", self.attr("comment", 1), 0, [("p", "", 0, [self.prose()])])])
            parts = [*([("h3", "", 0, [self.words(1, 3)])] if r.random() < 0.6 else []), *(one() for _ in range(r.randint(1, 6)))]
            return (r.choice(["section", "div", "ol", "ul", "aside"]), self.attr("comment", 1), 0, parts)
        if kind == "form":
            parts = [r.choice([self.words(1, 6), ("p", "", 0, [self.prose()]), ("label", "", 0, [self.words(1, 3)])]), '<input type="text" name="q">', "<button>Go</button>"]
            return ("form", self.attr("form", 0.5), 0, parts) if r.random() < 0.8 else ("div", self.attr("form", 1), 0, [("form", "", 0, parts)])
        if kind == "share":
            return (r.choice(["div", "ul", "p"]), self.attr("share", 1), 0, [r.choice([self.words(1, 4), f'<a href="/s">{self.words(1, 2)}</a> <a href="/t">{self.words(1, 2)}</a>'])])
        parts = [r.choice([self.prose(), ("p", "", 0, [self.prose()]), f'<a href="/go">{self.words(2, 9)}</a>'])]
        return (r.choice(["div", "div", "div", "aside", "section", "p"]), self.attr(kind, 1), 0, parts)

    def block(self) -> tuple:
        r = self.r
        kind = r.random()
        if kind < 0.72:
            return ("p", ' class="lead"' if r.random() < 0.05 else "", 1, [self.prose()])
        if kind < 0.8:
            return (r.choice(["h2", "h3", "h4"]), "", 1, [self.words(1, 8)])
        if kind < 0.86:
            return (r.choice(["ul", "ol"]), "", 1, [("li", "", 1, [self.prose()]) for _ in range(r.randint(1, 6))])
        if kind < 0.89:
            return ("blockquote", "", 1, [("p", "", 1, [self.prose()])] if r.random() < 0.5 else [self.prose()])
        if kind < 0.92:
            return ("table", "", 1, [("tr", "", 1, [("td", "", 1, [self.words(1, 5)]) for _ in range(r.randint(1, 3))]) for _ in range(r.randint(1, 4))])
        if kind < 0.94:
            return ("figure", "", 1, [("figcaption", "", 1, [self.prose()])])
        if kind < 0.96:
            return ("pre", "", 1, [self.prose()])
        return (r.choice(["div", "section"]), "", 1, [self.block() for _ in range(r.randint(1, 4))])

    def page(self) -> tuple:
        r = self.r
        inside = [("h1", "", 1, [self.words(1, 10)])] if r.random() < 0.8 else []
        if inside and r.random() < 0.15:
            inside = [("header", "", 1, [*inside, *([("p", "", 1, [self.prose()])] if r.random() < 0.4 else [])])]
        inside += [self.block() for _ in range(r.choice(BLOCKS))]
        if r.random() < 0.35:
            for _ in range(r.randint(1, 2 + len(inside) // 8)):
                inside.insert(r.randint(1, len(inside)), self.noise("in"))
        shape = r.random()
        if shape < 0.6:
            main = ("article", self.attr("content", 0.25), 1, inside)
        elif shape < 0.75:
            main = ("main", self.attr("content", 0.25), 1, inside if r.random() < 0.5 else [("article", "", 1, inside)])
        elif shape < 0.93:
            main = (r.choice(["div", "section", "td"]), self.attr("content", 0.9), 1, inside)
        else:
            main = ("div", "", 1, inside)
        body = [self.noise("top") for _ in range(r.randint(0, 4))] + [main] + [self.noise("bottom") for _ in range(r.randint(0, 4))]
        if r.random() < 0.3:
            k = body.index(main)
            body[k : k + 1] = [("div", r.choice(["", ' class="wrapper"', ' id="container"']), 1, [main, *(self.noise("bottom") for _ in range(r.randint(0, 2)))])]
        return ("html", "", 1, body)


def _write(tree: tuple, out: list[str], labels: list[int]) -> None:
    tag, attrs, label, parts = tree
    if tag not in ("html", "label"):
        labels.append(label)
    out.append(f"<{tag}{attrs}>")
    for p in parts:
        out.append(p) if isinstance(p, str) else _write(p, out, labels)
    out.append(f"</{tag}>")


def made_pages(n: int, seed: int = 3) -> Iterator[tuple[list[Node], np.ndarray]]:
    """(nodes, labels) of n invented pages."""
    maker = Maker(seed)
    for _ in range(n):
        out: list[str] = []
        labels: list[int] = [1]
        _write(maker.page(), out, labels)
        nodes = walk(parse("".join(out)))
        if len(nodes) == len(labels):  # where the parser moves an element, labels don't fit
            yield nodes, np.array(labels)


@lru_cache(1)
def model(pages: int = MADE_PAGES) -> Boosted:
    """Always the same model: it is trained on invented pages only."""
    x, y = zip(*((features(nodes), labels) for nodes, labels in made_pages(pages)), strict=True)
    return Boosted(np.concatenate(x), np.concatenate(y).astype(float))


def extract(pages: list[str | None], trees: Boosted) -> list[list[str]]:
    """The blocks of each page's main text, in page order; white space within them is one space each."""
    out: list[list[str]] = []
    for i in range(0, len(pages), BATCH_PAGES):
        some = [walk(parse(p or "")) for p in pages[i : i + BATCH_PAGES]]
        odds = trees.predict(np.concatenate([features(nodes) for nodes in some])) if some else np.zeros(0)
        at = 0
        for nodes in some:
            keep = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            out.append([t for _, t in sorted(p for n, ok in zip(nodes, keep, strict=True) if ok for p in n.texts)])
    return out


def _extracted(rows: Iterator[pa.RecordBatch], trees: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = ["\n".join(b) for b in extract(batch["html"].to_pylist(), trees)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    A null or empty page, and one without main text, gives an empty text. Text outside of any element counts as the
    body's own and is kept. Ids and URLs may be null or repeat; pages of any length are read whole. An empty table gives
    an empty result. Extra columns are ignored.
    """
    trees = model()
    id_kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(lambda it: _extracted(it, trees), f"page_id {id_kind}, url string, text string, n_chars long")
