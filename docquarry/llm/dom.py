"""A small HTML tree of block elements, enough to tell a page's parts from each other.

Unclosed elements end where the HTML rules for p, li, dd, dt, tr, td, th and option end them, or with their parent; end
tags without a start are ignored. Inline elements belong to the block around them; br and hr part two pieces of text.
Scripts, styles, templates, comments, heads and form controls have no text at all; a button or select without an end
tag ends at the next block. Elements of svg and math count as inline.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe".split())
CONTROLS = frozenset("button select".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img noscript object canvas audio video svg math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl body html".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WHITE = re.compile(r"[\s ]+")


@dataclass
class Node:
    tag: str
    attrs: str
    parent: Node | None
    depth: int
    children: list[Node] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)  #: (place in the page, text) of own pieces
    links: int = 0  #: characters of own text within links
    inline: int = 0  #: inline tags


def attributes(raw: str) -> str:
    """Values of the attributes that say what an element is for, in lower case."""
    return " ".join((a[1] or a[2] or a[3]).lower() for a in ATTR.findall(raw) if a[0].lower() in ("class", "id", "role", "itemprop", "aria-label", "itemtype")) if "=" in raw else ""


def parse(page: str) -> Node:
    """The root of the page's tree; its pieces of text are numbered in page order."""
    root = Node("html", "", None, 0)
    at, piece, place = root, [], 0
    in_link = 0
    mute = foreign = False
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal place
        if piece:
            text = WHITE.sub(" ", html.unescape("".join(piece))).strip()
            piece.clear()
            if text:
                at.texts.append((place, text))
                place += 1

    while pos < end:
        m = TOKEN.search(page, pos)
        if m is None:
            if not mute:
                piece.append(page[pos:])
            break
        if m.start() > pos and not mute:
            text = page[pos : m.start()]
            piece.append(text)
            if in_link:
                at.links += len(text.strip())
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, pos)
                pos = close.end() if close else end
            continue
        if tag in CONTROLS:
            mute = False
            if not m[1]:
                close = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, pos)
                if close and close[1]:
                    pos = close.end()
                else:
                    mute = True
            continue
        if tag in FOREIGN:
            foreign = not m[1] and not m[3].rstrip().endswith("/")
        elif foreign and tag not in CLOSES_P and tag not in CLOSED_BY and tag not in SCOPE:
            continue
        if mute and tag in ("option", "optgroup"):
            continue
        if tag in ("html", "body", "head"):
            flush()
            if tag == "body" and not m[1]:
                root.attrs = attributes(m[3])
            continue
        if tag in INLINE:
            at.inline += 1
            if tag == "a":
                in_link = 0 if m[1] else 1
            continue
        flush()
        mute = foreign = False
        if tag in VOID:
            continue
        if m[1]:
            up = at
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                at = up.parent
                in_link = 0
            continue
        if tag in CLOSES_P:
            up = at
            while up.parent is not None and up.tag not in SCOPE and up.tag != "p" and up.tag not in ("div", "article", "section", "main", "li", "td"):
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in CLOSED_BY:
            up = at
            while up.parent is not None and up.tag not in CLOSED_BY[tag] and up.tag not in SCOPE:
                up = up.parent
            if up.tag in CLOSED_BY[tag]:
                at = up.parent
                if tag in ("tr", "tbody") and at.tag in CLOSED_BY[tag]:
                    at = at.parent
        node = Node(tag, attributes(m[3]), at, at.depth + 1)
        at.children.append(node)
        at = node
    flush()
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents before their children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.children))
    return out
