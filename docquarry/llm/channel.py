"""A noisy channel that hides words: letters become look-alike digits and signs, are repeated, or are spaced out.

restore_word() finds the likeliest original of a word: the word spans a lattice with the ways in which each run of equal
characters may have come about, and Viterbi's algorithm finds the cheapest path under the channel's costs and a
character bigram model. Only words that look noisy are decoded; all others are their own original.

respaced() does the same for a run of short tokens, whose spaces are optional elements of the lattice.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# What each look-alike may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
SWAP, DROP, TWICE, ONCE = 0.7, 8.0, 1.5, 0.7  #: costs in nats: look-alike, dropped sign, kept pair of a long run, undone pair
SHORT, GLUE = 3, 2.0  #: most characters of a short token; cost in nats of a space put into a word, if not between single characters
END = "\n"
KEPT = 64
LETTER = re.compile(r"[^\W\d_]")
#: A letter and, later in the word, one of MARKED; one of MARKING and, later, a letter; or NOISE anywhere.
MARKED, MARKING = re.compile(r"[^\w\s,.;:?\"')\]*&%#!-]|\d"), re.compile(r"[^\w\s,.;:?\"'(\[*&%#-]|\d")
NOISE = re.compile(r"([^\W\d_])\1\1|[^\W\d_](?:[*._\-!][^\W\d_]){2}|[^\W\d_]!+[^\W\d_]")
LETTERLESS, INNER = re.compile(r"[0-9@$!|+€£(<¡]{3,}"), re.compile(r"[@$!|+€£¡]")
HEAD, TAIL, TAIL_RUN = re.compile(r"[^\w@$€£|(<+¡!]*"), re.compile(r"[^\w@$€£|]*"), re.compile(r"([^\w\s])\1{2,}")


def noisy(word: str) -> bool:
    """Whether a lower-case word may need decoding; a word of signs and digits alone, if it has a sign within. Each pattern is sought once from one place on, so time is linear."""
    if NOISE.search(word) or LETTERLESS.fullmatch(word) and INNER.search(word, 1, len(word) - 1):
        return True
    for part in word.split():
        for first, then in ((LETTER, MARKED), (MARKING, LETTER)):
            if (m := first.search(part)) and then.search(part, m.end()):
                return True
    return False


def trimmed(word: str) -> str:
    """The word without the signs at its edges: those that stand for no letter, then runs of any sign that these hid."""
    for _ in range(2):
        back = word[::-1]
        run = TAIL_RUN.match(back)
        word = word[HEAD.match(word).end() : len(word) - max(TAIL.match(back).end(), run.end() if run else 0)]
    return word


def spaced_out(word: str) -> str | None:
    """i.d.i.o.t, i-d-i-o-t: single characters between equal signs, put together."""
    if len(word) >= 5 and len(word) % 2 == 1 and not word[1].isalnum() and all(c == word[1] for c in word[1::2]) and all(c.isalnum() or c in LEET for c in word[::2]):
        return word[::2]
    return None


class CharModel:
    """Costs, in nats, of a character after another, from counts of bigrams; additive smoothing."""

    def __init__(self, counts: dict[tuple[str, str], int], smooth: float = 0.5) -> None:
        seen: dict[str, int] = {}
        for (a, _), n in counts.items():
            seen[a] = seen.get(a, 0) + n
        self.size = len({b for _, b in counts} | {END}) + 1
        self.cost = {ab: -float(np.log((n + smooth) / (seen[ab[0]] + smooth * self.size))) for ab, n in counts.items()}
        self.unseen = {a: -float(np.log(smooth / (n + smooth * self.size))) for a, n in seen.items()}
        self.new = float(np.log(self.size))

    def __call__(self, a: str, b: str) -> float:
        got = self.cost.get((a, b))
        return got if got is not None else self.unseen.get(a, self.new)


def bigrams(words: list[str], times: list[int]) -> dict[tuple[str, str], int]:
    out: dict[tuple[str, str], int] = {}
    for w, n in zip(words, times, strict=True):
        for ab in zip(END + w, w + END, strict=True):
            out[ab] = out.get(ab, 0) + n
    return out


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point: 1 a letter, 2 what may stand beside a word, 0 any other."""
    out = np.array([chr(c).isalpha() for c in range(0x110000)], np.uint8)
    out[[c for c in range(0x3100) if chr(c).isspace() or chr(c) in ".,;:?\"'()[]-\u201c\u201d\u2018\u2019\u2013\u2014\u3002\u3001"]] = 2
    return out


class PairCounter:
    """Counts of character bigrams within words, END at their edges. A word is a run of letters in lower case between
    spaces, punctuation or the text's ends, so that words with look-alikes in them don't count."""

    def __init__(self) -> None:
        self.place = np.full(0x110000, -1, np.int32)
        self.place[ord(END)] = 0
        self.chars = [ord(END)]
        self.counts = np.zeros((1, 1), np.int64)
        self.rare: dict[tuple[int, int], int] = {}

    def add(self, text: str) -> None:
        c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds()[c]
        letter = kind == 1
        begin = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        clean = (kind[begin - 1] == 2) & (kind[end] == 2)
        begin, end = begin[clean], end[clean]
        inside = np.zeros(len(c) + 1, np.int8)
        inside[begin] = 1
        inside[end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        for x in np.unique(c[inside & (self.place[c] < 0)]).tolist():
            self.place[x] = len(self.chars)
            self.chars.append(x)
        at = np.where(inside, self.place[c], 0)
        pairs = inside[1:] | inside[:-1]
        a, b = at[:-1][pairs], at[1:][pairs]
        n = min(len(self.chars), 1024)
        if n > len(self.counts):
            grown = np.zeros((n, n), np.int64)
            grown[: len(self.counts), : len(self.counts)] = self.counts
            self.counts = grown
        some = (a < n) & (b < n)
        self.counts += np.bincount(a[some].astype(np.int64) * n + b[some], minlength=n * n).reshape(n, n)
        for x, y in zip(a[~some].tolist(), b[~some].tolist(), strict=True):
            self.rare[x, y] = self.rare.get((x, y), 0) + 1

    def rows(self) -> list[tuple[str, str, int]]:
        x, y = np.nonzero(self.counts)
        found = [*zip(x.tolist(), y.tolist(), self.counts[x, y].tolist(), strict=True), *((a, b, n) for (a, b), n in self.rare.items())]
        return [(chr(self.chars[a]), chr(self.chars[b]), n) for a, b, n in found]


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters: (what it may have been, cost)."""
    out = []
    for m in re.finditer(r"(.)\1*", word, re.DOTALL):
        c, k = m[1], len(m[0])
        letters = LEET.get(c, c if c.isalpha() else "")
        base = 0.0 if c.isalpha() else SWAP
        ways = []
        for x in letters:
            if k == 1:
                ways.append((x, base))
            elif k == 2:
                ways += [(x * 2, base), (x, base + ONCE)]
            else:
                ways += [(x, base), (x * 2, base + TWICE)]
        if not c.isalpha():
            ways.append(("", DROP if letters else 0.5))
        out.append(ways)
    return out


def viterbi(parts: list[list[tuple[str, float]]], model: CharModel) -> str:
    """What the cheapest path through the parts spells. Paths are kept as linked pairs, so that long ones take no copies."""
    best: dict[str, tuple[float, tuple | None]] = {END: (0.0, None)}
    for ways in parts:
        step: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, path) in best.items():
            for out, price in ways:
                total, at = cost + price, last
                for c in out:
                    total += model(at, c)
                    at = c
                if at not in step or total < step[at][0]:
                    step[at] = (total, (path, out) if out else path)
        best = step
    _, _, path = min((cost + model(last, END), last, path) for last, (cost, path) in best.items())
    out: list[str] = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def restore_word(word: str, model: CharModel) -> str:
    """The likeliest original of a lower-case word."""
    if not noisy(word):
        return word
    bare = trimmed(word)
    bare = spaced_out(bare) or bare
    return viterbi(lattice(bare), model)


def short(word: str) -> str:
    """A lower-case token without the signs at its edges, if it is a single character or at most SHORT that hold a letter;
    otherwise nothing."""
    bare = word if len(word) == 1 else trimmed(word)
    if 0 < len(bare) <= SHORT and all(c.isalpha() or c in LEET for c in bare) and (len(bare) == 1 or any(c.isalpha() for c in bare)):
        return bare
    return ""


def glued(a: str, b: str, price: float, model: CharModel) -> bool:
    """Whether no space is likelier than one between the letters a and b."""
    return price + model(a, b) < model(a, END) + model(END, b)


def respaced(tokens: tuple[str, ...], model: CharModel) -> list[str]:
    """The likeliest words of a run of short tokens: every space is one of the text, or was put into a word."""
    parts: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(tokens):
        n = 1
        while len(tokens[k]) == 1 and k + n < len(tokens) and tokens[k + n] == tokens[k]:
            n += 1
        group = lattice(tokens[k] * n)
        if n > 1:
            group[0] = group[0] + [(x + END + x, cost) for x, cost in group[0] if len(x) == 1]
        if k:
            parts.append([("", 0.0 if len(tokens[k - 1]) == len(tokens[k]) == 1 else GLUE), (END, 0.0)])
        parts += group
        k += n
    return [w for w in viterbi(parts, model).split(END) if w]


def restorer(model: CharModel):
    """restore_word() that keeps the results of words of up to KEPT characters, so that what it keeps is bounded."""
    one = lru_cache(50_000)(lambda w: restore_word(w, model))
    either = lambda w: one(w) if len(w) <= KEPT else restore_word(w, model)
    either.model = model
    return either


def restore(text: str | None, model: CharModel) -> str:
    """The restored text, in lower case: words decoded, and runs of short tokens put together where that is likelier."""
    out: list[str] = []
    run: list[tuple[str, str]] = []
    one = restorer(model)

    def flush() -> None:
        out.extend(respaced(tuple(b for _, b in run), model) if len(run) > 1 and any(c.isalpha() for _, b in run for c in b) else [one(w) for w, _ in run])
        run.clear()

    for w in (text or "").lower().split():
        if bare := short(w):
            run.append((w, bare))
        else:
            flush()
            out.append(one(w))
    flush()
    return " ".join(w for w in out if w)
