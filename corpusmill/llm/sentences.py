"""Sentence units across languages and scripts: a linear-chain tagger over characters, with Viterbi decoding.

Every character of a line is tagged boundary (a unit begins here) or inside. What is learnt, all without labels:

* Emission at a mark: the odds of a class (mark, kind of what follows, blank between) come from how lines begin and end in
  the whole corpus, as a line feed always ends a unit; a period's odds also from the word before it, by how often that word
  and its period stand at a line's end (abbreviations, ordinals and initials never do).
* Emission where there is no mark: a log-linear model of the words on both sides (in scripts without blanks every character
  is one), fitted on a bounded sample of texts whose marks are taken out and whose boundaries the marks had given away.
* A text's style, the share of its boundaries that carry no mark, is a state that doesn't change within the text: texts
  with all marks, with some and without are decoded by one model.
* Transitions: how much more or less often a boundary follows another after 1 .. NEAR characters than by chance.

The chain forbids boundaries within a quotation; characters inside a word of a script with blanks can't begin a unit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import lm
from corpusmill.llm.lookalike import _SILENT, BLANKS, FORMS, _look, ignorable

#: Marks that can end a sentence, marks of ellipsis, quotation marks with what closes them.
ENDS = ".!?。！？؟।۔"
CLOSES = {"“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』", '"': '"', "»": "«"}
BRACKETS = {"(": ")", "（": "）", "[": "]"}
#: Share of a usual word's periods that stand at the end of a line, if the corpus has no line ends to tell.
LINE_END = 0.12
#: Texts of each kind (with and without characters of scripts that have no blanks) to which the model of unmarked places is
#: fitted, and the longest of them; size of its table; passes; highest odds that it may give.
SAMPLE, SAMPLE_CHARS, BITS, EPOCHS, HIGHEST = 8000, 800, 18, 8, 6.0
#: Styles: share of boundaries without a mark, and how usual each style is.
STYLES = ((1e-4, 0.98), (0.5, 0.01), (0.98, 0.01))
#: Characters since the last boundary up to which the chain tells how long ago it was.
NEAR = 8
#: Scripts that are written without blanks between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))


class _Plain(dict):
    """One plain character for each, found when it is first asked for; a table for str.translate."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if not ch.isascii() and ch != "…":
            ch = " " if BLANKS.match(ch) else unicodedata.normalize("NFKC", ch) if FORMS.match(ch) and ch not in "！？：；，。" else _look(ch)
        got = self[code] = ch[:1] or " "
        return got


_PLAIN = _Plain()
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0711-\u109f\u135d-\u135f\u1712-\u1dff\u20d0-\u20ff\u2cef-\u2dff\u302a-\u302f\u3099\u309a\ua66f-\uabed\ufb1e\ufe20-\ufe2f\U00010000-\U0010ffff]")


def plain(text: str) -> tuple[str, Sequence[int]]:
    """The text without ignorables and with look-alikes as one letter each, and the offset of every character kept."""
    if text.isascii():
        return text, range(len(text))
    if not _SILENT.search(text) and not _MARKS.search(text):
        return text.translate(_PLAIN), range(len(text))
    out, at = [], []
    for i, ch in enumerate(text):
        if ch.isascii():
            out.append(ch)
            at.append(i)
        elif not ignorable(ch) and not unicodedata.combining(ch):
            out.append(_PLAIN[ord(ch)])
            at.append(i)
        elif out and unicodedata.combining(ch):
            both = unicodedata.normalize("NFC", out[-1] + ch)
            out[-1] = both if len(both) == 1 else out[-1]
    return "".join(out), at


_ELLIPSIS = re.compile(r"\.{2,}|…+")
def _before(line: str, k: int) -> str:
    """The word that ends right before the mark at k, of any length; 0 for digits; Han characters give the last one."""
    j = k
    while j > 0 and line[j - 1].isalpha():
        j -= 1
    if j == k:
        return "0" if k and line[k - 1].isdigit() else ""
    w = line[j:k].lower()
    return w[-1] if lm.is_han(w[-1]) else w


class Place:
    """A place where a unit may end: end of the mark (and of closing marks), start of what follows, the word before, mark and kind of what follows."""

    __slots__ = ("end", "next", "token", "mark", "after")

    def __init__(self, end: int, nxt: int, token: str, mark: str, after: str):
        self.end, self.next, self.token, self.mark, self.after = end, nxt, token, mark, after


def _kind(line: str, k: int) -> str:
    """What follows: E the end of the line, l a small letter, u any other letter, d a digit, p a mark."""
    if k >= len(line):
        return "E"
    ch = line[k]
    if ch.isdigit():
        return "d"
    if ch.isalpha():
        return "l" if ch.islower() else "u"
    return "q" if ch in CLOSES or ch in "¿¡(" else "p"


def places(line: str) -> tuple[list[Place], list[tuple[int, int]]]:
    """The places of a line (without line feed) after a mark that may end a unit, and the spans of quotations and brackets, in which none does."""
    skip: set[int] = set()
    for m in _ELLIPSIS.finditer(line):
        skip.update(range(*m.span()))
    out: list[Place] = []
    closed: list[tuple[int, int]] = []
    n, done = len(line), 0
    for hit in _NOTED.finditer(line):
        k = hit.start()
        if k < done:
            continue
        ch = line[k]
        if ch in CLOSES or ch in BRACKETS:
            close = CLOSES.get(ch) or BRACKETS[ch]
            e = line.find(close, k + 1)
            if e > 0 and not (ch == "»" and line[e - 1 : e].isspace()):
                closed.append((k + 1, e + 1))
                inner = line[e - 1 : e] if not line[e - 1 : e].isspace() else line[e - 2 : e - 1]
                done = e + 1
                if ch in CLOSES and inner and inner in ENDS and e - k > 2:
                    j = e + 1
                    while j < n and line[j] in ENDS:
                        j += 1
                    nx = j
                    while nx < n and line[nx].isspace():
                        nx += 1
                    out.append(Place(j, nx, "”", inner, _kind(line, nx)))
                    done = j
            continue
        if k not in skip:
            j = k + 1
            while j < n and line[j] in ENDS and j not in skip:
                j += 1
            while j < n and line[j] in ")）]":
                j += 1
            nx = j
            while nx < n and line[nx].isspace():
                nx += 1
            out.append(Place(j, nx, _before(line, k), ch, _kind(line, nx)))
            done = j
    return out, closed


_NOTED = re.compile("[" + re.escape(ENDS + "".join(CLOSES) + "".join(BRACKETS)) + "]")


def _class(p: Place) -> str:
    """Class of a place: closing quotation, period, or another mark; kind of what follows; whether a blank lies between."""
    return ("”" if p.token == "”" else "." if p.mark == "." else "!") + p.after + ("b" if p.next > p.end else "")


def evidence(text: str) -> list[str]:
    """Units that training counts: each word before a period with what follows, classes of places, and how lines begin."""
    out: list[str] = []
    for line in plain(text)[0].split("\n"):
        line = line.strip()
        if not line:
            continue
        out.append("\x06" + _kind(line, 0))
        for p in places(line)[0]:
            out.append("\x05" + _class(p))
            if p.mark == "." and p.token != "”":
                out.append(f"{p.token}\x02{'E' if p.after == 'E' else 'l' if p.after in 'ldp' else 'u'}")
                out.append("\x02E" if p.after == "E" else "\x02o")
    return out


class Bare:
    """Odds of a boundary where there is no mark, from the words on both sides; words and characters by numpy, a batch at a time."""

    #: of each feature the places of its words, relative to the boundary, and whether it tells a capital after it
    SHAPES = (
        ((), True), ((-1,), False), ((-1,), True), ((-2, -1), False), ((-3, -2, -1), False), ((-4, -3, -2, -1), False), ((0,), True), ((0, 1), True), ((0, 1, 2), False), ((0, 1, 2, 3), False),
        ((-1, 0), True), ((-2, -1, 0, 1), False), ((-2, -1, 0), False), ((-1, 0, 1), False),
    )

    def __init__(self, weights: np.ndarray | None = None, bias: float = -20.0):
        self.weights, self.bias = weights, bias

    _kinds: np.ndarray | None = None

    @classmethod
    def kinds(cls) -> np.ndarray:
        """0 blank, 1 letter or digit, 2 letter of a script without blanks, 3 mark, 4 line feed, for code points up to 0xFFFF."""
        if cls._kinds is None:
            k = np.full(1 << 16, 3, dtype=np.uint8)
            for c in range(1 << 16):
                ch = chr(c)
                if ch.isspace():
                    k[c] = 0
                elif ch.isalnum() or ch == "_" or unicodedata.combining(ch):
                    k[c] = 1
            for lo, hi in UNSPACED:
                k[lo : hi + 1] = np.where(k[lo : hi + 1] == 1, 2, k[lo : hi + 1])
                for c in range(lo, hi + 1):
                    if k[c] == 3 and unicodedata.category(chr(c))[0] == "M":
                        k[c] = 2
            k[10] = 4
            cls._kinds = k
        return cls._kinds

    def words(self, flat: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: where it begins and ends, its hash (the last bit tells a capital), and whether a boundary may precede it: 0 no, 1 yes, 2 with a mark between."""
        low = flat.lower()
        if len(low) != len(flat):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in flat)
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = np.where(codes < 1 << 16, self.kinds()[np.minimum(codes, (1 << 16) - 1)], np.where(codes < 0x1F000, 1, 3)).astype(np.uint8)
        kind[(codes >= 0x20000) & (codes < 0x32000)] = 2
        held = np.flatnonzero((kind == 1) | (kind == 2) | (kind == 4))
        if not len(held):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.astype(np.uint64), none
        hk = kind[held]
        opens = np.ones(len(held), dtype=bool)
        opens[1:] = (hk[1:] != 1) | (hk[:-1] != 1) | (np.diff(held) > 1)
        at = np.flatnonzero(opens)
        offset = np.arange(len(held)) - at[np.cumsum(opens) - 1]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(64, _PRIME, dtype=np.uint64))
            h = np.add.reduceat((codes[held].astype(np.uint64) + np.uint64(7)) * power[np.minimum(offset, 63)], at)
        start = held[at]
        real = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[start]
        h = (h & ~np.uint64(1)) | (real != codes[start]).astype(np.uint64)
        end = held[np.append(at[1:], len(held)) - 1] + 1
        can = np.ones(len(at), dtype=np.int64)
        newline = hk[at] == 4
        can[newline] = 0
        can[0] = 0
        can[1:][newline[:-1]] = 0
        marks = np.concatenate([[0], np.cumsum(kind == 3)])
        between = marks[start[1:]] - marks[end[:-1]] > 0
        can[1:] = np.where((can[1:] == 1) & between, 2, can[1:])
        return start, end, h, can

    def features(self, h: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Buckets of each feature (columns) for the words which (rows)."""
        pad = np.concatenate([np.zeros(4, dtype=np.uint64), h, np.zeros(4, dtype=np.uint64)])
        capital = pad & np.uint64(1)
        pad = pad & ~np.uint64(1)
        out = np.empty((len(which), len(self.SHAPES)), dtype=np.int32)
        with np.errstate(over="ignore"):
            for f, (shape, cased) in enumerate(self.SHAPES):
                x = np.full(len(which), 2 * f + 1, dtype=np.uint64)
                if cased:
                    x += capital[which + 4]
                for d in shape:
                    x = (x ^ pad[which + 4 + d]) * _PRIME
                    x ^= x >> np.uint64(29)
                out[:, f] = (x * _PRIME >> np.uint64(64 - BITS)).astype(np.int32)
        return out

    def odds(self, flat: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin that a boundary may precede, its log odds in a text without marks, and whether a mark lies between."""
        start, _, h, can = self.words(flat)
        which = np.flatnonzero(can > 0)
        if self.weights is None or not len(which):
            return start[which], np.full(len(which), self.bias), can[which] == 2
        got = self.weights[self.features(h, which)].sum(axis=1) + self.bias
        return start[which], np.minimum(got, HIGHEST), can[which] == 2

    @classmethod
    def fit(cls, texts: list[tuple[str, list[int]]]) -> Bare:
        """Fitted to texts with the offsets of their units: logistic regression by AdaGrad on batches, the marks passed over."""
        self = cls(np.zeros(1 << BITS, dtype=np.float32), 0.0)
        xs, ys = [], []
        texts = [texts[k] for k in np.random.default_rng(3).permutation(len(texts))]
        for lo in range(0, len(texts), 500):
            part = texts[lo : lo + 500]
            flat, cuts, base = [], [], 0
            for t, starts in part:
                flat.append(t)
                cuts += [base + k for k in starts]
                base += len(t) + 1
            start, end, h, can = self.words("\n".join(flat))
            which = np.flatnonzero(can > 0)
            if not len(which):
                continue
            cut = np.array(sorted(cuts), dtype=np.int64)
            # a unit may begin with a mark: what counts is whether one begins between the word before and this one
            label = np.searchsorted(cut, start[which], side="right") - np.searchsorted(cut, end[which - 1], side="left") > 0
            xs.append(self.features(h, which))
            ys.append(label)
        if not xs:
            return cls()
        x, y = np.concatenate(xs), np.concatenate(ys).astype(np.float32)
        # the texts come in batches of mixed languages; a tenth of the rows at the end sets the threshold
        kept = max(1, len(y) - len(y) // 10)
        held, held_y, x, y = x[kept:], y[kept:] > 0, x[:kept], y[:kept]
        rng = np.random.default_rng(5)
        w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
        rate = float(np.clip(y.mean(), 1e-4, 0.5))
        bias = bias0 = float(np.log(rate / (1 - rate)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), 4096):
                rows = order[lo : lo + 4096]
                p = 1 / (1 + np.exp(-(w[x[rows]].sum(axis=1) + bias)))
                err = p - y[rows]
                g = np.bincount(x[rows].ravel(), np.repeat(err, x.shape[1]), 1 << BITS)
                g2 += g * g
                w -= 0.3 * (g / np.sqrt(g2) + 1e-3 * w * (g != 0))
                bias -= 0.01 * float(err.mean())
        bias = float(np.clip(bias, bias0 - 3, bias0 + 3))
        if held_y.any():
            got = w[held].sum(axis=1) + bias
            shifts = np.arange(-1.0, 2.01, 0.25)
            hits = np.array([2 * (held_y & (got + k > 0)).sum() / (held_y.sum() + (got + k > 0).sum()) for k in shifts])
            bias += float(shifts[int(hits.argmax())])
        return cls(w.astype(np.float32), bias)


_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Splitter:
    """starts(text): offsets of the first character of each unit."""

    def __init__(self, counts: lm.Counts, bare: Bare | None = None, near: np.ndarray | None = None):
        self.c, self.bare = counts, bare or Bare()
        self.near = np.zeros((2, NEAR + 1)) if near is None else near
        e, o = counts["\x02E"], counts["\x02o"]
        self.end_share = min(0.5, max(0.02, e / (e + o))) if e + o > 50 else LINE_END
        self.memo: dict[tuple[str, str], float] = {}
        self.classes = self._classes()

    def _classes(self) -> dict[str, float]:
        """Log odds of the classes of places.

        A boundary is followed by what begins lines. So of the places after a mark the share that are boundaries is that of
        letters of which most lines begin, against those lines; a class's odds compare what boundaries would give it with
        what it holds. One count is added everywhere, so without a corpus the odds are near those of the lines.
        """
        kinds = "ludqp"
        begin = {a: self.c["\x06" + a] + (20.0 if a == "u" else 1.0 if a in "qd" else 0.02) for a in kinds}
        total = sum(begin.values())
        out: dict[str, float] = {}
        for m in "”.!":
            held = {(a, b): self.c[f"\x05{m}{a}{b}"] + (20.0 if a == "u" and b else 2.0 if a == "u" else 0.5) for a in kinds for b in ("b", "")}
            n = sum(held.values())
            plain_ = {b: held["u", b] for b in ("b", "")}
            share = min(1.0, (sum(plain_.values()) / n) / (begin["u"] / total))
            for (a, b), k in held.items():
                expected = n * share * begin[a] / total * plain_[b] / sum(plain_.values())
                r = min(0.9975, expected / k)
                out[m + a + b] = float(np.log(r / (1 - r)))
        return out

    def odds(self, p: Place) -> float:
        """Log odds of a boundary at the place."""
        if p.after == "E":
            return 50.0
        kind = _class(p)
        if kind[0] != ".":
            return self.classes[kind]
        got = self.memo.get((p.token, kind))
        if got is None:
            ends, small, other = (self.c[f"{p.token}\x02{x}"] for x in "Elu")
            n = ends + small + other
            # n periods after this word, of which `ends` stand at a line's end: more likely for a usual word or for one that is never last?
            never = 0.002
            usual = ends * np.log(self.end_share) + (n - ends) * np.log(1 - self.end_share)
            short = ends * np.log(never) + (n - ends) * np.log(1 - never)
            # a lone letter and a word that small letters follow are no usual last words
            followed = (small + 0.1) / (n + 1.0)
            got = self.classes[kind] + float(np.clip(usual - short, -30, 30)) - 4.0 * followed
            if len(p.token) == 1 and p.token.isalpha() and not lm.is_han(p.token):
                got -= 2.0
            if len(self.memo) < 100_000:
                self.memo[p.token, kind] = got
        return got

    def marked(self, flat: str) -> tuple[list[int], list[tuple[int, float]], list[tuple[int, int]]]:
        """Of a text's lines: where they begin, their places with log odds, and the spans without boundaries."""
        leads, found, closed = [], [], []
        base = 0
        for line in flat.split("\n"):
            lead = len(line) - len(line.lstrip())
            if lead < len(line):
                leads.append(base + lead)
                ps, spans = places(line)
                found += [(base + p.next, self.odds(p)) for p in ps if p.next < len(line)]
                closed += [(base + a, base + b) for a, b in spans]
            base += len(line) + 1
        return leads, found, closed

    def chain(self, flat: str, leads: list[int], found: list[tuple[int, float]]) -> list[int]:
        """Viterbi: the boundaries of the most likely tagging. leads are boundaries; found: other places with their log odds, in order.

        The state at a character is how many characters ago the last boundary was, up to NEAR. Places whose odds no
        transition can lift above 0 are inside in any best tagging and needn't be walked.
        """
        most = float(self.near.max())
        places_ = [(at, s, False) for at, s in found if s + most > 0] + [(at, 0.0, True) for at in leads]
        places_.sort()
        out: list[int] = []
        line: list[tuple[int, float]] = []
        for at, s, opens in places_:
            if opens:
                out += self._line(flat, line)
                line = [(at, 0.0)]
            elif line:
                line.append((at, s))
        return out + self._line(flat, line)

    def _line(self, flat: str, line: list[tuple[int, float]]) -> list[int]:
        if len(line) < 2:
            return [at for at, _ in line]
        best, back = [0.0], [-1]
        far, far_at = -1e18, -1  # the best boundary more than NEAR characters ago
        lo = 0
        for j in range(1, len(line)):
            at, s = line[j]
            near = self.near[int(_unspaced(flat[at]))]
            while lo < j and at - line[lo][0] > NEAR:
                if best[lo] > far or far_at < 0:
                    far, far_at = best[lo], lo
                lo += 1
            top, arg = far, far_at
            for i in range(lo, j):
                v = best[i] + float(near[at - line[i][0]])
                if v > top:
                    top, arg = v, i
            best.append(top + s)
            back.append(arg)
        j = max(range(len(best)), key=lambda k: best[k])
        out = []
        while j >= 0:
            out.append(line[j][0])
            j = back[j]
        return out[::-1]

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Offsets of the units of each text, in code points of the text as it is."""
        flats = [plain(t) for t in texts]
        at, odds, marked = self.bare.odds("\n".join(f for f, _ in flats))
        p = 1 / (1 + np.exp(-odds))
        bounds = np.cumsum([0] + [len(f) + 1 for f, _ in flats])
        cuts = np.searchsorted(at, bounds)
        free = ~marked
        # of each text and style the log likelihood of its places without a mark
        sums = [np.concatenate([[0.0], np.cumsum(np.where(free, np.log1p(-p * (1 - d)), 0.0))]) for d, _ in STYLES]
        out = []
        for k, (flat, offsets) in enumerate(flats):
            leads, found, closed = self.marked(flat)
            a, b = cuts[k], cuts[k + 1]
            n = sum(s > 0 for _, s in found)
            style = [float(x[b] - x[a]) + n * float(np.log1p(-d)) + float(np.log(prior)) for x, (d, prior) in zip(sums, STYLES)]
            share = float(np.log(STYLES[int(np.argmax(style))][0]))
            some = a + np.flatnonzero(free[a:b] & (odds[a:b] + share > -3.0))
            if len(some):
                taken = {x for x, _ in found}
                more = [(int(x), float(s)) for x, s in zip(at[some] - bounds[k], odds[some] + share) if int(x) not in taken and not any(u <= x < v for u, v in closed)]
                found = sorted(found + more)
            out.append(self._kept(texts[k], offsets, self.chain(flat, leads, found)))
        return out

    def _kept(self, text: str, at: Sequence[int], starts: list[int]) -> list[int]:
        out = []
        for s in starts:
            k = at[s]
            # ignorables right before the first letter belong to the unit, if a blank or line feed precedes them
            while k > 0 and not text[k - 1].isspace() and not (s and k - 1 == at[s - 1]) and text[k - 1] not in ENDS:
                k -= 1
            out.append(k)
        return out

    def starts(self, text: str) -> list[int]:
        """0-based offsets, in code points of the text as it is; none for an empty or blank text."""
        return self.batch([text])[0]

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each unit, without the blanks at its end."""
        return unit_spans(text, self.starts(text))


def unit_spans(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """(start, end) of each unit, without the blanks at its end; a unit ends at its line's end."""
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        body = text[a:b].split("\n")[0]
        out.append((a, a + len(body.rstrip())))
    return out


def _unspaced(ch: str) -> bool:
    return any(lo <= ord(ch) <= hi for lo, hi in UNSPACED)


def _near(texts: list[tuple[str, list[int]]]) -> np.ndarray:
    """Log of how often a boundary follows another after k characters, against a chain without memory; k beyond NEAR has 0.

    A row for scripts with blanks and one for those without, whose units differ in length.
    """
    gaps: tuple[list[int], list[int]] = ([], [])
    for t, starts in texts:
        for a, b in zip(starts, starts[1:]):
            gaps[int(_unspaced(t[b]))].append(b - a)
    out = np.zeros((2, NEAR + 1))
    for row, got in zip(out, gaps):
        if got:
            g = np.array(got, dtype=np.int64)
            rate = 1 / max(1.0, float(g.mean()))
            chance = len(g) * rate * (1 - rate) ** np.maximum(np.arange(NEAR + 1) - 1, 0)
            row[:] = np.clip(np.log((np.bincount(np.minimum(g, NEAR + 1), minlength=NEAR + 2)[: NEAR + 1] + 0.5) / (chance + 0.5)), -6, 0)
    return out


def train(texts: DataFrame, col: str = "text", sample: int = SAMPLE) -> Splitter:
    """A splitter with the counts of all rows; unmarked places are fitted to `sample` texts of each kind, the ones with the smallest hashes."""
    first = Splitter(lm.count_units(texts, col, evidence))
    short = texts.where(F.col(col).isNotNull() & (F.length(col) <= SAMPLE_CHARS)).select(F.col(col).alias("t"))
    unspaced = F.col("t").rlike("[" + "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in UNSPACED) + "]")
    h = F.xxhash64("t")
    rows = short.select("t", unspaced.alias("u"), h.alias("h")).distinct()
    got = [r["t"] for part in (rows.where("u"), rows.where("NOT u")) for r in part.orderBy("h", "t").limit(sample).collect()]
    flat = [plain(t)[0] for t in got]
    known = [(f, first.chain(f, *first.marked(f)[:2])) for f in flat]
    return Splitter(first.c, Bare.fit(known), _near(known))


def unit_starts(text: Column, splitter: Splitter) -> Column:
    """array<int> of the offsets of the units; empty for null, empty and blank texts."""

    @F.pandas_udf("array<int>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(splitter.batch([t if isinstance(t, str) else "" for t in s]), dtype=object)

    return run(text)
