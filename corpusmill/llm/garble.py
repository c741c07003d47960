"""Text decoded with a wrong character encoding: found and restored by noisy-channel decoding.

A channel is a pair of encodings: the text was written in one and read in another. For every stretch of text that holds
characters beyond ASCII each channel offers a reading: the characters are turned back into bytes, with wildcards for the
bytes that were lost, and the bytes are read in the true encoding. A Viterbi search over the stretches picks a reading
for each (as it stands, or by a channel) under the word frequencies of the whole corpus; changing the channel costs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import lattice, lm
from corpusmill.llm.lookalike import skeleton, surface

#: Fixed values: (true encoding, encoding it was read in, times).
CHANNELS = (
    ("utf-8", "cp1252", 1),
    ("utf-8", "cp1252", 2),
    ("utf-8", "cp1251", 1),
    ("utf-8", "mac_roman", 1),
    ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1),
    ("utf-8", "gb18030", 1),
    ("cp1252", "cp850", 1),
    ("cp1252", "cp437", 1),
    ("cp1252", "cp1250", 1),
    ("cp1252", "cp1251", 1),
    ("cp1252", "mac_roman", 1),
    ("mac_roman", "cp1252", 1),
    ("cp850", "cp1252", 1),
    ("cp1256", "cp1252", 1),
    ("iso8859-6", "cp1252", 1),
    ("big5", "cp1252", 1),
    ("gb18030", "cp1252", 1),
)
LOST = lattice.LOST
#: Log odds by which a channel's reading must beat the text as it stands (a valid multi-byte sequence is evidence in itself,
#: so such channels need less), and what a change of channel costs.
MARGIN, MARGIN_UTF8, SWITCH = 1.5, 0.3, 1.0


@lru_cache(maxsize=64)
def to_byte(codec: str) -> dict[str, int]:
    """Byte of each character of a single-byte encoding; bytes that it leaves undefined stand for themselves, as browsers read them."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":  # texts read as Latin-1 keep the control characters
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


_WIDE = {"gb18030"}


def _unread(text: str, wrong: str) -> list[bytes | None]:
    """The bytes of each character in the encoding it was read in; None where it has none."""
    if wrong in _WIDE:
        out: list[bytes | None] = []
        for ch in text:
            try:
                out.append(ch.encode(wrong))
            except UnicodeEncodeError:
                out.append(None)
        return out
    table = to_byte(wrong)
    return [bytes([table[ch]]) if ch in table else None for ch in text]


#: A lead of three bytes read in Latin-1 and what is left of the two after it.
_THIN = re.compile("[\xe0-\xef][\x80-\xbf]{0,2}")


def _lead_chars(wrong: str, lo: int, hi: int) -> str:
    return "".join(re.escape(c) for c, b in to_byte(wrong).items() if lo <= b <= hi)


#: A lead byte (and for three bytes its first continuation) that no further byte follows, and what took the lost byte's place.
_BROKEN = {
    w: re.compile(
        f"(?P<lead>[{_lead_chars(w, 0xC2, 0xDF)}]|[{_lead_chars(w, 0xE1, 0xEF)}][{_lead_chars(w, 0x80, 0xBF)}])(?:[?{LOST} ]|$)"
    )
    for w in {c[1] for c in CHANNELS if c[0] == "utf-8" and c[1] != "gb18030"}
}
_SEQ = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _utf8(raw: list[bytes | None], text: str) -> str | None:
    """Valid multi-byte sequences read as UTF-8, everything else as it stands; None if there is no such sequence."""
    flat = b"".join(x if x is not None else b"\x00" for x in raw)
    seqs = list(_SEQ.finditer(flat))
    if not seqs:
        return None
    start_of = {}  # byte offset -> index of the character that begins there
    at = 0
    for k, x in enumerate(raw):
        start_of[at] = k
        at += len(x) if x is not None else 1
    start_of[at] = len(raw)
    # sequences of a wide encoding may share a character; whole stretches of sequences are taken together
    out, done, k = [], 0, 0
    while k < len(seqs):
        a, b = seqs[k].span()
        got = [seqs[k].group()]
        while b not in start_of and k + 1 < len(seqs) and seqs[k + 1].start() == b:
            k += 1
            got.append(seqs[k].group())
            b = seqs[k].end()
        k += 1
        if a not in start_of:
            continue
        if b not in start_of:  # the last character was cut in two: its lost half is a wildcard
            b = next(x for x in range(b, at + 1) if x in start_of)
        try:
            piece = b"".join(got).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if start_of[a] < done:
            continue
        out.append(text[done : start_of[a]])
        out.append(piece)
        done = start_of[b]
    if not done:
        return None
    return "".join(out) + text[done:]


def read_through(text: str, channel: tuple[str, str, int]) -> str | None:
    """The text as its true encoding reads it, or None if the channel can't have produced it."""
    true, wrong, times = channel
    for _ in range(times):
        raw = _unread(text, wrong)
        if true == "utf-8":
            got = _utf8(raw, text)
        elif true in ("big5", "gb18030"):
            if any(x is None for x in raw):
                return None
            got = b"".join(raw).decode(true, "replace")  # type: ignore[arg-type]
            if got.count(LOST) * 4 > len(got):
                return None
        else:
            got = "".join(x.decode(true, "replace") if x is not None and not ch.isascii() else ch for x, ch in zip(raw, text))
        if got is None or got == text:
            return None
        text = got
    return text


def _side(ch: str) -> str:
    return "D" if ch.isdigit() else "L" if ch.isalpha() else "S" if not ch or ch.isspace() else "P"


def touched(text: str) -> list[str]:
    """Units that hold characters beyond ASCII: words, Han characters, and marks or lone letters with the kinds of their neighbours."""
    out = []
    for m in _UNIT.finditer(text):
        u = m.group()
        if u.isascii():
            continue
        if len(u) == 1 and not lm.is_han(u):
            out.append(f"\x01{_side(text[m.start() - 1 : m.start()])}{u.lower()}{_side(text[m.end() : m.end() + 1])}")
        else:
            out.append(u.lower())
    return out


class Restorer:
    """Finds and restores garbled stretches under the word frequencies of the corpus."""

    def __init__(self, counts: lm.Counts, alphabet: dict[str, float], reader: lattice.Reader | None = None):
        self.counts, self.alphabet, self.reader = counts, alphabet, reader
        self.memo: dict[str, float] = {}
        self.fits: dict[int, list[tuple[str, bytes]]] | None = None
        self.read: dict[str, list[tuple[int, str, float]]] = {}
        self.lost = False  # whether the text decoded last has lost bytes

    def unit(self, u: str) -> float:
        """Log frequency of a unit; for one that the corpus hardly knows, at least what its characters earn."""
        got = self.memo.get(u)
        if got is None:
            beyond = [self.alphabet.get(c, 0.0) for c in u.lstrip("\x01DLSP") if not c.isascii()]
            back = float(np.mean(np.log(np.array(beyond) + 1e-3))) if beyond else 0.0
            got = max(float(np.log(self.counts[u] + 0.3)), 0.5 * back - 1.0) if min(beyond, default=1.0) > 0 else -7.0
            if len(self.memo) < 300_000:
                self.memo[u] = got
        return got

    def score(self, text: str) -> float:
        """Mean log frequency of the units that hold characters beyond ASCII."""
        got = [self.unit(u) for u in touched(text)]
        return sum(got) / len(got) if got else 0.0

    def readings(self, piece: str) -> list[tuple[int, str, float]]:
        """(channel, reading, score) of the readings that the corpus can explain; channel -1 is the text as it stands."""
        got = self.read.get(piece)
        if got is None:
            got = self._readings(piece)
            if len(self.read) < 100_000 and len(piece) < 200:
                self.read[piece] = got
        return got

    def _readings(self, piece: str) -> list[tuple[int, str, float]]:
        mine = self.score(piece)
        typed = skeleton(surface(piece))
        if typed == piece:
            typed = None
        elif typed.isascii() and typed.strip():
            return [(-1, piece, mine)]  # typed in look-alikes or with ignorables
        else:
            mine = max(mine, self.score(typed))
        out = [(-1, piece, mine)]
        for k, channel in enumerate(CHANNELS):
            got = read_through(piece, channel)
            if got is None and channel[0] == "utf-8" and channel[1] not in _WIDE:
                got = self.completed(piece, channel)
            if channel == CHANNELS[0] and (thin := self.thinned(piece)) is not None:
                got = thin
            if got is None or LOST in got and LOST not in piece:
                continue
            if typed is not None and skeleton(surface(got)) == typed:
                continue
            if any(self.alphabet.get(c, 0.0) <= 0 and not c.isascii() for c in set(got) - set(piece)):
                continue
            s = self.score(got)
            if got.replace("\xa0", " ").isascii() or s > mine:
                out.append((k, got, s))
        return out

    def thinned(self, piece: str) -> str | None:
        """A reading for three-byte characters of which control bytes were dropped: each takes the likeliest character that fits what is left."""
        groups = list(_THIN.finditer(piece))
        beyond = sum(not c.isascii() for c in piece)
        if len(groups) < 3 or sum(len(m.group()) for m in groups) < 0.85 * beyond or all(len(m.group()) == 3 for m in groups):
            return None
        if self.fits is None:
            self.fits = {}
            for ch, n in sorted(self.alphabet.items(), key=lambda x: (-x[1], x[0])):
                raw = ch.encode("utf-8", "surrogatepass")
                if len(raw) == 3:
                    self.fits.setdefault(raw[0], []).append((ch, raw[1:]))
        out, done = [], 0
        for m in groups:
            lead, rest = ord(m.group()[0]), bytes(ord(c) for c in m.group()[1:])
            ch = next((c for c, tail in self.fits.get(lead, []) if rest == tail or (len(rest) < 2 and all(b in tail for b in rest))), None)
            if ch is None:
                return None
            out += [piece[done : m.start()], ch]
            done = m.end()
        return "".join(out) + piece[done:]

    def completed(self, piece: str, channel: tuple[str, str, int]) -> str | None:
        """A reading for a stretch whose sequences lost their last byte: the lead bytes and a wildcard, filled by the likeliest character."""
        true, wrong, times = channel
        if times > 1:
            return None
        at, filled = 0, False
        while m := _BROKEN[wrong].search(piece, at):
            head = b"".join(x for x in _unread(m.group("lead"), wrong) if x)
            best = None
            for last in range(0x80, 0xC0):
                try:
                    ch = (head + bytes([last])).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if self.alphabet.get(ch, 0.0) > 0:
                    got = piece[: m.start()] + ch + piece[m.end() :]
                    s = self.score(got)
                    if best is None or s > best[0]:
                        best = (s, got)
            if best:
                piece, at, filled = best[1], m.start() + 1, True
            else:
                at = m.end()
        return piece if filled else None

    def decode(self, text: str) -> tuple[str, int]:
        """The restored text and the number of garbled stretches, by Viterbi search over the stretches."""
        if text.isascii():
            return text, 0
        pieces = [m.span() for m in _STRETCH.finditer(text)]
        columns = [self.readings(text[a:b]) for a, b in pieces]
        best: list[dict[int, tuple[float, int | None]]] = []
        for col in columns:
            here: dict[int, tuple[float, int | None]] = {}
            for ch, _, s in col:
                s = s - (0.0 if ch < 0 else MARGIN_UTF8 if CHANNELS[ch][0] == "utf-8" else MARGIN)
                if not best:
                    here[ch] = (s, None)
                    continue
                prev, p = max((v[0] - (0.0 if q == ch or ch < 0 or q < 0 else SWITCH), q) for q, v in best[-1].items())
                here[ch] = (prev + s, p)
            best.append(here)
        garbled, states = 0, [0] * len(pieces)
        state = max(best[-1], key=lambda q: best[-1][q][0]) if best else None
        for k in range(len(pieces) - 1, -1, -1):
            states[k] = state
            state = best[k][state][1]
        used = {CHANNELS[q] for q in states if q >= 0}
        parts: list[tuple[str, str, tuple]] = []  # what lies before the stretch, its reading, the channels through which it is torn
        done = 0
        for (a, b), col, q in zip(pieces, columns, states):
            got = next(r for r in col if r[0] == q)[1]
            garbled += LOST in got or q >= 0
            lost = torn(text[a:b], {CHANNELS[q]}) if q >= 0 else tuple(c for c in torn(text[a:b], used) if _BROKEN[c[1]].search(text[a:b]))
            parts.append((text[done:a], got, lost))
            done = b
        self.lost = garbled > 0 and (LOST in text or any(p[2] for p in parts))
        if self.reader is not None and garbled and LOST in text:
            return self.reader.restore(text, lambda part: self.decode(part)[0]), garbled
        out: list[str] = []
        skip = 0
        for k, ((a, b), (gap, got, lost)) in enumerate(zip(pieces, parts)):
            out.append(gap[skip:])
            skip = 0
            if lost and self.reader is not None and garbled:
                # a last byte that was a no-break space may have become the blank after the stretch
                skip = int(text[b : b + 1] == " " and any(0xC2 <= to_byte(w).get(text[b - 1], 0) < 0xE0 for _, w in lost))
                after = (parts[k + 1][0] if k + 1 < len(parts) else text[done:])[skip : skip + lattice.ORDER - 1]
                reads = [x for c in lost if (x := self.reader.read(text[a : b + skip], c, "".join(out)[-20:], after)) is not None]
                if reads:
                    got = max(reads)[1]
                else:
                    skip = 0
            out.append(got)
        return "".join(out) + text[done + skip :], garbled


def torn(text: str, used: set[tuple[str, str, int]]) -> tuple[tuple[str, str], ...]:
    """Of the channels used, those of utf-8 read in one byte a character in which sequences of the text have lost bytes."""
    out = []
    for true, wrong, times in sorted(used):
        if true != "utf-8" or wrong in _WIDE or times > 1:
            continue
        flat = b"".join(x if x is not None else b"\x00" for x in _unread(text, wrong))
        rest = _SEQ.sub(b"", flat)
        if any(x >= 0x80 for x in rest):
            out.append((true, wrong))
    return tuple(out)


# stretches: what lies between blanks; East Asian characters part from others and also end after a mark of the sentence
_UNIT = re.compile(rf"[{lm.HAN}]|[^\W\d_{lm.HAN}]+(?:[^\w\s.,;:!?()…\"«»“”„。，；：！？（）、؟،؛][^\W\d_{lm.HAN}]+)*|\d+|[^\w\s]|_")
_CJK = lm.HAN + "\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff9f\ue000-\uf8ff"
_STRETCH = re.compile(rf"[{_CJK}]+?(?:[。！？；，]|(?![{_CJK}]))|[^ \t\r\n\f{_CJK}]*[^\x00-\x7f{_CJK}][^ \t\r\n\f{_CJK}]*")


def corpus_counts(texts: DataFrame, col: str = "text") -> tuple[lm.Counts, dict[str, float]]:
    """Frequencies over all rows, and those of each character, in one pass."""
    alphabet: dict[str, float] = {}
    counts = lm.count_units(texts, col, touched, alphabet=alphabet)
    return counts, alphabet


def restored(text: Column, counts: lm.Counts, alphabet: dict[str, float]) -> Column:
    """struct<text, garbled, lost>: the restored text, the number of garbled stretches and whether bytes are lost; null text gives null and 0.

    Where bytes are lost, see relost.
    """

    @F.pandas_udf("struct<text:string,garbled:int,lost:boolean>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = Restorer(counts, alphabet)
        for s in series:
            rows = []
            for t in s:
                r.lost = False
                rows.append((*(r.decode(t) if isinstance(t, str) else (None, 0)), r.lost))
            yield pd.DataFrame(rows, columns=["text", "garbled", "lost"]).astype({"garbled": "int32"})

    return run(text)


def relost(text: Column, counts: lm.Counts, alphabet: dict[str, float], grams: lattice.Grams) -> Column:
    """The restored text of one with losses, under the character sequences of the legible texts."""
    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Restorer(counts, alphabet, lattice.Reader(grams, alphabet))
        for s in series:
            yield pd.Series([r.decode(t)[0] if isinstance(t, str) else None for t in s], dtype=object)

    return run(text)


def is_garbled(text: Column, counts: lm.Counts, alphabet: dict[str, float]) -> Column:
    """Whether the text holds a garbled sequence; false for null and for ASCII texts, which need no search."""

    @F.pandas_udf("boolean")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Restorer(counts, alphabet)
        for s in series:
            yield pd.Series([isinstance(t, str) and not t.isascii() and r.decode(t)[1] > 0 for t in s], dtype=bool)

    return run(text)
