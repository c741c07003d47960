"""Texts of which decoding lost bytes: a lattice of bytes with a wildcard for each loss, read by a Viterbi search.

A channel (true encoding, encoding it was read in) turns a stretch back into bytes; U+FFFD stands for the bytes that the
reading encoding rejects. Every way through the lattice is a string of characters that the legible texts of the corpus
hold; the search takes the likeliest under their character sequences of up to ORDER, blanks and word ends included. The
number of losses is not bounded. Counts are kept in tables of fixed size, as in lm.py.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LOST = "�"
BITS, ORDER, BLOCK = 20, 6, 1 << 14
#: Ways of a search that are this much (log) below the best at their place are given up, and all but so many.
CUT, WAYS = 9.0, 200
#: Log cost of a character beyond ASCII that stands as it is, and of a loss that nothing fits.
STANDS, UNREAD = -2.5, -14.0
#: Log cost of a byte that came out as nothing.
DROPPED = -1.0
#: (true encoding, encoding it was read in) of texts with losses; utf-8 twice: sequences that were cut off.
CHANNELS = (
    ("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8"), ("cp1256", "utf-8"), ("iso8859-6", "utf-8"), ("big5", "utf-8"), ("gb18030", "utf-8"), ("utf-8", "utf-8"),
    ("utf-8", "gb18030"), ("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"),
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"),
    ("cp1256", "cp1252"), ("iso8859-6", "cp1252"), ("big5", "cp1252"), ("gb18030", "cp1252"),
)
#: Neighbouring words with losses, which are read together.
WINDOW = re.compile(rf"\S*{LOST}\S*(?:\s\S*{LOST}\S*)*")
_P, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_START = " " * (ORDER - 1)


def _codes(text: str) -> np.ndarray:
    """Code points; digits as 0 and blanks as one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    c = np.where((c >= 48) & (c <= 57), 48, c)
    return np.where((c == 9) | (c == 10) | (c == 13), 32, c).astype(np.uint64)


def _times(power: np.uint64) -> np.uint64:
    return np.uint64(int(power) * int(_P) & 0xFFFFFFFFFFFFFFFF)


def _bucket(h: np.ndarray, n: int, row: int) -> np.ndarray:
    h = (h + np.uint64(n)) * _MIX[row]
    h ^= h >> np.uint64(29)
    return ((h * _P) >> np.uint64(64 - BITS)).astype(np.int64)


class Grams:
    """log probabilities of a character after others, from counts of sequences of 1 to ORDER characters."""

    def __init__(self, table: np.ndarray, total: float):
        self.table, self.total = table, max(total, 1.0)

    def count(self, h: np.ndarray, n: int) -> np.ndarray:
        return np.minimum(self.table[0][_bucket(h, n, 0)], self.table[1][_bucket(h, n, 1)]).astype(np.float64)

    def log(self, before: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each row of before (its last ORDER - 1 characters) and each code."""
        one = self.count(codes, 1)
        p = np.repeat(((one + 2e-5) / (self.total + 2.0))[None, :], len(before), axis=0)
        i, j = np.nonzero(np.repeat(one[None, :] > 0, len(before), axis=0))
        h, power = np.zeros(len(before), dtype=np.uint64), np.uint64(1)
        for n in range(2, ORDER + 1):
            h = h + before[:, ORDER - n] * power
            power = _times(power)
            den = self.count(h, n - 1)
            # a sequence can only be known if the one without its first character is
            num = self.count(h[i] * _P + codes[j], n)
            p *= (2.0 / (den + 2.0))[:, None]
            p[i, j] += num / (den[i] + 2.0)
            some = num > 0
            i, j = i[some], j[some]
        p = np.minimum(p, 1.0)
        return np.log(p)


def count_grams(texts: DataFrame, col: str) -> Grams:
    """Counts over texts[col]; what comes to the driver is bounded by the table, which is added up in blocks."""
    size = 1 << BITS

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(2 * size + 1)
        for b in batches:
            add(table, [t for t in b[col] if isinstance(t, str)])
        for lo in range(0, len(table), BLOCK):
            block = table[lo : lo + BLOCK]
            if block.any():
                yield pd.DataFrame({"block": [lo], "n": [block.astype(np.float32).tobytes()]})

    def added(blocks: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.float32) for x in blocks["n"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"block": blocks["block"][:1], "n": [total.astype(np.float32).tobytes()]})

    got = texts.select(col).mapInPandas(part, "block int, n binary").groupBy("block").applyInPandas(added, "block int, n binary").collect()
    flat = np.zeros(2 * size + 1, dtype=np.float32)
    for r in got:
        block = np.frombuffer(r["n"], dtype=np.float32)
        flat[r["block"] : r["block"] + len(block)] = block
    return Grams(flat[:-1].reshape(2, size), float(flat[-1]))


def add(table: np.ndarray, texts: list[str]) -> None:
    """Counts the sequences of some texts into a flat table of 2 * 2**BITS + 1 numbers; the last is the total."""
    size = 1 << BITS
    for lo in range(0, len(texts), 500):
        c = _codes(_START.join(["", *texts[lo : lo + 500], ""]))
        if len(c) < ORDER:
            continue
        h, power = np.zeros(len(c), dtype=np.uint64), np.uint64(1)
        for n in range(1, ORDER + 1):
            h[n - 1 :] += c[: len(c) - n + 1] * power
            power = _times(power)
            at = h[ORDER - 1 :]
            for row in (0, 1):
                table[:-1] += np.bincount(_bucket(at, n, row) + row * size, minlength=2 * size)
        table[-1] += len(c) - ORDER + 1


@lru_cache(maxsize=16)
def _undefined(codec: str) -> frozenset[int]:
    """Bytes that a one-byte encoding leaves undefined; all beyond ASCII if it defines each."""
    bad = set()
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(codec)
        except UnicodeDecodeError:
            bad.add(b)
    return frozenset(bad or range(0x80, 0x100))


def _holes(codec: str) -> frozenset[int]:
    """Bytes that a one-byte encoding leaves undefined, none if it defines each."""
    bad = _undefined(codec)
    return bad if len(bad) < 128 else frozenset()


_CONTROLS, _NO_BREAK = frozenset(range(0x80, 0xA0)), frozenset([0xA0])
_HIGH, _LEADS, _LEADS4, _NEXT = (frozenset(range(*r)) for r in ((0x80, 0x100), (0xE0, 0xF5), (0xF0, 0xF5), (0x80, 0xC0)))


class Reader:
    """Reads stretches with losses; alphabet: the characters that may come out."""

    def __init__(self, grams: Grams, alphabet: dict[str, float]):
        self.grams = grams
        chars = [c for c in sorted(alphabet) if c != LOST and not 0xE000 <= ord(c) <= 0xF8FF and (c == "\xa0" or not c.isspace())]
        n = grams.count(_codes("".join(chars)), 1) if chars else np.zeros(0)
        self.chars = [c for c, k in zip(chars, n) if k > 0]
        self.spelt: dict[str, dict[int, list[tuple[str, bytes]]]] = {}

    def spellings(self, true: str) -> dict[int, list[tuple[str, bytes]]]:
        """The characters that the encoding has, by their first byte."""
        got = self.spelt.get(true)
        if got is None:
            got = self.spelt[true] = {}
            for c in self.chars:
                try:
                    raw = c.encode(true)
                except UnicodeEncodeError:
                    continue
                got.setdefault(raw[0], []).append((c, raw))
        return got

    def lattice(self, text: str, true: str, wrong: str) -> list[list[tuple[str, int, float]]]:
        """Of each node in order its arcs (character, next node, cost)."""
        from corpusmill.llm.garble import to_byte  # garble imports this module

        steps: list[list[tuple[frozenset[int], int]]] = []  # arcs of bytes
        starts: list[int] = []

        table = None if wrong in ("utf-8", "gb18030") else to_byte(wrong)
        # of utf-8 read in one byte a character: a byte may have come out as a question mark, one without a character as nothing
        single = table is not None and true == "utf-8"
        dropped = _holes(wrong) if single else frozenset()
        if single and wrong == "cp1252" and not any(0x80 <= table.get(ch, 0) < 0xA0 for ch in text):
            dropped = _CONTROLS  # read as Latin-1 and cleared of control characters
        ways_of: list[list[list[frozenset[int]]]] = []
        for ch in text:
            if ch == LOST:
                if wrong == "utf-8":
                    ways = [[_HIGH], [_LEADS, _NEXT], [_LEADS4, _NEXT, _NEXT]]
                elif wrong == "gb18030":
                    ways = [[_HIGH], [_HIGH, _HIGH]]
                else:
                    ways = [[_undefined(wrong)]]
            elif table is not None:
                ways = [[frozenset((table[ch],))]] if ch in table else []
                if single and ch == "?":
                    ways.append([_NEXT])
                elif single and ch == " ":
                    ways.append([_NO_BREAK])  # a no-break space that was made a blank
            else:
                try:
                    ways = [[frozenset((b,)) for b in ch.encode(wrong)]]
                except UnicodeEncodeError:
                    ways = []
            ways_of.append(ways)
        # the nodes of a character lie between its start and the next one's, so that the order of the numbers is that of the text
        for ways in ways_of:
            starts.append(len(steps))
            steps += [[] for _ in range(1 + sum(len(w) - 1 for w in ways))]
        starts.append(len(steps))
        steps.append([])
        for k, ways in enumerate(ways_of):
            free = starts[k] + 1
            for w in ways:
                at = starts[k]
                for x in w[:-1]:
                    steps[at].append((x, free))
                    at, free = free, free + 1
                steps[at].append((w[-1], starts[k + 1]))
        spelt = self.spellings(true)
        arcs: list[list[tuple[str, int, float]]] = [[] for _ in steps]
        for p in range(len(steps) - 1):
            for mask, _ in steps[p]:
                for b in mask:
                    for c, raw in spelt.get(b, ()):
                        ends = {p: 0.0}
                        for x in raw:
                            moved = {q: cost for e, cost in ends.items() for m, q in steps[e] if x in m}
                            if x in dropped:
                                moved |= {e: cost + DROPPED for e, cost in ends.items() if e != p and e not in moved}
                            ends = moved
                            if not ends:
                                break
                        arcs[p] += [(c, e, cost) for e, cost in ends.items()]
            arcs[p] = sorted(set(arcs[p]))
        for k, ch in enumerate(text):
            arcs[starts[k]].append((ch, starts[k + 1], UNREAD if ch == LOST else 0.0 if ch.isascii() else STANDS))
        return arcs

    def read(self, text: str, channel: tuple[str, str], before: str = "", after: str = "", least: float = -np.inf) -> tuple[float, str] | None:
        """Log probability and reading of a stretch between two legible ones; None if it falls below least."""
        arcs = self.lattice(text, *channel)
        for c in after:  # what follows has one reading
            arcs[-1].append((c, len(arcs), 0.0))
            arcs.append([])
        pending: list[list[tuple]] = [[] for _ in arcs]
        first = _codes((_START + before)[-(ORDER - 1) :])[None, :]
        pending[0].append((first, np.zeros(1), np.full(1, -1), np.full(1, -1), np.zeros(1, dtype=np.int64)))
        kept: list[tuple | None] = [None] * len(arcs)
        for p, here in enumerate(arcs):
            if not pending[p]:
                continue
            if p % 8 == 0 and max(float(x[1].max()) for q in pending[p : p + 40] for x in q) < least:
                return None
            ctx, score, node, idx, ch = (np.concatenate(x) for x in zip(*pending[p]))
            pending[p] = []
            ok = np.flatnonzero(score >= score.max() - CUT)
            ok = ok[np.argsort(-score[ok], kind="stable")]
            key = np.zeros(len(ok), dtype=np.uint64)
            for k in range(ORDER - 1):
                key = key * _P + ctx[ok, k]
            ok = ok[np.sort(np.unique(key, return_index=True)[1])][:WAYS]
            ctx, score = ctx[ok], score[ok]
            kept[p] = (score, node[ok], idx[ok], ch[ok])
            if not here:
                continue
            real = np.array([ord(a[0]) for a in here], dtype=np.int64)
            codes = _codes("".join(a[0] for a in here))
            to, cost = np.array([a[1] for a in here]), np.array([a[2] for a in here])
            total = score[:, None] + self.grams.log(ctx, codes) + cost
            for t in np.unique(to):
                cols = np.flatnonzero(to == t)
                s = total[:, cols]
                i, j = np.nonzero(s >= s.max() - CUT)
                pending[t].append((np.column_stack([ctx[i, 1:], codes[cols[j]]]), s[i, j], np.full(len(i), p), i, real[cols[j]]))
        p, k, out = len(arcs) - 1, 0, []
        best = float(kept[p][0][0])
        while p > 0:
            _, node, idx, ch = kept[p]
            out.append(chr(int(ch[k])))
            p, k = int(node[k]), int(idx[k])
        got = "".join(reversed(out))
        return best, got[: len(got) - len(after)] if after else got

    def restore(self, text: str, rest) -> str:
        """The text with its losses read by the channel that explains all of them best; rest(part) restores what lies between."""
        spans = [m.span() for m in WINDOW.finditer(text)]
        plain, done = [], 0
        for a, b in spans:
            plain.append(rest(text[done:a]))
            done = b
        plain.append(rest(text[done:]))
        best = None
        for channel in CHANNELS:
            total, got = 0.0, []
            for k, (a, b) in enumerate(spans):
                read = self.read(text[a:b], channel, plain[k], plain[k + 1][: ORDER - 1], -np.inf if best is None else best[0] - total)
                if read is None:
                    break
                total += read[0]
                got.append(read[1])
            if len(got) == len(spans) and (best is None or total > best[0]):
                best = (total, got)
        out = [plain[0]]
        for k, r in enumerate(best[1]):
            out += [r, plain[k + 1]]
        return "".join(out)
