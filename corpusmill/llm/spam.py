"""Keyword-stuffed pages, link lists and tag lists, told from reading matter by a hidden Markov model over lines.

A document is cut into lines, the parts of lists and sentences; each gives one symbol (a link, a priced item, a repeated
short key, a stuffed sentence, a reference, a sentence, ...). The states are prose, link list, tag list and menu. The
model starts from a stated table and is re-estimated on all documents by expectation-maximization, in which only the
expected counts (states times symbols) are gathered. A document whose words lie mostly in lines of the last three states
is spam.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import lm

STATES = ("prose", "links", "tags", "menu")
SYMBOLS = ("sentence", "refrain", "line", "reference", "junk", "short", "cited_link", "link", "shop", "stuffed", "key", "parts")
#: Fixed start of the model: how likely each symbol is in each state (rows: states, in the order above).
EMISSION = np.array(
    [
        [0.62, 0.06, 0.12, 0.08, 0.03, 0.05, 0.02, 0.002, 0.001, 0.004, 0.002, 0.011],
        [0.01, 0.001, 0.01, 0.002, 0.01, 0.10, 0.03, 0.70, 0.04, 0.007, 0.08, 0.01],
        [0.02, 0.002, 0.02, 0.002, 0.01, 0.15, 0.002, 0.04, 0.30, 0.16, 0.274, 0.02],
        [0.01, 0.001, 0.02, 0.002, 0.01, 0.25, 0.002, 0.05, 0.03, 0.005, 0.42, 0.20],
    ]
)
START = np.array([0.85, 0.05, 0.06, 0.04])
STAY = 0.9
#: Expected counts of a state from which the data weigh as much as the stated table; rounds; share of words that makes spam.
PRIOR_WEIGHT, ROUNDS, SHARE = 2000.0, 2, 0.5

#: Share of a document's words from which one word is unusual.
UNUSUAL = 0.07

_URL = re.compile(r"(?:https?://|www\.)\S+|<a\s[^>]*>[^<]*</a>|\[[^\]]*\]\([^)]*\)|\b[\w-]+\.(?:example|invalid|test|com|net|org|info|biz|shop)\b\S*", re.I)
_SHOP = re.compile(r"★|☆|\[(?:cart|add|\+|>>)\]|\bSKU\b|#\w|(?<![\w.,])\(\d+[.,]\d\d\)|\b\d+ ?(?:cm|mm|kg|pcs)\b|[€$£]\s?\d|[^\W\d]-\d{1,3}(?!\d)", re.I)
_REFERENCE = re.compile(r"\d+\s?[–-]\s?\d+|\.{3,}\s*\d+\s*$|\bpp?\.\s?\d|^\s*\[\d+\]|^\s*§?\s*\d+[.)]\s|\b1[5-9]\d\d\b|§\s?\d")
_SENTENCE = re.compile(r"(?<=[.!?؟])[”»“\"」』)）]*\s+(?=[^\Wa-z\d_]|[¿¡“«„\"(])|(?<=[。！？])[」』）]*")
_LABEL = re.compile(r"^\s*(?:tags?|keywords?|sku|mots[- ]clés|etiquetas|schlagwörter|標籤)\s*:?\s*", re.I)
_SPLITS = (re.compile(r"\s*;\s*"), re.compile(r"\s*[•·]\s*"), re.compile(r"\s*\|\s*"), re.compile(r"\s+[-–]\s+"), re.compile(r"\s*[,、，]\s*"), re.compile(r"\s+(?=#)"), re.compile(r"\s{2,}"))
#: What each of them needs four of.
_SPLIT_MARKS = (";", "•·", "|", "-–", ",、，", "#", ("  ", "\t", "\u3000", "\xa0"))
_WORDS = re.compile(rf"[{lm.HAN}]|[^\W\d_{lm.HAN}]+")


class Piece:
    """What a piece of text says for itself: links, words in lower case, weight in words, and which marks it bears."""

    __slots__ = ("text", "low", "links", "words", "n", "ended", "again", "_shop", "_reference")

    def __init__(self, text: str):
        low = text.lower()
        self.text, self.low = text, low.strip()
        plain, self.links = _URL.subn(" ", low) if _MAY_LINK.search(low) else (low, 0)
        self.words = _WORDS.findall(plain)
        han = 0 if plain.isascii() else sum(len(w) == 1 and w >= "\u2e80" and lm.is_han(w) for w in self.words)
        self.n = self.links + len(self.words) - han + (han + 1) // 2
        self.ended = _ended(text) and self.n > 1
        self.again = _top(self.words)
        self._shop = self._reference = None

    @property
    def shop(self) -> bool:
        if self._shop is None:
            self._shop = bool(_SHOP.search(self.text))
        return self._shop

    @property
    def reference(self) -> bool:
        if self._reference is None:
            self._reference = bool(_REFERENCE.search(self.text))
        return self._reference

    @property
    def starred(self) -> bool:
        return self.text.rstrip().endswith("★")

    @property
    def bars(self) -> int:
        return self.text.count("|") + self.text.count("｜")


_known: dict[str, Piece] = {}
#: What every link holds; a cheap test before the pattern itself.
_MAY_LINK = re.compile(r"://|www\.|<a\s|\]\(|\.(?:example|invalid|test|com|net|org|info|biz|shop)\b")


def _ended(text: str) -> bool:
    """Whether the text ends with a mark of the sentence, closing marks after it passed over."""
    return text.rstrip().rstrip("”»“\"」』)")[-1:] in _ENDS


_ENDS = tuple(".!?。！？؟…")


def piece(text: str) -> Piece:
    """The piece, kept for the next time if it is short: lists and refrains come again."""
    got = _known.get(text)
    if got is None:
        got = Piece(text)
        if len(text) < 200 and len(_known) < 100_000:
            _known[text] = got
    return got


def n_words(text: str) -> int:
    """Words; two Han characters count as one, a link as one."""
    return piece(text).n


def pieces(text: str) -> list[str]:
    """Lines; of lines that are lists their parts, of other long lines their sentences."""
    out: list[str] = []
    for line in re.split(r"\n+", text):
        line = line.strip()
        if not line:
            continue
        body = _LABEL.sub("", line)
        if "★" in body:
            out += [p + "★" for p in re.split(r"[★☆]{2,}", body) if p.strip()]
            continue
        best: list[str] = []
        for rx, marks in zip(_SPLITS, _SPLIT_MARKS):
            if sum(map(body.count, marks)) < 4:
                continue
            parts = [p for p in rx.split(body) if p.strip()]
            if len(parts) >= 5 and len(parts) > len(best) and sum(n_words(p) <= 4 for p in parts) >= 0.85 * len(parts):
                best = parts
        if best:
            out += best
            continue
        sentences = [s for s in _SENTENCE.split(line) if s.strip()]
        for s in sentences:
            words = s.split()
            if len(words) > 14 and not _ended(s) and len(re.findall(r"[,;:，；]", s)) < len(words) / 8:
                # a long run without marks: by twos, as keys would lie
                out += [" ".join(words[k : k + 2]) for k in range(0, len(words), 2)]
            else:
                out.append(s)
    return out


def symbols(text: str) -> list[tuple[int, int]]:
    """(symbol, words) of each piece."""
    ps = [piece(p) for p in pieces(text)]
    whole: Counter = Counter()
    for p in ps:
        whole.update(p.words)
    same = Counter([p.low for p in ps])
    total = sum(whole.values()) or 1
    # a sentence that comes again is a refrain, unless others here are stuffed with its word
    stuffing = any(p.again and p.ended and not p.links and _repeats(p.again, whole, total) >= 2 for p in ps)
    out = []
    for p in ps:
        if not p.words and not p.links:
            s = "junk"
        elif p.links:
            s = "cited_link" if p.ended and len(p.words) >= 2 and not p.starred else "link"
        elif p.shop and not p.ended:
            s = "shop"
        elif p.ended or p.n > 4:
            inside = _repeats(p.again, whole, total)
            if inside >= 2 and p.ended:
                s = "stuffed"
            elif p.ended and same[p.low] > 2:
                s = "stuffed" if inside or (stuffing and _keyed(p.words, whole, total)) else "refrain"
            elif p.reference:
                s = "reference"
            elif p.ended:
                s = "sentence"
            else:
                s = "parts" if p.bars >= 2 else "line"
        elif p.reference:
            s = "reference"
        elif p.words and total >= 12 and min(whole[w] for w in p.words) >= 3:
            s = "key"
        else:
            s = "short"
        out.append((_INDEX[s], max(1, p.n)))
    return out


_INDEX = {s: k for k, s in enumerate(SYMBOLS)}


def _top(words: list[str]) -> dict[str, int]:
    """Content words (pairs of Han characters) that come more than once in a piece, with how often."""
    if words and lm.is_han(words[0]):
        some = ["".join(words[k : k + 2]) for k in range(len(words) - 1)]
    else:
        some = [w for w in words if len(w) > 3 or (len(w) > 2 and not w.isascii())]
    if len(set(some)) == len(some):
        return {}
    return {w: v for w, v in Counter(some).items() if v > 1}


def _repeats(top: dict[str, int], whole: Counter, total: int) -> int:
    """How often the content words of a piece come again within it, beyond the first time.

    A word that comes twice in it counts only if it also makes up an unusual share of the document (whole).
    """
    if not top:
        return 0
    if whole and max(top.values()) == 2:
        if max(min(whole[x] for x in (w if lm.is_han(w[0]) else [w])) for w in top) / total < UNUSUAL:
            return 0
    return sum(v - 1 for v in top.values())


def _keyed(words: list[str], whole: Counter, total: int) -> bool:
    """Whether the sentence holds a word that makes up an unusual share of the document."""
    return any(len(w) > 3 and whole[w] / total > 0.14 for w in words)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def stated() -> Model:
        k = len(STATES)
        move = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(move, STAY)
        e = EMISSION / EMISSION.sum(axis=1, keepdims=True)
        return Model(START.copy(), move, e)

    def viterbi(self, obs: list[int]) -> list[int]:
        return self.viterbi_all([obs])[0].tolist()

    def viterbi_all(self, docs: list) -> list[np.ndarray]:
        """The likeliest states of each document's symbols; a step of all documents at once, the longest first."""
        order, length, at, flat = _laid(docs)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8) for _ in docs]
        if not len(length):
            return out
        move, emit = np.log(self.move), np.log(self.emit).T
        d = np.log(self.start) + emit[flat[at]]
        back = []
        for t in range(1, int(length[0])):
            k = int(np.searchsorted(-length, -t, side="left"))  # documents longer than t
            m = d[:k, :, None] + move[None]
            back.append(m.argmax(axis=1).astype(np.int8))
            d[:k] = m.max(axis=1) + emit[flat[at[:k] + t]]
        states = d.argmax(axis=1)
        got = np.zeros(len(flat), dtype=np.int8)
        got[at + length - 1] = states
        for t in range(int(length[0]) - 1, 0, -1):
            k = int(np.searchsorted(-length, -t, side="left"))
            states[:k] = back[t - 1][np.arange(k), states[:k]]
            got[at[:k] + t - 1] = states[:k]
        for i, a, n in zip(order, at, length):
            out[i] = got[a : a + n]
        return out

    def expected(self, obs: list[int], into: np.ndarray) -> None:
        """Adds the expected (state, symbol) counts of a document."""
        into += self.expected_all([obs])[0]

    def expected_all(self, docs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of (state, symbol), (state, next state) and first states, by the scaled forward-backward recursion over all documents at once."""
        k_ = len(STATES)
        emitted, moved, first = np.zeros((k_, len(SYMBOLS))), np.zeros((k_, k_)), np.zeros(k_)
        _, length, at, flat = _laid(docs)
        if not len(length):
            return emitted, moved, first
        emit = self.emit.T
        a = np.zeros((len(flat), k_))
        c = np.zeros(len(flat))
        f = self.start * emit[flat[at]]
        c[at] = f.sum(axis=1)
        a[at] = f / c[at][:, None]
        for t in range(1, int(length[0])):
            k = int(np.searchsorted(-length, -t, side="left"))
            here = at[:k] + t
            f = (a[here - 1] @ self.move) * emit[flat[here]]
            c[here] = f.sum(axis=1)
            a[here] = f / c[here][:, None]
        g = np.zeros_like(a)
        b = np.ones((len(length), k_))
        for t in range(int(length[0]) - 1, -1, -1):
            k = int(np.searchsorted(-length, -t, side="left"))  # documents with a symbol at t
            here = at[:k] + t
            x = a[here] * b[:k]
            g[here] = x / x.sum(axis=1, keepdims=True)
            if t:
                ahead = emit[flat[here]] * b[:k] / c[here][:, None]
                moved += (a[here - 1].T @ ahead) * self.move
                b[:k] = ahead @ self.move.T
        first += g[at].sum(axis=0)
        for s in range(k_):
            emitted[s] = np.bincount(flat, g[:, s], len(SYMBOLS))
        return emitted, moved, first


def _laid(docs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the documents with symbols, the longest first, their lengths, where each begins in all symbols laid end to end, and these."""
    n = np.array([len(x) for x in docs], dtype=np.int64)
    begin = np.cumsum(n) - n
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in docs]) if n.sum() else np.zeros(0, dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    return order, n[order], begin[order], flat


def train(observed: DataFrame) -> Model:
    """Re-estimates emissions, transitions and first states on all rows of observed(symbols array<int>).

    The stated table and the data weigh alike, at any number of rows: so the states keep their meaning.
    """
    model = stated = Model.stated()
    shapes = (stated.emit, stated.move, stated.start[None])
    for _ in range(ROUNDS):
        now = model

        def part(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros(sum(x.size for x in shapes))
            for b in batches:
                total += np.concatenate([x.ravel() for x in now.expected_all(list(b["symbols"]))])
            yield pd.DataFrame({"at": np.arange(total.size), "n": total})

        got = observed.select("symbols").mapInPandas(part, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        flat = np.zeros(sum(x.size for x in shapes))
        flat[got["at"].to_numpy(dtype=int)] = got["n"].to_numpy()
        new, lo = [], 0
        for prior in shapes:
            counts = flat[lo : lo + prior.size].reshape(prior.shape)
            lo += prior.size
            seen = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
            sure = np.minimum(1.0, counts.sum(axis=1, keepdims=True) / PRIOR_WEIGHT)  # few rows say little
            new.append((prior + sure * seen) / (1 + sure))
        model = Model(new[2][0], new[1], new[0])
    return model


def observe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, symbols and words of each piece; empty lists for null, empty and blank texts. Rows with a null id are left out."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [symbols(t) if isinstance(t, str) else [] for t in b[text_col]]
            yield pd.DataFrame({"id": b[id_col], "symbols": [[s for s, _ in g] for g in got], "words": [[w for _, w in g] for g in got]})

    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInPandas(part, "id long, symbols array<int>, words array<int>")


def shares(observed: DataFrame, model: Model) -> DataFrame:
    """id and share: the part of a document's words in lines that aren't prose; 0 for a document without words."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for states, words in zip(model.viterbi_all(list(b["symbols"])), b["words"]):
                words = np.asarray(words, dtype=np.int64)
                total = int(words.sum())
                out.append(float(words[states > 0].sum()) / total if total else 0.0)
            yield pd.DataFrame({"id": b["id"], "share": out})

    return observed.mapInPandas(part, "id long, share double")
