"""Freely typed values mapped to the entries of a reference list.

Values and entries are compared by their letters and digits in lower case without accents. The usual ways to write an
entry (its names, words put the other way round, abbreviated lead words) are its forms; a BK-tree over all forms under the
Levenshtein metric returns every form within a threshold that grows with the value's length, pruning by the triangle
inequality. A list too long for one tree is searched in shards, and the shards' winners are merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.packed import packed_values, source_names
from corpusmill.session import spread

#: Entries in one tree at most; a longer list is split into as many shards as it needs.
PER_SHARD = 20_000
#: Share of a value's length that may differ, and the length up to which nothing may.
SHARE, EXACT = 0.3, 4
#: Lead words and their short forms.
SHORT_FORMS = {"synod of": ("syn",), "book of": ("bk of", "bk"), "letter to the": ("let to the", "ltr to the")}
NUMERALS = {"i": "1", "ii": "2", "iii": "3", "iv": "4"}

_LEAD = re.compile(r"(?i)^\W*(?:(?:cf|see also|see|vgl|voir|cfr|confer)\b[.,:]?\s*)+")
_LOCATOR = re.compile(r"[\s,;.:_]*(?:(?:\b|_)(?:can|lib|ch|cap|no|n|pp|p|s)\.?|§)?[\s_]*\d[\d\s,;–\-:.]*$", re.I)


_OTHER = re.compile("[^a-z0-9]+")


def key(text: str) -> str:
    """Letters and digits in lower case without accents."""
    if text.isascii():
        return _OTHER.sub("", text.lower())
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if c.isalnum())


def name_part(label: str) -> str:
    """The label without lead-ins and without locators at its end."""
    s = _LEAD.sub("", label.strip())
    while True:
        cut = _LOCATOR.sub("", s.rstrip(" ,.;:_\"'»”"))
        if cut == s or not cut:
            break
        s = cut
    return s.strip(" ,.;:_\"'«»“”")


_TAIL = re.compile(r"[\s,;.:_]*\d[\d\s,;–\-:.]*$")
_FIRST = re.compile(r"^(.*?[^\W\d].*?)[\s._]*\b([1-4])\b")


def spellings(label: str) -> tuple[list[str], list[str]]:
    """Keys that may be an entry as they are, and those to search for: the name without locators, and with a numeral after it."""
    bare = _LEAD.sub("", label.strip())
    name, whole = name_part(label), _TAIL.sub("", bare.rstrip(" ,.;:"))
    exact, near = [], []
    m = _FIRST.match(bare)
    if m:
        numbered = key(m.group(1)) + m.group(2)
        exact.append(numbered)
        if m.group(2) == "1" and re.fullmatch(r"(?:[^\W\d][\s._]+)+[^\W\d]", m.group(1).strip()):
            exact.append(numbered[:-1] + "i")  # an I read as 1 in a siglum written letter by letter
        near.append(numbered)
    both = [key(whole), key(name), key(bare)]
    exact += [both[1], *both] if re.fullmatch(r"[^\W\d_]{2,}", name) else both
    near.append(key(name))
    return list(dict.fromkeys(filter(None, exact))), list(dict.fromkeys(filter(None, near)))


def forms(title: str, siglum: str | None, aliases: list[str] | None) -> list[str]:
    """Keys of the usual ways to write an entry."""
    out = [title, *(aliases or [])]
    if siglum:
        out.append(siglum)
    low = title.lower()
    turned = []
    if ", " in title:
        a, b = title.split(", ", 1)
        turned += [f"{b} {a}", f"{b} by {a}"]
        m = re.match(r"(?i)(synod) of (.+)", a)
        if m:
            turned += [f"{m.group(2)} {m.group(1)} {b}", f"{b} of the {a}"]
    words = title.split()
    if 1 < len(words) <= 4:
        turned.append(" ".join([*words[1:], words[0]]))
    for full, shorts in SHORT_FORMS.items():
        if low.startswith(full + " "):
            rest = title[len(full) :].strip()
            turned += [f"{s} {rest}" for s in shorts] + [f"{rest} {full}"]
    last = words[-1].lower() if words else ""
    if last in NUMERALS:
        turned += [" ".join([*words[:-1], NUMERALS[last]]), " ".join(words[:-1])]
    return list(dict.fromkeys(k for k in map(key, out + turned) if k))


def levenshtein(a: str, b: str) -> int:
    """Edit distance, bit-parallel over the longer word."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    m = len(a)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for ch in b:
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score


def damerau(a: str, b: str, most: int | None = None) -> float:
    """Edit distance in which a swap of neighbours counts once and a letter typed twice or read wrongly less; only ranks what the tree found.

    most: the plain edit distance, if it is known. This one is no larger, so no best way strays farther from the diagonal
    than most / 0.7, and the rest isn't filled.
    """
    inf = float(len(a) + len(b) + 1)
    n = len(b)
    w = n + len(a) if most is None else int(most / 0.7) + 1
    older: list[float] = []
    old = [float(j) for j in range(n + 1)]
    for i in range(1, len(a) + 1):
        x = a[i - 1]
        gone = 0.7 if i > 1 and a[i - 2] == x else 1.0
        new = [inf] * (n + 1)
        lo = i - w
        if lo <= 0:
            new[0] = float(i)
            lo = 1
        for j in range(lo, min(n, i + w) + 1):
            y = b[j - 1]
            best = old[j - 1] + (0.0 if x == y else 1.0)
            v = old[j] + gone
            if v < best:
                best = v
            v = new[j - 1] + 1.0
            if v < best:
                best = v
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = older[j - 2] + 1.0
                if v < best:
                    best = v
            new[j] = best
        older, old = old, new
    return old[-1]


class BKTree:
    """Words under the Levenshtein metric, as arrays: a search walks the tree level by level for many words at once."""

    def __init__(self, words):
        self.words: list[str] = []
        self.kids: list[dict[int, int]] = []
        for w in words:
            self.add(w)
        self.arrays: tuple | None = None

    def add(self, word: str) -> None:
        self.arrays = None
        if not self.words:
            self.words.append(word)
            self.kids.append({})
            return
        at = 0
        while True:
            d = levenshtein(word, self.words[at])
            if d == 0:
                return
            if d not in self.kids[at]:
                self.kids[at][d] = len(self.words)
                self.words.append(word)
                self.kids.append({})
                return
            at = self.kids[at][d]

    def packed(self) -> tuple:
        """Letters as numbers, the words' letters and lengths, and of each word where its children's edges lie."""
        if self.arrays is None:
            letters = {c: k + 1 for k, c in enumerate(sorted({c for w in self.words for c in w}))}
            length = np.array([len(w) for w in self.words], dtype=np.int64)
            codes = np.zeros((len(self.words), max(int(length.max(initial=0)), 1)), dtype=np.int64)
            for k, w in enumerate(self.words):
                codes[k, : len(w)] = [letters[c] for c in w]
            count = np.array([len(x) for x in self.kids], dtype=np.int64)
            edge = np.array([(d, to) for x in self.kids for d, to in sorted(x.items())], dtype=np.int64).reshape(-1, 2)
            self.arrays = (letters, codes, length, np.cumsum(count) - count, count, edge[:, 0], edge[:, 1])
        return self.arrays

    def within_all(self, words: list[str], limits: list[int]) -> list[list[tuple[int, str]]]:
        """For each word, every word of the tree at a distance of at most its limit.

        A child at the edge k of a word at distance d is visited only if d - limit <= k <= d + limit. The distances of a
        level are found together, bit-parallel over words of up to 64 letters; a longer one by itself.
        """
        out: list[list[tuple[int, str]]] = [[] for _ in words]
        if not self.words or not words:
            return out
        letters, codes, length, first, count, edge, to = self.packed()
        wide = [k for k, w in enumerate(words) if len(w) > 64]
        masks = np.zeros((len(words), len(letters) + 1), dtype=np.uint64)
        for q, w in enumerate(words):
            if len(w) <= 64:
                for i, c in enumerate(w):
                    if (k := letters.get(c)) is not None:
                        masks[q, k] |= np.uint64(1 << i)
        size = np.array([len(w) for w in words], dtype=np.int64)
        limit = np.array(limits, dtype=np.int64)
        long_ = np.zeros(len(words), dtype=bool)
        long_[wide] = True
        q = np.arange(len(words))
        at = np.zeros(len(words), dtype=np.int64)
        while len(q):
            d = np.empty(len(q), dtype=np.int64)
            alone = long_[q] | (size[q] == 0)
            some = np.flatnonzero(~alone)
            d[some] = _distances(masks, size, q[some], codes, length, at[some])
            for k in np.flatnonzero(alone):
                d[k] = levenshtein(words[q[k]], self.words[at[k]])
            for k in np.flatnonzero(d <= limit[q]):
                out[q[k]].append((int(d[k]), self.words[at[k]]))
            n = count[at]
            of = np.repeat(np.arange(len(q)), n)
            e = first[at][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            near = np.abs(edge[e] - d[of]) <= limit[q[of]]
            q, at = q[of[near]], to[e[near]]
        return out

    def within(self, word: str, limit: int) -> list[tuple[int, str]]:
        return self.within_all([word], [limit])[0]


def _distances(masks: np.ndarray, size: np.ndarray, q: np.ndarray, codes: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Edit distance of the words q (by their masks) to the tree's words at, pair by pair."""
    order = np.argsort(-length[at], kind="stable")
    q, at = q[order], at[order]
    n = length[at]
    one, top = np.uint64(1), np.uint64(1) << (size[q] - 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        pv = top | (top - one)
        mv = np.zeros(len(q), dtype=np.uint64)
        score = size[q].copy()
        for j in range(int(n.max(initial=0))):
            k = int(np.searchsorted(-n, -j, side="left"))  # the pairs whose word has a letter at j
            p, m, t = pv[:k], mv[:k], top[:k]
            eq = masks[q[:k], codes[at[:k], j]]
            xv = eq | m
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            score[:k] += ((ph & t) != 0).astype(np.int64) - ((mh & t) != 0).astype(np.int64)
            ph, mh = (ph << one) | one, mh << one
            pv[:k], mv[:k] = mh | ~(xv | ph), ph & xv
    out = np.empty(len(q), dtype=np.int64)
    out[order] = score
    return out


#: Radius of the first search; only words without a near enough entry in it are searched for at their full radius.
FIRST = 2
#: Pairs of words whose distances are found at once.
PAIRS = 500_000


class Matcher:
    """best(names): for each name the rank of its closest entry, or None.

    The rank is (distance as a share of the length, place of the spelling, distance, edit distance, -popularity, form,
    entry): ranks of the trees of several shards can be compared.
    """

    def __init__(self, entries: list[tuple[str, str, str | None, list[str] | None, float]]):
        self.owner: dict[str, list[tuple[float, str]]] = {}
        short: set[str] = set()
        for eid, title, siglum, aliases, popular in entries:
            for f in forms(title, siglum, aliases):
                self.owner.setdefault(f, []).append((-popular, eid))
            if siglum:
                short.add(key(siglum))
        self.tree = BKTree(sorted(w for w in self.owner if len(w) > EXACT and w not in short))
        self.tree.packed()

    def best(self, names: list[str]) -> list[tuple | None]:
        out: list[tuple | None] = [None] * len(names)
        wanted: dict[str, list[tuple[int, int]]] = {}
        for k, name in enumerate(names):
            exact, near = spellings(name)
            for i, s in enumerate(exact):
                if s in self.owner:
                    popular, eid = min(self.owner[s])
                    out[k] = (0.0, i - 1000, 0.0, 0, popular, s, eid)
                    break
            else:
                for i, s in enumerate(near):
                    if len(s) > EXACT:
                        wanted.setdefault(s, []).append((k, i))
        found = self._search(list(wanted))
        for s, got in found.items():
            d, lev, popular, w = got
            for k, i in wanted[s]:
                rank = (d / len(s), i, d, lev, popular, w, min(self.owner[w])[1])
                if out[k] is None or rank < out[k]:
                    out[k] = rank
        return out

    def _search(self, keys: list[str]) -> dict[str, tuple[float, int, float, str]]:
        """Of each key the entry form that ranks first, if it is near enough.

        The ranking distance is at least half the edit distance (a swap costs 1 there and 2 here, a doubled letter 0.7
        and 1). So after a search of radius r every form not yet seen is at least (r + 1) / 2 away: a nearer one is final.
        """
        out: dict[str, tuple[float, int, float, str]] = {}
        limit = [int(min(len(k) * SHARE + 1.5, len(k) * 0.2 + 3)) for k in keys]
        todo = list(range(len(keys)))
        for last in (False, True):
            left = []
            step = max(1, PAIRS // max(len(self.tree.words), 1))  # words at once, so that a level fits in memory
            for lo in range(0, len(todo), step):
                some = todo[lo : lo + step]
                radius = [limit[j] if last else min(FIRST, limit[j]) for j in some]
                for j, r, near in zip(some, radius, self.tree.within_all([keys[j] for j in some], radius)):
                    best = self._rank(keys[j], near)
                    if best and (best[0] < (r + 1) / 2 or r == limit[j]):
                        out[keys[j]] = best
                    elif r < limit[j]:
                        left.append(j)
            todo = left
        return out

    def _rank(self, k: str, near: list[tuple[int, str]]) -> tuple[float, int, float, str] | None:
        most, best = len(k) * SHARE + 0.5, None
        for lev, w in sorted(near):
            if lev / 2 > (best[0] if best else most):
                break  # all that follow are farther
            rank = (damerau(k, w, lev), lev, min(self.owner[w])[0], w)
            if rank[0] <= most and (best is None or rank < best):
                best = rank
        return best


def match(labels: DataFrame, sources: DataFrame, label_col: str = "label", popular: DataFrame | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """(label, source_id, share) for each distinct non-blank label; source_id is 'none' where no entry is near enough.

    Labels are made distinct first, so that one that fills a third of the rows is searched once. Of a packed label the first
    value is taken, split with the names of the whole list. The reference list is counted; up to per_shard entries go into
    one tree on every worker, a longer list into several whose best ranks are merged, so the result doesn't depend on
    their number. popular(id, n): how often each entry is named, which breaks ties.
    """
    distinct = labels.where(F.col(label_col).isNotNull() & (F.trim(F.col(label_col)) != "")).select(F.col(label_col).alias("label")).distinct()
    list_ = sources.where(F.col("id").isNotNull() & F.col("title").isNotNull()).select("id", "title", "siglum", "aliases")
    if popular is not None:
        list_ = list_.join(popular.select(F.col("id").alias("__id"), "n"), F.col("id") == F.col("__id"), "left")
    else:
        list_ = list_.withColumn("n", F.lit(0))
    shards = max(1, -(-sources.count() // per_shard))
    rank = "share double, place int, distance double, edits int, popular double, form string, source_id string"
    values = packed_values(F.col("label"), source_names(sources))
    named = spread(distinct, scan=False).withColumn("v", values).select("label", F.when(F.size("v") > 1, F.element_at("v", 1)).otherwise(F.col("label")).alias("name"))
    found = None
    for k in range(shards):
        mine = list_.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == k) if shards > 1 else list_
        entries = [(r["id"], r["title"], r["siglum"], r["aliases"], float(r["n"] or 0)) for r in mine.collect()]
        shared = labels.sparkSession.sparkContext.broadcast(Matcher(entries))

        def part(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = shared.value
            for b in batches:
                got = [g or (9.0, 0, 0.0, 0, 0.0, "", "none") for g in m.best(list(b["name"]))]
                cols = list(zip(*got)) if got else [[] for _ in range(7)]
                yield pd.DataFrame({"label": b["label"], **dict(zip(("share", "place", "distance", "edits", "popular", "form", "source_id"), cols))})

        one = named.mapInPandas(part, "label string, " + rank)
        found = one if found is None else found.unionByName(one)
    if shards > 1:
        best = F.min(F.struct("share", "place", "distance", "edits", "popular", "form", "source_id"))
        found = found.groupBy("label").agg(best.alias("m")).select("label", "m.*")
    return found.select("label", "source_id", "share")


def popularity(references: DataFrame) -> DataFrame:
    """(id, n): how often each entry is named by resolved references. Grouped with partial sums."""
    return references.where(F.col("source_id").isNotNull()).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))


def resolve(references: DataFrame, sources: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """ref_key and source_id of each reference whose canonical_label is null and whose label is neither null nor blank."""
    open_ = references.where("canonical_label IS NULL AND label IS NOT NULL AND trim(label) <> ''").select("ref_key", "label")
    found = match(open_, sources, popular=popularity(references), per_shard=per_shard)
    return open_.join(found, "label").select("ref_key", "source_id")
