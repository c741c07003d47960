"""Sentence alignment of rough translations.

1. Units of both texts are aligned by length (dynamic programming over beads of 1-1, 1-0, 0-1, 1-2 and 2-1 units).
2. Word-translation probabilities come from expectation-maximization over the confident 1-1 beads of all documents. The
   table is hashed into 2**BITS buckets, so its size doesn't grow with the corpus; each round is one distributed pass.
3. Units are realigned by dynamic programming over lexical scores; units left over are matched out of order, and a unit
   that translates a part of another is paired with it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import lm
from corpusmill.llm.lookalike import skeleton, surface
from corpusmill.llm.sentences import Splitter, unit_spans

BITS, ROUNDS = 20, 5
#: Cost of a confident 1-1 bead by length, and the share of a unit's words that a counterpart must explain.
CONFIDENT, COVER = 1.2, 0.5


def words(unit: str) -> list[str]:
    """Lower-case words and numbers of the unit's look; Han characters one by one."""
    return [u for u in lm._UNIT.findall(skeleton(surface(unit)).lower()) if u[0].isalnum()]


_HAN = re.compile(f"[{lm.HAN}]")


def size(unit: str) -> float:
    """Length in letters; a Han character counts for three."""
    return float(len(unit)) if unit.isascii() else len(unit) + 2.2 * len(_HAN.findall(unit))


_memo: dict[str, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hash(word: str) -> int:
    """63 bits of a word, the same in every process."""
    got = _memo.get(word)
    if got is None:
        got = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        if len(_memo) < 500_000:
            _memo[word] = got
    return got


def _bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _M2
        return ((h ^ (h >> np.uint64(29))) * _M1 >> np.uint64(64 - BITS)).astype(np.int64)


def word_buckets(lang: int, side: int, words_: np.ndarray) -> np.ndarray:
    """Buckets of the words of one side (1 left, 2 right) of a language."""
    with np.errstate(over="ignore"):
        return _bucket(words_.astype(np.uint64) * _M1 + np.uint64(lang) + np.uint64(side))


def pair_buckets(lang: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bucket of each pair of words: a row for each right word."""
    with np.errstate(over="ignore"):
        return _bucket((left.astype(np.uint64) * _M1)[None, :] + (right.astype(np.uint64) * _M2)[:, None] + np.uint64(lang))


#: Fixed order of the moves of a bead, (left units, right units, cost); the first of equal ones counts.
MOVES = ((2, 1, 1.2), (1, 2, 1.2), (1, 1, 0.0), (1, 0, 3.5), (0, 1, 3.5))


def by_length(a: list[float], b: list[float]) -> list[tuple[int, int, int, int, float]]:
    """Beads (i, i_end, j, j_end, cost) of the cheapest monotone alignment by length; the whole table, without a band."""
    return by_length_all([(np.array(a), np.array(b))])[0]


def by_length_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[int, int, int, int, float]]]:
    """by_length of many pairs: those with equal numbers of units fill their tables together, a cell at a time."""
    out: list = [[] for _ in pairs]
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        shapes.setdefault((len(a), len(b)), []).append(k)
    for (n, m), mine in shapes.items():
        if not n and not m:
            continue
        step = max(1, 2_000_000 // ((n + 1) * (m + 1)))
        for lo in range(0, len(mine), step):
            some = mine[lo : lo + step]
            a = np.array([pairs[k][0] for k in some]).reshape(len(some), n)
            b = np.array([pairs[k][1] for k in some]).reshape(len(some), m)
            total_a, total_b = a.sum(axis=1), b.sum(axis=1)
            ratio = np.where(total_b == 0, 1.0, total_b) / np.where(total_a == 0, 1.0, total_a)
            ca = np.concatenate([np.zeros((len(some), 1)), np.cumsum(a, axis=1)], axis=1)
            cb = np.concatenate([np.zeros((len(some), 1)), np.cumsum(b, axis=1)], axis=1)
            best = np.full((n + 1, m + 1, len(some)), np.inf)
            back = np.zeros((n + 1, m + 1, len(some)), dtype=np.int8)
            best[0, 0] = 0.0
            logs = {}
            for di, dj in ((1, 1), (2, 1), (1, 2)):
                if di <= n and dj <= m:
                    x, y = (ca[:, di:] - ca[:, :-di]).T, (cb[:, dj:] - cb[:, :-dj]).T
                    logs[di, dj] = np.log(x * ratio + 4), np.log(y + 4)
            for i in range(n + 1):
                for j in range(m + 1):
                    if not i and not j:
                        continue
                    here, arg = best[i, j], back[i, j]
                    for k, (di, dj, fix) in enumerate(MOVES):
                        if i < di or j < dj:
                            continue
                        c = best[i - di, j - dj] + fix
                        if di and dj:
                            lx, ly = logs[di, dj]
                            c = c + np.abs(ly[j - dj] - lx[i - di]) * 3
                        less = c < here
                        here[less] = c[less]
                        arg[less] = k
            values, moves = best.transpose(2, 0, 1).tolist(), back.transpose(2, 0, 1).tolist()
            for k, v, mv in zip(some, values, moves):
                i, j, beads_ = n, m, out[k]
                while i or j:
                    di, dj, _ = MOVES[mv[i][j]]
                    beads_.append((i - di, i, j - dj, j, v[i][j] - v[i - di][j - dj]))
                    i, j = i - di, j - dj
                beads_.reverse()
    return out


class Lexicon:
    """Translation probabilities, hashed; numbers and words that are spelt alike translate themselves."""

    def __init__(self, joint: np.ndarray, of: np.ndarray, back: np.ndarray):
        self.joint, self.of, self.back = joint, of, back

    def table(self, lang: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each pair (a row for each left word), and how much each word says: rare words much, articles little.

        A probability counts in both directions: a word that stands beside everything translates nothing.
        """
        c = self.joint[pair_buckets(lang, left, right)].T
        of, back = self.of[word_buckets(lang, 1, left)], self.back[word_buckets(lang, 2, right)]
        t = np.where(c > 0.2, np.minimum(1.0, c / np.sqrt((of + 0.5)[:, None] * (back + 0.5)[None, :])), 0.0)
        t[left[:, None] == right[None, :]] = 1.0
        return t, 1.0 / np.log(8.0 + of), 1.0 / np.log(8.0 + back)


def prepared(texts: DataFrame, keys: list[str], side: str, splitter: Splitter) -> DataFrame:
    """keys, and the units' offsets, sizes, numbers of words and hashed words of texts(keys, text) as <side>_<field>: each text is cut once.

    The numbers are kept as bytes, which pass between the JVM and Python without a cost for each.
    """
    types = dict(texts.dtypes)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols: dict[str, list[bytes]] = {f"{side}_{field}": [] for field in FIELDS}
            some = list(b["text"])
            for t, starts in zip(some, splitter.batch(some)):
                units = [t[x:y] for x, y in unit_spans(t, starts)]
                hashed = [[word_hash(w) for w in words(u)] for u in units]
                cols[f"{side}_starts"].append(np.array(starts, dtype=np.int32).tobytes())
                cols[f"{side}_sizes"].append(np.array([size(u) for u in units], dtype=np.float64).tobytes())
                cols[f"{side}_counts"].append(np.array([len(h) for h in hashed], dtype=np.int32).tobytes())
                cols[f"{side}_words"].append(np.array([w for h in hashed for w in h], dtype=np.int64).tobytes())
            yield pd.DataFrame({**{k: b[k] for k in keys}, **cols})

    return texts.select(*keys, "text").mapInPandas(part, ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{side}_{field} binary" for field in FIELDS)]))


FIELDS = ("starts", "sizes", "counts", "words")
_TYPES = {"starts": np.int32, "sizes": np.float64, "counts": np.int32, "words": np.int64}


def _unpacked(b: pd.DataFrame, name: str, *fields: str) -> Iterator[tuple[np.ndarray, ...]]:
    return zip(*([np.frombuffer(x, dtype=_TYPES[f]) for x in b[f"{name}_{f}"]] for f in fields))


def beads(units: DataFrame) -> DataFrame:
    """eb, fb and at of each confident bead of both sides' prepared(): the buckets of its words and of its word pairs, as bytes."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left, right = list(_unpacked(b, "e", "sizes", "counts", "words")), list(_unpacked(b, "f", "sizes", "counts", "words"))
            es: list[int] = []
            fs: list[int] = []
            n_e: list[int] = []
            n_f: list[int] = []
            codes: list[int] = []
            for lang, (_, en, ew), (_, fn, fw), found in zip(b["lang"], left, right, by_length_all([(e[0], f[0]) for e, f in zip(left, right)])):
                if not len(en) or not len(fn):
                    continue
                code, ew, fw = word_hash(lang), ew.tolist(), fw.tolist()
                e_at, f_at = [0, *np.cumsum(en).tolist()], [0, *np.cumsum(fn).tolist()]
                for i, i2, j, j2, c in found:
                    if i2 - i != 1 or j2 - j != 1 or c > CONFIDENT:
                        continue
                    e, f = dict.fromkeys(ew[e_at[i] : e_at[i2]]), dict.fromkeys(fw[f_at[j] : f_at[j2]])
                    same = e.keys() & f.keys()
                    for w in same:
                        del e[w], f[w]
                    if e and f:
                        es += e
                        fs += f
                        n_e.append(len(e))
                        n_f.append(len(f))
                        codes.append(code)
            yield _bucketed(*(np.array(x, dtype=np.int64) for x in (es, fs, n_e, n_f, codes)))

    return units.mapInPandas(part, "eb binary, fb binary, at binary")


def _bucketed(es: np.ndarray, fs: np.ndarray, n_e: np.ndarray, n_f: np.ndarray, codes: np.ndarray) -> pd.DataFrame:
    """The buckets of many beads, whose words lie end to end, found at once."""
    n = n_e * n_f
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(n_e, n)
    e = es[np.repeat(np.cumsum(n_e) - n_e, n) + pos % np.maximum(wide, 1)]
    f = fs[np.repeat(np.cumsum(n_f) - n_f, n) + pos // np.maximum(wide, 1)]
    with np.errstate(over="ignore"):
        at = _bucket(e.astype(np.uint64) * _M1 + f.astype(np.uint64) * _M2 + np.repeat(codes, n).astype(np.uint64))
        eb = _bucket(es.astype(np.uint64) * _M1 + np.repeat(codes, n_e).astype(np.uint64) + np.uint64(1))
        fb = _bucket(fs.astype(np.uint64) * _M1 + np.repeat(codes, n_f).astype(np.uint64) + np.uint64(2))
    cols = {}
    for name, x, k in (("eb", eb, n_e), ("fb", fb, n_f), ("at", at, n)):
        raw, ends = x.astype(np.int32).tobytes(), (4 * np.cumsum(k)).tolist()
        cols[name] = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    return pd.DataFrame(cols, columns=["eb", "fb", "at"])


def train(found: DataFrame) -> Lexicon:
    """EM over beads() that were written once. A round is one pass of array arithmetic over whole batches.

    The table is kept as expected counts: of word pairs, and of the words of either side, each hashed to 2**BITS buckets.
    """
    spark = found.sparkSession
    size_ = 1 << BITS

    def step(table: tuple[np.ndarray, np.ndarray] | None):
        shared = spark.sparkContext.broadcast(table)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            old = shared.value
            new = np.zeros(3 * size_, dtype=np.float64)
            for b in batches:
                if not len(b):
                    continue
                at, eb, fb = (np.frombuffer(b"".join(b[c]), dtype=np.int32).astype(np.int64) for c in ("at", "eb", "fb"))
                n_e, n_f = b["eb"].map(len).to_numpy() // 4, b["fb"].map(len).to_numpy() // 4
                # every pair's row (its bead's right word) and its left word
                row = np.repeat(np.arange(n_f.sum()), np.repeat(n_e, n_f))
                first = np.repeat(np.cumsum(n_e) - n_e, n_e * n_f)
                inner = np.arange(len(at)) - np.repeat(np.cumsum(n_e * n_f) - n_e * n_f, n_e * n_f)
                left = eb[first + inner % np.repeat(n_e, n_e * n_f)]
                p = np.ones(len(at)) if old is None else old[0][at] / np.maximum(old[1][left], 1e-6) + 1e-9
                p /= np.bincount(row, p)[row]
                new += np.bincount(np.concatenate([at, size_ + left, 2 * size_ + fb]), np.concatenate([p, p, np.ones(len(fb))]), 3 * size_)
            some = np.flatnonzero(new)
            for lo in range(0, len(some), 100_000):
                yield pd.DataFrame({"bucket": some[lo : lo + 100_000], "n": new[some[lo : lo + 100_000]]})

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"at": [b["bucket"].to_numpy(dtype=np.int32).tobytes()], "n": [b["n"].to_numpy(dtype=np.float32).tobytes()]})

        # to the driver as bytes, a row for each batch: at most the table
        sums = found.mapInPandas(part, "bucket int, n double").groupBy("bucket").agg(F.sum("n").cast("float").alias("n"))
        flat = np.zeros(3 * size_, dtype=np.float32)
        for r in sums.mapInPandas(packed, "at binary, n binary").collect():
            flat[np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["n"], dtype=np.float32)
        shared.destroy()
        return flat[:size_], flat[size_ : 2 * size_], flat[2 * size_ :]

    table = None
    for _ in range(ROUNDS):
        table = step(None if table is None else table[:2])
    return Lexicon(*table)


def _counted(counts: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a text's units, and how often each unit holds each."""
    ids, at = np.unique(words_, return_inverse=True)
    k = max(len(ids), 1)
    return ids, np.bincount(np.repeat(np.arange(len(counts)), counts) * k + at, minlength=len(counts) * k).reshape(len(counts), k)[:, : len(ids)].astype(np.float64)


def align(lex: Lexicon, lang: str, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs (left unit, right unit) of which one translates the other or a part of it; units as (numbers of words, hashed words)."""
    n, m = len(left[0]), len(right[0])
    if not n or not m:
        return []
    e_ids, in_e = _counted(*left)
    f_ids, in_f = _counted(*right)
    t, say_e, say_f = lex.table(word_hash(lang), e_ids, f_ids)
    we, wf = in_e * say_e, in_f * say_f
    # how well a unit explains each word (an idiom's words share the credit), and the explained share of the other unit
    cov_f = np.minimum(1.0, 1.25 * (in_e @ t)) @ wf.T / np.maximum(wf.sum(axis=1), 1e-9)[None, :]
    cov_e = we @ np.minimum(1.0, 1.25 * (in_f @ t.T)).T / np.maximum(we.sum(axis=1), 1e-9)[:, None]
    # the share that two neighbouring units explain together
    pair_f = np.minimum(1.0, 1.25 * ((in_e[:-1] + in_e[1:]) @ t)) @ wf.T / np.maximum(wf.sum(axis=1), 1e-9)[None, :]
    pair_e = we @ np.minimum(1.0, 1.25 * ((in_f[:-1] + in_f[1:]) @ t.T)).T / np.maximum(we.sum(axis=1), 1e-9)[:, None]
    both = (cov_e + cov_f) / 2
    part = np.maximum(cov_e, cov_f)
    # monotone alignment over lexical scores: 1-1, and merges in which each unit is explained by the other side's one
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    move = [[0] * (m + 1) for _ in range(n + 1)]
    gains = np.where(part >= COVER, both + 0.5 * part, 0.0) - 0.45
    gain, cov_e, cov_f, pair_e, pair_f = (x.tolist() for x in (gains, cov_e, cov_f, pair_e, pair_f))  # numbers one by one from here on
    for i in range(n + 1):
        for j in range(m + 1):
            options = [(-1e9, 0)]
            if i:
                options.append((best[i - 1][j], 1))
            if j:
                options.append((best[i][j - 1], 2))
            if i and j:
                options.append((best[i - 1][j - 1] + gain[i - 1][j - 1], 3))
            if i > 1 and j:  # two left units in one right unit
                options.append((best[i - 2][j - 1] + _merge(cov_e[i - 2][j - 1], cov_e[i - 1][j - 1], cov_f[i - 2][j - 1], cov_f[i - 1][j - 1], pair_f[i - 2][j - 1]), 4))
            if i and j > 1:
                options.append((best[i - 1][j - 2] + _merge(cov_f[i - 1][j - 2], cov_f[i - 1][j - 1], cov_e[i - 1][j - 2], cov_e[i - 1][j - 1], pair_e[i - 1][j - 2]), 5))
            if i or j:
                best[i][j], move[i][j] = max(options)
    pairs: set[tuple[int, int]] = set()
    i, j = n, m
    while i or j:
        k = move[i][j]
        if k == 3:
            if gain[i - 1][j - 1] > 0:
                pairs.add((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif k == 4:
            pairs |= {(i - 2, j - 1), (i - 1, j - 1)}
            i, j = i - 2, j - 1
        elif k == 5:
            pairs |= {(i - 1, j - 2), (i - 1, j - 1)}
            i, j = i - 1, j - 2
        elif k == 1:
            i -= 1
        else:
            j -= 1
    # what is left on both sides, out of order: mutual best first
    free_i, free_j = set(range(n)) - {p[0] for p in pairs}, set(range(m)) - {p[1] for p in pairs}
    rest = sorted(((gain[i][j], i, j) for i in free_i for j in free_j if gain[i][j] > 0.3), reverse=True)
    for _, i, j in rest:
        if i in free_i and j in free_j:
            pairs.add((i, j))
            free_i.discard(i)
            free_j.discard(j)
    # units left over that translate a part of a unit that is paired already: what its partners leave unexplained must be theirs
    for j in sorted(free_j):
        found = [(cov_f[i][j], i) for i in range(n) if cov_f[i][j] >= 0.6 and cov_e[i][j] >= 0.08]
        near = [(c, -min((abs(p[1] - j) for p in pairs if p[0] == i), default=99), i) for c, i in found]
        near = [x for x in near if -x[1] <= 1]
        if near:
            pairs.add((max(near)[2], j))
    for i in sorted(free_i):
        found = [(cov_e[i][j], j) for j in range(m) if cov_e[i][j] >= 0.6 and cov_f[i][j] >= 0.08]
        near = [(c, -min((abs(p[0] - i) for p in pairs if p[1] == j), default=99), j) for c, j in found]
        near = [x for x in near if -x[1] <= 1]
        if near:
            pairs.add((i, max(near)[2]))
    return sorted(pairs)


def _merge(a: float, b: float, one: float, other: float, whole: float) -> float:
    """Gain of a merge of two units in one. a and b: how much of them it explains; one, other, whole: how much of it they explain, alone and together."""
    if min(a, b) < 0.4 or whole < 0.7 or whole - max(one, other) < 0.15:
        return -1.0
    return (a + b) / 2 + whole - 0.45


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the smallest row_id of each key, by aggregation with partial results (no window over a hot key)."""
    return df.where(F.col("row_id").isNotNull()).groupBy(*keys).agg(F.min_by("text", "row_id").alias("text"))


def found(units: DataFrame, lex: Lexicon) -> DataFrame:
    """id, lang, node_start, loc_start of each aligned pair of units of prepared()."""
    shared = units.sparkSession.sparkContext.broadcast((lex.joint, lex.of, lex.back))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(*shared.value)
        for b in batches:
            rows = []
            for key, lang, (es, *left), (fs, *right) in zip(b["id"], b["lang"], _unpacked(b, "e", "starts", "counts", "words"), _unpacked(b, "f", "starts", "counts", "words")):
                for i, j in align(lexicon, lang, left, right):
                    rows.append((key, lang, int(es[i]), int(fs[j])))
            yield pd.DataFrame(rows, columns=["id", "lang", "node_start", "loc_start"])

    return units.mapInPandas(part, "id int, lang string, node_start int, loc_start int")
