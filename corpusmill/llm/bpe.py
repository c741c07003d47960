"""Byte-level BPE with a public vocabulary, in batched numpy merge rounds.

All words of a batch lie in one flat array of symbols. In every round each word
still in work finds its lowest-ranked neighbouring pair (one binary search over
the sorted pair keys for all pairs at once) and merges all its occurrences.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published split pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER_DIR = "/opt/tokenizers"
#: Words of up to this many bytes are remembered between batches, this many at most (a cache, not a limit on the input).
CACHE_BYTES, CACHE_WORDS = 48, 200_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte, by the published rule: printable Latin-1 stands for itself, the rest from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(spare)}


class BPE:
    """encode(texts) gives the ids of each text; deterministic, without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.size = len(vocab) + 1
        stand = _byte_symbols()
        self.byte_id = np.zeros(256, dtype=np.int64)
        for ch, b in stand.items():
            self.byte_id[b] = vocab[ch]
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], np.iinfo(np.int64).max), self.made[at]

    def _merge_words(self, words: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sym = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        lens = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
        word = np.repeat(np.arange(len(raw)), lens)  # the word of each symbol
        big = np.iinfo(np.int64).max
        while len(sym):
            same = word[:-1] == word[1:]
            rank = np.full(len(sym), big, dtype=np.int64)
            made = np.zeros(len(sym), dtype=np.int64)
            if len(sym) > 1:
                r, m = self._lookup(sym[:-1], sym[1:])
                rank[:-1] = np.where(same, r, big)
                made[:-1] = m
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            ends = np.r_[starts[1:], len(word)]
            over = best == big
            for k in np.flatnonzero(over):  # nothing left to merge in these words
                out[word[starts[k]]] = sym[starts[k] : ends[k]].astype(np.int32)
            if over.all():
                break
            each = np.repeat(best, ends - starts)
            take = (rank == each) & (each != big)
            pos = np.flatnonzero(take)
            if len(pos) > 1:  # occurrences that overlap: the left one first, so every second of a run
                run = np.flatnonzero(np.r_[True, np.diff(pos) != 1])
                nth = np.arange(len(pos)) - np.repeat(run, np.diff(np.r_[run, len(pos)]))
                pos = pos[nth % 2 == 0]
            sym[pos] = made[pos]
            keep = np.repeat(~over, ends - starts)
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
        return out  # type: ignore[return-value]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; the empty list for an empty or null text."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = list({w for ws in split for w in ws} - self.known.keys())
        new: dict[str, np.ndarray] = {}
        lo = 0
        while lo < len(fresh):  # some 4 MB of symbols at a time
            hi, total = lo, 0
            while hi < len(fresh) and (hi == lo or total < 500_000):
                total += len(fresh[hi])
                hi += 1
            new.update(zip(fresh[lo:hi], self._merge_words(fresh[lo:hi])))
            lo = hi
        none = np.zeros(0, dtype=np.int32)
        got = [np.concatenate([new[w] if w in new else self.known[w] for w in ws]) if ws else none for ws in split]
        for w, ids in new.items():
            if len(w) <= CACHE_BYTES and len(self.known) < CACHE_WORDS:
                self.known[w] = ids
        return got


@lru_cache(maxsize=2)
def load(name: str, folder: str = TOKENIZER_DIR) -> BPE:
    """The vocabulary of that name, once per Python worker."""
    return BPE(os.path.join(folder, f"{name}.json"))


def _batches(series: Iterator[pd.Series], name: str, folder: str) -> Iterator[list[np.ndarray]]:
    bpe = load(name, folder)
    for s in series:
        yield bpe.encode([t if isinstance(t, str) else None for t in s])


def token_ids(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """array<int> of the text's ids; the empty array for an empty and for a null text."""

    @F.pandas_udf("array<int>")
    def ids(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for got in _batches(series, name, folder):
            yield pd.Series(got, dtype=object)

    return ids(text)


def token_count(text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Column:
    """Number of ids of the text; 0 for an empty and for a null text."""

    @F.pandas_udf("int")
    def count(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for got in _batches(series, name, folder):
            yield pd.Series([len(x) for x in got], dtype="int32")

    return count(text)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids) of every row, repeated rows included; no shuffle, one pass over two columns."""
    return df.select(F.col(id_col), token_ids(F.col(text_col), name, folder).alias("ids"))
