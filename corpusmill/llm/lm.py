"""Word frequencies of the whole corpus in tables of fixed size.

Units (words, single Han characters, marks with their surroundings) are counted over every row and kept in a
count-min table: ROWS rows of 2**BITS buckets, whatever the corpus. So what is sent to the workers has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, ROWS = 19, 2
SEEDS = (0, 0x5BD1E995)

HAN = "⺀-⿟㐀-鿿豈-﫿"
_UNIT = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+|\d+|[^\w\s]|_", re.UNICODE)
_DIGITS = re.compile(r"\d+")


def norm(s: str) -> str:
    """Lower case, runs of digits as 0."""
    return _DIGITS.sub("0", s.lower())


def units(text: str) -> list[str]:
    """Words, single Han characters and punctuation marks."""
    return _UNIT.findall(norm(text))


_IS_HAN = re.compile(f"[{HAN}]")


def is_han(ch: str) -> bool:
    return bool(_IS_HAN.match(ch))


def buckets(unit: str, bits: int = BITS) -> list[int]:
    raw = unit.encode("utf-8", "surrogatepass")
    return [zlib.crc32(raw, seed) & ((1 << bits) - 1) for seed in SEEDS]


class Counts:
    """Frequencies by unit; never below the true one."""

    def __init__(self, table: np.ndarray, total: float, bits: int = BITS):
        self.table, self.total, self.bits = table, max(total, 1.0), bits
        self.known: dict[str, float] = {}

    def __getitem__(self, unit: str) -> float:
        got = self.known.get(unit)
        if got is None:
            got = float(min(self.table[k, b] for k, b in enumerate(buckets(unit, self.bits))))
            if len(self.known) < 500_000:
                self.known[unit] = got
        return got

    def log(self, unit: str) -> float:
        return float(np.log((self[unit] + 0.05) / self.total))


def count_units(texts: DataFrame, col: str, of, bits: int = BITS, alphabet: dict[str, float] | None = None) -> Counts:
    """Counts over all rows of texts[col]; of(text) gives the units of a text. Null texts have none.

    Each task adds up its own table and emits its non-zero buckets, so that the shuffle is bounded by the tasks times the
    size of the table, and what comes to the driver by the table. With alphabet, the same pass counts each character beyond
    ASCII into it, of which Unicode bounds the number.
    """
    size = 1 << bits
    with_chars = alphabet is not None

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(ROWS * size + 1, dtype=np.float64)
        memo: dict[str, list[int]] = {}
        seen: Counter = Counter()
        for b in batches:
            for t in b[col]:
                if not isinstance(t, str):
                    continue
                if with_chars and not t.isascii():
                    seen.update(t)
                us = of(t)
                table[-1] += len(us)
                for u in us:
                    at = memo.get(u)
                    if at is None:
                        at = [k * size + x for k, x in enumerate(buckets(u, bits))]
                        if len(memo) < 200_000:
                            memo[u] = at
                    for x in at:
                        table[x] += 1
        some = np.flatnonzero(table)
        for lo in range(0, len(some), 100_000):
            yield pd.DataFrame({"bucket": some[lo : lo + 100_000], "n": table[some[lo : lo + 100_000]]})
        beyond = [(ROWS * size + 1 + ord(c), float(n)) for c, n in seen.items() if not c.isascii()]
        if beyond:
            yield pd.DataFrame(beyond, columns=["bucket", "n"])

    got = texts.select(col).mapInPandas(part, "bucket int, n double").groupBy("bucket").agg(F.sum("n").cast("float").alias("n")).toPandas()
    flat = np.zeros(ROWS * size + 1, dtype=np.float32)
    at, n = got["bucket"].to_numpy(dtype=np.int64), got["n"].to_numpy()
    chars = at > ROWS * size
    flat[at[~chars]] = n[~chars]
    if alphabet is not None:
        alphabet.update((chr(int(k) - ROWS * size - 1), float(v)) for k, v in zip(at[chars], n[chars]))
    return Counts(flat[:-1].reshape(ROWS, size), float(flat[-1]), bits)
