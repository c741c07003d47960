"""Several values packed in one field: a quote-aware finite-state tokenizer that emits values with ordinals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opening quotation marks and what closes them.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』"}
#: Delimiters that split any field, and those that split only before a known name.
STRONG = frozenset("\n\t;；|•·")
WEAK = frozenset(",/+–—")
#: Words that lead in a value and are none themselves.
LEAD_INS = ("cf", "confer", "see", "see also", "also", "vgl", "voir", "cfr", "véase", "and", "et", "und")
#: Names of one trie; a longer list goes in several, whose finds are merged.
PER_TRIE = 200_000

_WORD = re.compile(r"[A-Za-z0-9]+")
_DROP = re.compile(r"[^\x00-\x7f]")
#: Scripts that are written without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def _key(name: str) -> list[str]:
    """Words of the name's ASCII letters and digits: what is left of it when its other characters come out garbled."""
    return _WORD.findall(_DROP.sub("", name))


def _wide(name: str) -> list[str]:
    """Letters and digits of a name in a script other than Latin, in one form; empty for names in Latin letters."""
    letters = [c for c in unicodedata.normalize("NFKC", name).casefold() if c.isalnum()]
    return letters if any(c.isalpha() and not c.isascii() and not unicodedata.name(c, "").startswith("LATIN") for c in letters) else []


class Names:
    """A trie of name words, and one of letters for names in other scripts than Latin.

    A name written in capitals only (a siglum) is matched as it is, any other without regard to case.
    """

    def __init__(self, names: Iterable[str]):
        self.root: dict = {}
        self.wide: dict = {}
        self.longest = 0
        for name in names:
            if letters := _wide(name):
                at = self.wide
                for c in letters:
                    at = at.setdefault(c, {})
                at[""] = True
                continue
            words = _key(name)
            if not words:
                continue
            siglum = name.isupper() and len(words) == 1
            at = self.root
            for w in words:
                self.longest = max(self.longest, len(w))
                at = at.setdefault(w if siglum else w.lower(), {})
            at[""] = True

    def end(self, words: list[tuple[str, int, int, bool]], k: int) -> int:
        """Index after the longest name that begins at piece k, or k if none does. A word may lie in any number of pieces."""
        best, todo = k, [(self.root, k)]
        while todo:
            at, j = todo.pop()
            if "" in at and j > best:
                best = j
            word, e = "", j
            while e < len(words) and (e == j or words[e][3]) and len(word) <= self.longest:
                word += words[e][0]
                e += 1
                for w in {word, word.lower()}:
                    if (to := at.get(w)) is not None:
                        todo.append((to, e))
        return best

    def wide_end(self, text: str, i: int) -> int:
        """End of the longest name in another script that begins at i, or i. Blanks and marks within it don't count; an alphabet's word isn't cut."""
        at, best, k = self.wide, i, i
        while k < len(text):
            for c in unicodedata.normalize("NFKC", text[k]).casefold():
                if c.isalnum():
                    at = at.get(c)
                    if at is None:
                        return best
                elif k == i:
                    return best
            k += 1
            if "" in at and not (k < len(text) and text[k].isalpha() and _joined(text[k - 1], text[k])):
                best = k
        return best

    def spans(self, text: str, every: bool = False) -> dict[int, int]:
        """Start and end of the names from left to right, the longest first; every: of each place where one begins."""
        out: dict[int, int] = {}
        words = _words(text)
        k = 0
        while k < len(words):
            e = self.end(words, k)
            if e > k:
                out[words[k][1]] = words[e - 1][2]
            k = max(k + 1, e) if not every else k + 1
        if self.wide and not text.isascii():
            done = 0
            for i, ch in enumerate(text):
                if i >= done and not ch.isspace() and not (i and ch.isalpha() and text[i - 1].isalpha() and _joined(text[i - 1], ch)):
                    e = self.wide_end(text, i)
                    if e > out.get(i, i):
                        out[i] = e
                        done = done if every else e
        return out if every else _disjoint(out)


def _joined(a: str, b: str) -> bool:
    """Whether two letters belong to one word: both of scripts that part words by blanks."""
    return not (_UNSPACED.match(a) or _UNSPACED.match(b))


def _disjoint(spans: dict[int, int]) -> dict[int, int]:
    """From left to right the spans that don't run into one before them."""
    out, done = {}, 0
    for a in sorted(spans):
        if a >= done:
            out[a] = done = spans[a]
    return out


def _words(text: str) -> list[tuple[str, int, int, bool]]:
    """(run of ASCII letters and digits, start, end, whether only characters beyond ASCII part it from the one before)."""
    out: list[tuple[str, int, int, bool]] = []
    for m in _WORD.finditer(text):
        gap = text[out[-1][2] : m.start()] if out else " "
        out.append((m.group(), m.start(), m.end(), not any(c.isascii() for c in gap)))
    return out


def _closed(text: str) -> dict[int, int]:
    """Start and end of each quotation that opens at the beginning of a value and is closed later; a backslash escapes a mark."""
    spans: dict[int, int] = {}
    i, n = 0, len(text)
    last = {c: text.rfind(c) for c in QUOTES.values()}
    fresh = True  # nothing but blanks, delimiters and lead-ins since the last delimiter
    while i < n:
        ch = text[i]
        if ch == "\\":
            i += 2
            fresh = False
            continue
        if ch in QUOTES and last[QUOTES[ch]] > i and (fresh or text[i - 1].isspace() or text[i - 1] == "("):
            close = QUOTES[ch]
            j = i + 1
            while j < n:
                if text[j] == "\\":
                    j += 2
                    continue
                if text[j] == close:
                    if text[j + 1 : j + 2] == close and close == ch:  # a doubled mark stands for itself
                        j += 2
                        continue
                    if not (close in "'’" and text[j + 1 : j + 2].isalnum()):
                        break
                j += 1
            if j < n:
                spans[i] = j
                i = j + 1
                fresh = False
                continue
        if ch in STRONG or ch in WEAK:
            fresh = True
        elif not ch.isspace():
            fresh = False
        i += 1
    return spans


_LEAD = re.compile(r"(?i)(?:" + "|".join(sorted(map(re.escape, LEAD_INS), key=len, reverse=True)) + r")\b[.,:]?\s*")


def split_values(text: str | None, names: Names | None = None, spans: dict[int, int] | None = None) -> list[str]:
    """Values of the field from left to right.

    States are quotation, escape and depth of brackets; delimiters count outside all of them. With names, a value is a
    part that holds a known name, a delimiter splits only before such a name (after blanks, lead-ins and an opening
    mark), and delimiters within a name or among locators split nothing. Without names every strong delimiter splits and
    every part with a letter or digit is a value. A null, empty or blank field has no value. spans: the names' places,
    if they have been found already.
    """
    if not text or not text.strip():
        return []
    quoted = _closed(text)
    name_at = spans if spans is not None else names.spans(text) if names else {}
    if spans is not None:
        names = names or Names(())
    cuts, i, n, depth, start = [], 0, len(text), 0, 0

    # whether a name comes next, after blanks, marks and lead-ins: from the end to the front, once for each place
    follows = bytearray(n + 1)
    if name_at:
        for j in range(n - 1, -1, -1):
            if j in name_at:
                follows[j] = 1
            elif text[j].isalpha() and (m := _LEAD.match(text, j)) and m.end() > j:
                follows[j] = follows[m.end()]
            elif not (text[j].isascii() and text[j].isalnum()):
                follows[j] = follows[j + 1]

    while i < n:
        ch = text[i]
        if i in name_at:
            i = name_at[i]
            continue
        if i in quoted:
            i = quoted[i] + 1
            continue
        if ch == "\\":
            i += 2
            continue
        if ch in "([{（":
            depth += 1
        elif ch in ")]}）":
            depth = max(0, depth - 1)
        elif depth == 0:
            if names is not None:
                if (ch in STRONG or ch in WEAK or not ch.isascii()) and follows[i + 1]:
                    cuts.append((start, i))
                    start = i + 1
            elif ch in STRONG:
                cuts.append((start, i))
                start = i + 1
        i += 1
    cuts.append((start, n))
    out = []
    for a, b in cuts:
        part = text[a:b].strip().strip("".join(STRONG) + "/+, ").strip()
        while (m := _LEAD.match(part)) and m.end():
            part = part[m.end() :]
        if names is not None:
            if any(a <= s < b for s in name_at):
                out.append(_unquote(part))
        elif any(c.isalnum() for c in part):
            out.append(_unquote(part))
    return out


def _unquote(part: str) -> str:
    if len(part) > 1 and QUOTES.get(part[0]) == part[-1]:
        return part[1:-1].strip()
    return part


def packed_values(field: Column, names: Iterable[Iterable[str]] | None = None) -> Column:
    """array<string> of the field's values from left to right, empty for a null or blank field.

    names: a reference list in shards of up to PER_TRIE names. One shard is read in one pass; of several each finds the
    places where its names begin, in a pass of its own, and the last pass splits at the merged finds, so that the values
    don't depend on the number of shards.
    """
    shards = [list(dict.fromkeys(x for x in part if x)) for part in names] if names is not None else None
    if shards is None or len(shards) <= 1:
        known = shards[0] if shards else None

        @F.pandas_udf("array<string>")
        def values(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trie = Names(known) if known is not None else None
            for s in series:
                yield pd.Series([split_values(t if isinstance(t, str) else None, trie) for t in s], dtype=object)

        return values(field)

    def finder(part: list[str]):
        @F.pandas_udf("array<struct<a:int,b:int>>")
        def found(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trie = Names(part)
            for s in series:
                yield pd.Series([list(trie.spans(t, every=True).items()) if isinstance(t, str) else [] for t in s], dtype=object)

        return found

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, found: pd.Series) -> pd.Series:
        got = []
        for t, f in zip(texts, found):
            longest: dict[int, int] = {}
            for x in f if f is not None else ():
                longest[x["a"]] = max(longest.get(x["a"], 0), x["b"])
            got.append(split_values(t if isinstance(t, str) else None, None, _disjoint(longest)))
        return pd.Series(got, dtype=object)

    return split(field, F.concat(*(finder(part)(field) for part in shards)))


def explode_packed(df: DataFrame, col: str, names: Iterable[Iterable[str]] | None = None, least: int = 1, keep: list[str] | None = None) -> DataFrame:
    """One row for each value of df[col], with pos from 1 and value, besides the columns in keep (all, if None).

    Narrow: no shuffle. Fields with fewer values than least give no row; null and blank fields have no value. A long field
    is read whole. names: see packed_values.
    """
    kept = keep if keep is not None else [F.col(f"`{c}`") for c in df.columns]
    some = df.select(*kept, packed_values(F.col(col), names).alias("__v")).where(F.size("__v") >= least)
    names_ = [c for c in some.columns if c != "__v"]
    return some.select(*(F.col(f"`{c}`") for c in names_), F.posexplode("__v").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def source_names(sources: DataFrame, per: int = PER_TRIE) -> list[list[str]]:
    """Titles, aliases and sigla of a reference list in shards of about `per` names; the list is counted first."""
    names = F.filter(F.concat(F.array("title", "siglum"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    each = sources.select(F.explode(names).alias("name"))
    shards = max(1, -(-each.count() // per))
    part = lambda k: each if shards == 1 else each.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == k)
    return [[r["name"] for r in part(k).collect()] for k in range(shards)]


def packed_citations(footnotes: DataFrame, references: DataFrame, sources: DataFrame, per: int = PER_TRIE) -> DataFrame:
    """rec_kind, rec_id, pos and value of each footnote text and reference label that holds two or more works."""
    names = source_names(sources, per)
    both = footnotes.select(F.lit("footnote").alias("rec_kind"), F.col("note_key").alias("rec_id"), F.col("text").alias("field")).unionByName(
        references.select(F.lit("external_reference").alias("rec_kind"), F.col("ref_key").alias("rec_id"), F.col("label").alias("field"))
    )
    return explode_packed(both, "field", names, least=2, keep=["rec_kind", "rec_id"])

