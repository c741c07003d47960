"""Text that looks the same in different characters, brought to one form.

Every word runs through a trie of spellings with a weighted edit automaton: ignorable characters and look-alikes cost
nothing, so all spellings that a reader can't tell apart reach the same entry, which holds the most frequent spelling of the
whole corpus. Words that reach no entry are normalised by table. The trie holds just those words whose most frequent
spelling isn't the table's, so it needs no bound, and both depend on the word's look only: two texts get one form exactly
if they look the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

#: Letters of other scripts that look like the Latin letter below them, and Arabic letters like the second row's.
CYRILLIC = "асеоіѕрхуѵјһԁԛԝӏҽАВЕНІЈКМОРСТХЅУԚԜӀ"
CYRILLIC_AS = "aceoispxyvjhdqwleABEHIJKMOPCTXSYQWI"
GREEK = "οναικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ovaikABEZHIKMNOPTYX"
ARMENIAN = "օսհցզյՕՍՏ"
ARMENIAN_AS = "ouhgqjOUS"
CHEROKEE = "ᎪᎬᎡᎢᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ"
CHEROKEE_AS = "AERTJEWMHGZbRWSVSLCPKdB"
ARABIC = "یکہۀ"
ARABIC_AS = "يكهه"
#: Ranges of compatibility forms that look like what they decompose to (letters in a circle don't).
FORMS = re.compile("[＀-￯ﬀ-ﬆ⺀-⿟豈-﫿ﭐ-﷿ﹰ-﻾Ⅰ-ⅿℊ-ℓℕℙ-ℝℤℨK-ℭℯ-ℱℳℴ\U0001d400-\U0001d7ff]")
BLANKS = re.compile("[ \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]")
#: Characters without a look that aren't of the format category: joiners, fillers, variation selectors.
SILENT = frozenset([0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
#: Spellings in one trie; more go in several, one pass each.
PER_TRIE = 100_000
#: Cost of a step of the automaton that a reader can see.
VISIBLE = 1.0

_LOOK = {a: b for x, y in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (ARABIC, ARABIC_AS)) for a, b in zip(x, y)}
_TO_CYRILLIC = {b: a for a, b in reversed(list(zip(CYRILLIC, CYRILLIC_AS)))}
_TO_GREEK = {b: a for a, b in reversed(list(zip(GREEK, GREEK_AS)))}
# words with their combining marks, which \w leaves out
_WORD = re.compile(r"\w[\w\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670]*")


@lru_cache(maxsize=100_000)
def ignorable(ch: str) -> bool:
    """Characters without a look of their own: format characters, soft hyphens, joiners, fillers, variation selectors."""
    return ord(ch) in SILENT or unicodedata.category(ch) == "Cf"


@lru_cache(maxsize=100_000)
def _look(ch: str) -> str:
    """A Latin (or plain Arabic) letter that looks like ch, accents kept."""
    got = _LOOK.get(ch)
    if got:
        return got
    parts = unicodedata.normalize("NFD", ch)
    if len(parts) > 1 and parts[0] in _LOOK:
        return unicodedata.normalize("NFC", _LOOK[parts[0]] + parts[1:])
    return ch


class _Looks(dict):
    """What each character looks like, found when it is first asked for; a table for str.translate."""

    def __missing__(self, code: int) -> str:
        got = self[code] = _look(chr(code))
        return got


_LOOKS = _Looks()
#: Ranges of the format category; with SILENT, every character without a look.
FORMAT = (
    (0xAD, 0xAD), (0x600, 0x605), (0x61C, 0x61C), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F),
    (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F),
)
_SILENT = re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in FORMAT) + "".join(map(chr, sorted(SILENT))) + "]")


def surface(text: str) -> str:
    """Without ignorables, blanks as one kind, compatibility forms resolved, accents composed."""
    if text.isascii():
        return text
    text = _SILENT.sub("", text)
    text = FORMS.sub(lambda m: unicodedata.normalize("NFKC", m.group()), BLANKS.sub(" ", text))
    return unicodedata.normalize("NFC", text)


def skeleton(word: str) -> str:
    """The look of a word: every look-alike as the Latin letter."""
    return word if word.isascii() else unicodedata.normalize("NFC", word.translate(_LOOKS))


def by_table(look: str) -> str:
    """A spelling for a look: in Cyrillic or Greek if it holds letters of that script only, else as it is."""
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in look if c.isalpha()} - {"LATIN"}
    latin = {c for c in look if c.isalpha() and unicodedata.name(c, "?").startswith("LATIN")}
    for script, table in (("CYRILLIC", _TO_CYRILLIC), ("GREEK", _TO_GREEK)):
        if scripts == {script} and latin <= table.keys():
            return "".join(table.get(c, c) for c in look)
    return look


class Trie:
    """Words with their frequencies; match() walks it with the edit automaton."""

    def __init__(self, words: dict[str, float]):
        self.root: dict = {}
        for w, n in words.items():
            at = self.root
            for ch in surface(w):
                at = at.setdefault(ch, {})
            old = at.get("")
            if old is None or (n, w) > old:
                at[""] = (n, w)

    def match(self, word: str, budget: float = 0.0) -> tuple[float, str] | None:
        """(cost, spelling) of the cheapest entry within the budget, the most frequent among equals; None if there is none."""
        best: tuple[float, float, str] | None = None
        todo = [(0.0, 0, self.root)]
        seen: dict[tuple[int, int], float] = {}
        while todo:
            cost, i, at = todo.pop()
            if seen.get((id(at), i), budget + 1) <= cost:
                continue
            seen[id(at), i] = cost
            if i == len(word):
                if "" in at:
                    n, w = at[""]
                    if best is None or (cost, -n, w) < best:
                        best = (cost, -n, w)
            else:
                ch = word[i]
                if ignorable(ch):
                    todo.append((cost, i + 1, at))
                mine = _look(ch)
                for to, child in at.items():
                    if to and (to == ch or _look(to) == mine):
                        todo.append((cost, i + 1, child))
                    elif to and cost + VISIBLE <= budget:
                        todo.append((cost + VISIBLE, i + 1, child))
                if cost + VISIBLE <= budget:
                    todo.append((cost + VISIBLE, i + 1, at))
            if cost + VISIBLE <= budget:
                todo += [(cost + VISIBLE, i, child) for to, child in at.items() if to]
        return (best[0], best[2]) if best else None


class Normalizer:
    """canonical(text) is equal for two texts exactly if they look the same, whatever spellings the trie holds."""

    def __init__(self, words: dict[str, float]):
        self.trie = Trie(words)
        self.bare = not words
        self.plain = {skeleton(surface(w)) for w in words if skeleton(surface(w)).isascii()}
        self.memo: dict[str, str] = {}

    def word(self, word: str) -> str:
        if word.isascii() and word not in self.plain:
            return word
        got = self.memo.get(word)
        if got is None:
            hit = None if self.bare else self.trie.match(word)
            got = surface(hit[1]) if hit else by_table(skeleton(word))
            if len(self.memo) < 200_000:
                self.memo[word] = got
        return got

    def canonical(self, text: str) -> str:
        if text.isascii() and not self.plain:
            return text
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: self.word(m.group()), surface(text)))

    def respelt(self, text: str) -> str:
        """A canonical text with the words that this trie holds in their spelling, the others as they are."""
        if self.bare or text.isascii() and not self.plain:
            return text

        def one(m: re.Match) -> str:
            hit = self.trie.match(m.group())
            return surface(hit[1]) if hit else m.group()

        return _WORD.sub(one, text)


def spellings(texts: DataFrame, col: str = "text", per: int = PER_TRIE) -> list[dict[str, float]]:
    """Of all rows, the words whose most frequent spelling isn't the table's, with their frequencies, in parts of about `per`.

    Words are counted JVM-side with partial sums; of the distinct ones with a character beyond ASCII the look is taken, and
    the most frequent spelling of each look. One that mixes scripts is no spelling, nor is one that comes once.
    """
    each = lambda t, name: t.select(F.explode(F.split(F.col(col), r"[^\p{L}\p{N}\p{M}]+")).alias(name))
    beyond = r"[^\x00-\x7F]"
    words = each(texts.where(F.col(col).rlike(beyond)), "w").where(F.col("w").rlike(beyond))
    mixed = F.col("w").rlike(r"\p{IsLatin}") & F.col("w").rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}]")
    counted = words.groupBy("w").agg(F.count("*").alias("n")).where(~mixed)

    @F.pandas_udf("struct<look:string,spelt:string>")
    def look(series: pd.Series) -> pd.DataFrame:
        looks = [skeleton(surface(w)) for w in series]
        return pd.DataFrame({"look": looks, "spelt": [by_table(x) for x in looks]})

    looks = counted.withColumn("l", look("w")).groupBy("l.look", "l.spelt").agg(F.max(F.struct("n", "w")).alias("m"))
    # a spelling that stands once in the corpus is no usage
    odd = materialize(looks.where("m.w <> spelt AND m.n > 1").select("look", F.col("m.n").alias("n"), F.col("m.w").alias("w")))
    plain = odd.where(~F.col("look").rlike(beyond))
    if not plain.isEmpty():
        # a look in ASCII may be spelt in ASCII as well, and more often
        usual = each(texts, "look").join(plain.select("look"), "look", "left_semi").groupBy("look").agg(F.count("*").alias("k"))
        odd = materialize(odd.join(usual, "look", "left").where("k IS NULL OR k < n").select("look", "w", "n"))
    shards = max(1, -(-odd.count() // per))
    part = lambda k: odd if shards == 1 else odd.where(F.pmod(F.xxhash64("look"), F.lit(shards)) == k)
    return [{surface(r["w"]): float(r["n"]) for r in part(k).collect()} for k in range(shards)]


def canonical(text: Column, words: list[dict[str, float]]) -> Column:
    """The one form of the text; null for null. Whole texts of any length, linear in them. words: the tries of spellings()."""

    def run_with(some: dict[str, float], first: bool):
        @F.pandas_udf("string")
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            n = Normalizer(some)
            turn = n.canonical if first else n.respelt
            for s in series:
                yield pd.Series([turn(t) if isinstance(t, str) else None for t in s], dtype=object)

        return run

    out = text
    for k, some in enumerate(words or [{}]):
        out = run_with(some, k == 0)(out)
    return out


def _keyed(rows: DataFrame, words: list[dict[str, float]], group: list[str], id_col: str, text_col: str) -> DataFrame:
    """group, rid, two hashes of the form and two of the text of each row with a text and an id; written once."""
    form = canonical(F.col(text_col), words)
    keyed = (
        rows.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
        .select(*group, F.col(id_col).alias("rid"), F.col(text_col).alias("raw"), form.alias("form"))
        .select(*group, "rid", F.xxhash64("form").alias("f1"), F.crc32("form").alias("f2"), F.xxhash64("raw").alias("r1"), F.crc32("raw").alias("r2"))
    )
    return materialize(keyed)  # five numbers a row, read several times


def alike_classes(rows: DataFrame, words: list[dict[str, float]], group: list[str], id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """group, row_id, class_id and links of each row whose text looks like another's of its group but isn't the same.

    The class is named by its smallest id; links counts the rows of the class with other characters, so copies aren't expanded
    into pairs. Rows with a null text or id are in no class.
    """
    keyed = _keyed(rows, words, group, id_col, text_col)
    key = [*group, "f1", "f2"]
    classes = keyed.groupBy(*key).agg(F.min("rid").alias("class_id"), F.count("*").alias("n"))
    same = keyed.groupBy(*key, "r1", "r2").agg(F.count("*").alias("m"))
    links = same.join(classes, key).where("n > m").select(*key, "r1", "r2", "class_id", (F.col("n") - F.col("m")).alias("links"))
    return keyed.join(links, [*key, "r1", "r2"]).select(*group, F.col("rid").alias(id_col), "class_id", "links")


def alike_pairs(rows: DataFrame, words: list[dict[str, float]], group: list[str], id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """Pairs of rows of one group whose texts look the same but aren't: group, row_id_a, row_id_b with row_id_a < row_id_b.

    Rows with a null text or id are in no pair; equal texts are none. The join is on the group and a hash of the form, so
    only rows that look alike meet, and the texts themselves aren't shuffled: two hashes of 64 bits stand for each.
    """
    keyed = _keyed(rows, words, group, id_col, text_col)
    # a look with one spelling only can't give a pair: found by aggregation first, so that crowds of exact copies aren't joined
    key = [*group, "f1", "f2"]
    several = keyed.groupBy(*key).agg(F.min("r1").alias("lo"), F.max("r1").alias("hi"), F.min("r2").alias("lo2"), F.max("r2").alias("hi2"))
    several = several.where("lo <> hi OR lo2 <> hi2").select(*key)
    keyed = keyed.join(several, key, "left_semi")
    a = keyed.select(*key, F.col("rid").alias("row_id_a"), F.col("r1").alias("a1"), F.col("r2").alias("a2"))
    b = keyed.select(*key, F.col("rid").alias("row_id_b"), F.col("r1").alias("b1"), F.col("r2").alias("b2"))
    pairs = a.join(b, key).where("row_id_a < row_id_b AND (a1 <> b1 OR a2 <> b2)")
    return pairs.select(*group, "row_id_a", "row_id_b").distinct()
