"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Direction marks, and white space as browsers see it (Java's \\s leaves out no-break spaces).
BIDI = r"[‎‏‪-‮⁦-⁩]"
SPACE = r"[\s   -     　﻿]+"
#: The entities that clean_text decodes, in this order.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&gt;", ">"), ("&lt;", "<"))
#: Words that stay small in a title, numerals that stay capitals, ordinal words of levels.
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
TITLE_NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
ORDINAL_WORDS = ("ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN", "ELEVEN", "TWELVE")


def strip_bidi(c: Column) -> Column:
    return F.regexp_replace(c, BIDI, "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_text(c: Column) -> Column:
    """Without direction marks, soft hyphens and zero-width spaces; five entities decoded; white space collapsed."""
    c = strip_bidi(c)
    for entity, ch in ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", ch)
    return collapse(F.regexp_replace(c, "[­​]", ""))


def preview(c: Column, most: int = 220) -> Column:
    """A text of more than `most` characters cut to most - 3, right-trimmed, with three dots."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most - 3), SPACE + "$", ""), F.lit("..."))).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case letters and digits of ASCII, everything else as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def label_key(c: Column) -> Column:
    """Lower case, without articles, other characters as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), r"\bthe\b", ""), "[^a-z0-9]+", " "))


def title_case(c: Column) -> Column:
    """Words capitalised; small words stay small but at both ends and after a period or colon; numerals up to X in capitals.

    Only a word of letters and apostrophes, with or without marks around it, is touched. Null gives null.
    """
    words = F.split(clean_text(c), " ")
    shape = r"^([^A-Za-z]*)([A-Za-z][A-Za-z']*)([^A-Za-z]*)$"

    def one(w: Column, i: Column) -> Column:
        before = F.element_at(words, F.greatest(i, F.lit(1)))
        core = F.lower(F.regexp_extract(w, shape, 2))
        keep = (i == 0) | (i == F.size(words) - 1) | before.rlike(r"[.:]$") | ~core.isin(*SMALL_WORDS)
        cased = F.when(core.isin(*TITLE_NUMERALS), F.upper(core)).when(keep, F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 1_000_000))).otherwise(core)
        return F.when(w.rlike(shape), F.concat(F.regexp_extract(w, shape, 1), cased, F.regexp_extract(w, shape, 3))).otherwise(w)

    return F.array_join(F.transform(words, one), " ")


def document_label(c: Column) -> Column:
    """A reference's label without one lead-in of each kind, in this order: cf, see also, see."""
    c = clean_text(c)
    for lead in (r"(?i)^cf\.?\s+", r"(?i)^see also\s+", r"(?i)^see\s+"):
        c = F.regexp_replace(c, lead, "")
    return collapse(c)


def book_alias(c: Column) -> Column:
    """A book's short name in lower case without periods."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\.", ""), r"\s+", " "))


def subtitle_key(c: Column) -> Column:
    """A text without tags and punctuation, in lower case: two subtitles that differ in these only are one."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), r"\s+", " ")
    return F.lower(F.trim(F.regexp_replace(c, "[.,;:!?'\"“”‘’«»()\\[\\]{}-]", "")))


def locator_token(c: Column) -> Column:
    """A locator with 'para.' as a section mark and without 'et' and 'and'."""
    c = F.regexp_replace(clean_text(c), r"(?i)\bpara(?:graph)?\.?\s*", "§ ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)\bet\s+", ""), r"(?i)\band\s+", ""))


def without_count(c: Column) -> Column:
    """A title without the range of numbers in parentheses at its end."""
    return collapse(F.regexp_replace(clean_text(c), r"\(\d+\s*-\s*\d+\)$", ""))


def quoted_title(c: Column, lang: Column) -> Column:
    """A title that stands in quotation marks as a whole, in the marks of its language; others as they are."""
    t = clean_text(c)
    inner = F.trim(F.regexp_extract(t, "^[\"„«]\\s*(.*?)\\s*[\"»]$", 1))
    marked = F.when(lang == "fr", F.concat(F.lit("«"), inner, F.lit("»"))).when(lang == "de", F.concat(F.lit("„"), inner, F.lit("“"))).otherwise(inner)
    return F.when(t.rlike("^[\"„«]\\s*(.*?)\\s*[\"»]$"), marked).otherwise(t)


def season(c: Column) -> Column:
    """Season by ordered rules; any other text as it is, trimmed; null and empty give Ordinary Time."""
    out = F.trim(c)
    #: The rules in reverse order
    for pattern, name in reversed((("holy week", "Holy Week"), ("ordinary", "Ordinary Time"), ("christmas", "Christmas"), ("advent", "Advent"), ("lent", "Lent"), ("easter", "Easter"))):
        out = F.when(F.lower(c).contains(pattern), name).otherwise(out)
    return F.when(c.isNull() | (c == ""), "Ordinary Time").otherwise(out)


def unescape_html(c: Column) -> Column:
    """The five entities that escape_html writes, decoded; the ampersand last, so that each character is decoded once."""
    for ch, entity in (("'", "&#39;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return c


def escape_pattern(c: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_html(c: Column) -> Column:
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(ch), F.lit(entity))
    return c


def roman_to_int(c: Column) -> Column:
    """Value of a Roman numeral; digits pass through; null for anything else."""
    up = F.upper(F.trim(c))
    chars = F.reverse(F.filter(F.split(up, ""), lambda x: x != ""))
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).when(x == "D", 500).otherwise(1000)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def add(acc: Column, x: Column) -> Column:
        v = value(x)
        return F.struct((acc["total"] + F.when(v < acc["last"], -v).otherwise(v)).alias("total"), v.alias("last"))

    return F.when(up.rlike("^[0-9]+$"), up.try_cast("int")).when(up.rlike("^[IVXLCDM]+$"), F.aggregate(chars, zero, add)["total"])


def int_to_roman(c: Column) -> Column:
    """Roman numeral of 1 to 3999, null outside: one lookup for each decimal place."""

    def place(unit: int, one: str, five: str, ten: str) -> Column:
        digits = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, digits)), (F.floor(c / unit) % 10 + 1).cast("int"))

    thousands = F.repeat(F.lit("M"), F.floor(c / 1000).cast("int"))
    return F.when(c.between(1, 3999), F.concat(thousands, place(100, "C", "D", "M"), place(10, "X", "L", "C"), place(1, "I", "V", "X")))


def hash32(c: Column) -> Column:
    """First eight hex digits of the SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("bigint")


def hash_pick(c: Column, options: Column, shift: Column | int = 0) -> Column:
    """The element of the array at (hash + shift) modulo its size."""
    return F.try_element_at(options, (F.pmod(hash32(c) + shift, F.size(options)) + 1).cast("int"))


def expand_numbers(c: Column, widest: int = 100, collapse_wide: bool = False) -> Column:
    """Numbers of a label in order: a-b as all of them if b >= a and b - a <= widest, singles as they are.

    A wider range gives nothing, or its start with collapse_wide; '(all)' and blank labels give the empty array.
    """
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+\s*[-–]\s*\d+|\d+)"), F.lit(1))

    def one(t: Column) -> Column:
        a = F.regexp_extract(t, r"^(\d+)", 1).try_cast("int")
        b = F.regexp_extract(t, r"[-–]\s*(\d+)$", 1).try_cast("int")
        none = F.array().cast("array<int>")
        wide = F.array(a) if collapse_wide else none
        ranged = F.when((b >= a) & (b - a <= widest), F.sequence(a, F.greatest(a, b))).when(b >= a, wide).otherwise(none)
        return F.when(b.isNull(), F.array(a)).otherwise(ranged)

    return F.filter(F.flatten(F.transform(tokens, one)), lambda x: x.isNotNull())


def number_in(c: Column) -> Column:
    """The first number in a string, null if there is none."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def join_filled(sep: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), sep)


def decode_page(content: Column) -> Column:
    """Bytes of a page as text: UTF-8 if its charset says so, else Latin-1, which reads any byte."""
    latin = F.decode(content, "ISO-8859-1")
    charset = F.lower(F.regexp_extract(latin, r"(?i)charset\s*=\s*[\"']?\s*([\w-]+)", 1))
    return F.when(charset.isin("utf-8", "utf8"), content.cast("string")).otherwise(latin)


def first_language(*candidates: Column, allowed: tuple[str, ...], default: str = "en") -> Column:
    """The first candidate that is an allowed language."""
    return F.coalesce(*(F.when(F.lower(c).isin(*allowed), F.lower(c)) for c in candidates), F.lit(default))


def query_url(base: Column, **params: Column) -> Column:
    """base?name=value&..., null parameters left out."""
    pairs = F.concat_ws("&", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in params.items()))
    return F.when(pairs == "", base).otherwise(F.concat(base, F.lit("?"), pairs))
