"""Levels of a document: how they are written, read from lines in several languages, and carried over a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import ORDINAL_WORDS, clean_text, quoted_title, roman_to_int, title_case

#: The levels from the highest to the lowest.
LEVELS = ("part", "section", "chapter", "article", "paragraph")
#: How each level is written in the source, by its ordinals.
SOURCE_FORMS = (
    ("Part", r"(?i)^PART\s+(ONE|TWO|THREE|FOUR|\d+)\s*:?\s*(.+)$"),
    ("Section", r"(?i)^SECTION\s+(ONE|TWO|THREE|FOUR|\d+)\s*:?\s*(.+)$"),
    ("Chapter", r"(?i)^CHAPTER\s+(ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN|\d+)\s*:?\s*(.+)$"),
    ("Article", r"(?i)^ARTICLE\s+([0-9IVXLC]+)\s*:?\s*(.+)$"),
    ("Paragraph", r"(?i)^PARAGRAPH\s+([0-9IVXLC]+)\s*:?\s*(.+)$"),
)
#: Lines that name a level, by language, in order; the group is the title.
LINE_FORMS = {
    "fr": (
        ("part", r"^(?:PREMIERE|PREMIÈRE|DEUXIEME|DEUXIÈME|TROISIEME|TROISIÈME|QUATRIEME|QUATRIÈME)\s+PARTIE(?:\s*(.+))?$"),
        ("section", r"^(?:PREMIERE|PREMIÈRE|DEUXIEME|DEUXIÈME|TROISIEME|TROISIÈME|QUATRIEME|QUATRIÈME)\s+SECTION(?:\s*(.+))?$"),
        ("chapter", r"^CHAPITRE\s+(?:PREMIER|PREMIERE|PREMIÈRE|DEUXIEME|DEUXIÈME|TROISIEME|TROISIÈME|QUATRIEME|QUATRIÈME|CINQUIEME|CINQUIÈME|SIXIEME|SIXIÈME|SEPTIEME|SEPTIÈME|HUITIEME|HUITIÈME|NEUVIEME|NEUVIÈME|DIXIEME|DIXIÈME|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("article", r"^ARTICLE\s+\d+(?:\s*(.+))?$"),
    ),
    "de": (
        ("part", r"^(?:ERSTER|ZWEITER|DRITTER|VIERTER)\s+TEIL(?:\s*(.+))?$"),
        ("section", r"^(?:ERSTER|ZWEITER|DRITTER|VIERTER)\s+ABSCHNITT(?:\s*(.+))?$"),
        ("chapter", r"^(?:ERSTES|ZWEITES|DRITTES|VIERTES|FÜNFTES|FUNFTES|SECHSTES|SIEBTES|ACHTES|NEUNTES|ZEHNTES|[0-9IVXLC]+)\s+KAPITEL(?:\s*(.+))?$"),
        ("article", r"^ARTIKEL\s+\d+(?:\s*(.+))?$"),
    ),
    "it": (
        ("part", r"^PARTE\s+(?:PRIMA|SECONDA|TERZA|QUARTA|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("section", r"^SEZIONE\s+(?:PRIMA|SECONDA|TERZA|QUARTA|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("chapter", r"^CAPITOLO\s+(?:PRIMO|SECONDO|TERZO|QUARTO|QUINTO|SESTO|SETTIMO|OTTAVO|NONO|DECIMO|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("article", r"^ARTICOLO\s+\d+(?:\s*(.+))?$"),
    ),
    "la": (
        ("part", r"^PARS\s+(?:PRIMA|SECUNDA|TERTIA|QUARTA|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("section", r"^SECTIO\s+(?:PRIMA|SECUNDA|TERTIA|QUARTA|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("chapter", r"^CAPUT\s+(?:PRIMUM|SECUNDUM|TERTIUM|QUARTUM|QUINTUM|SEXTUM|SEPTIMUM|OCTAVUM|NONUM|DECIMUM|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("article", r"^ARTICULUS\s+\d+(?:\s*(.+))?$"),
    ),
    "es": (
        ("part", r"^(?:PRIMERA|SEGUNDA|TERCERA|CUARTA)\s+PARTE(?:\s*(.+))?$"),
        ("section", r"^(?:PRIMERA|SEGUNDA|TERCERA|CUARTA)\s+SECCI[ÓO]N(?:\s*(.+))?$"),
        ("chapter", r"^CAP[ÍI]TULO\s+(?:PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[EÉ]PTIMO|OCTAVO|NOVENO|D[EÉ]CIMO|[0-9IVXLC]+)(?:\s*(.+))?$"),
        ("article", r"^ART[ÍI]CULO\s+\d+(?:\s*(.+))?$"),
    ),
}
#: Lines that are a level's mark only; the title follows in the next line.
MARK_FORMS = {
    "zh": (
        ("part", "^卷[一二三四五六七八九十百零〇0-9]+$"),
        ("section", "^第[一二三四五六七八九十百零〇0-9]+部分$"),
        ("chapter", "^第[一二三四五六七八九十百零〇0-9]+章$"),
        ("article", "^第[一二三四五六七八九十百零〇0-9]+條$"),
    ),
    "ar": (("part", r"^الجزء(?:\s|$)"), ("section", r"^القسم(?:\s|$)"), ("chapter", r"^الفصل(?:\s|$)"), ("article", r"^المقالة(?:\s|$)")),
}


def normal_segment(c: Column) -> Column:
    """'PART ONE: THE LAMP' as 'Part 1: The Lamp'; null for what names no level."""
    t = F.regexp_replace(clean_text(c), r"\s*>\s*", " ")
    words = F.create_map(*(F.lit(x) for k, w in enumerate(ORDINAL_WORDS, 1) for x in (w, str(k))))
    out = F.lit(None).cast("string")
    for name, p in reversed(SOURCE_FORMS):
        raw = F.upper(F.regexp_extract(t, p, 1))
        n = F.coalesce(F.try_element_at(words, raw), raw) if name in ("Part", "Section", "Chapter") else raw
        out = F.when(t.rlike(p), F.concat(F.lit(name + " "), n, F.lit(": "), title_case(F.regexp_extract(t, p, 2)))).otherwise(out)
    return out


def level_of(entry: Column) -> Column:
    """Level of an entry such as 'Part 1: ...', null if it has none."""
    p = r"(?i)^(Part|Section|Chapter)\s+\d+:|^(Article|Paragraph)\s+[0-9IVXLC]+:"
    return F.when(entry.rlike(p), F.lower(F.regexp_extract(entry, r"(?i)^([a-z]+)", 1)))


def identifier(entry: Column) -> Column:
    """'part:1' of 'Part 1: ...'; empty for what has no number, so that two such entries count as one."""
    p = r"(?i)^(Part|Section|Chapter|Article|Paragraph)\s+([0-9IVXLC]+):"
    return F.when(entry.rlike(p), F.concat_ws(":", F.lower(F.regexp_extract(entry, p, 1)), F.upper(F.regexp_extract(entry, p, 2)))).when(entry.isNotNull(), "")


def split_levels(entries: Column) -> tuple[dict[str, Column], Column]:
    """({level: last entry of the level}, entries without a level)."""
    some = F.coalesce(entries, F.array().cast("array<string>"))

    def last(lv: str) -> Column:
        return F.try_element_at(F.filter(some, lambda e: level_of(e).eqNullSafe(F.lit(lv))), F.lit(-1))

    return {lv: last(lv) for lv in LEVELS}, F.filter(some, lambda e: level_of(e).isNull())


def source_levels(html: Column) -> Column:
    """Levels in a page's <meta name=part>: split at '>', written in the usual way, others dropped; empty where there is none."""
    raw = F.regexp_extract(html, r"(?i)<meta\s+name=[\"']?part[\"']?\s+content=[\"']([^\"']*)", 1)
    return F.filter(F.transform(F.split(raw, r"\s*>\s*"), normal_segment), lambda x: x.isNotNull())


def parse_line(line: Column, lang: Column) -> Column:
    """struct<kind, title> of a line that names a level in its language, null for others; the title is empty if the next line holds it."""

    def rules(x: Column) -> Column:
        t, line, lang = x["t"], x["line"], x["lang"]
        out = F.lit(None).cast("struct<kind:string,title:string>")
        for code, forms in MARK_FORMS.items():
            for kind, p in reversed(forms):
                out = F.when((lang == code) & line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit("").alias("title"))).otherwise(out)
        for code, forms in LINE_FORMS.items():
            for kind, p in reversed(forms):
                q = "(?iu)" + p
                out = F.when((lang == code) & t.rlike(q), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(t, q, 1).alias("title"))).otherwise(out)
        return out

    # bound to a name by a list of one, so that the cleaning isn't repeated in each rule
    one = F.array(F.struct(quoted_title(line, lang).alias("t"), line.alias("line"), lang.alias("lang")))
    found = F.transform(one, lambda x: F.struct(rules(x).alias("r"), x["lang"].alias("lang")))
    return F.transform(found, lambda y: F.when(y["r"].isNotNull(), F.struct(y["r"]["kind"].alias("kind"), quoted_title(y["r"]["title"], y["lang"]).alias("title"))))[0]


def titles_at_starts(lines: DataFrame, keys: list[str], order: str, line: str, lang: str, start: Column) -> DataFrame:
    """(keys, number, part, section, chapter, article) at each line that starts a paragraph, keep-first per number within the keys.

    start: the paragraph's number, null for other lines. A mark without a title takes the next line that is neither a mark nor a start.
    """
    w = W.partitionBy(*keys).orderBy(order)
    d = lines.withColumn("__n", start).withColumn("__p", F.when(F.col("__n").isNull(), parse_line(F.col(line), F.col(lang))))
    plain = F.col("__n").isNull()
    before = F.last(F.when(plain, F.struct(F.col("__p.kind").alias("k"), F.col("__p.title").alias("t"))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("__b", before)
    waits = F.when(plain & F.col("__p").isNull() & (F.col("__b.t") == ""), F.col("__b.k"))
    d = d.withColumn("__w", waits)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    for lv in LEVELS[:4]:
        got = F.when((F.col("__p.kind") == lv) & (F.col("__p.title") != ""), F.col("__p.title")).when(F.col("__w") == lv, F.col(line))
        d = d.withColumn(lv, F.last(got, ignorenulls=True).over(upto))
    rows = d.where("__n IS NOT NULL").select(*keys, order, F.col("__n").alias("number"), *LEVELS[:4])
    return rows.groupBy(*keys, "number").agg(*(F.min_by(lv, order).alias(lv) for lv in LEVELS[:4]))


def chapters_and_canons(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, key, body): chapters, then groups of canons, of a document's lines; keys chapter:n and canon:c:n, the last of a key counts.

    Lines before the first chapter and within canons before a numbered one are dropped; a rule of hyphens or a line that begins with ASS ends the text.
    """
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    t = F.col("__t")
    d = lines.withColumn("__t", clean_text(F.col(text))).where("__t <> ''")
    ended = F.max((t.rlike("^-{8,}$") | t.rlike(r"(?i)^\*?ASS\b")).cast("int")).over(upto)
    d = d.withColumn("__e", ended).where("__e = 0")
    chapter, group, canon = r"(?i)^(?:CAPUT|CAPITOLO)\s+([IVXLC]+)", r"(?i)^([IVXLC]+)\s*[.-]\s+(.+)$", r"^(\d+)\.\s*(.*)$"
    mode = F.when(t.rlike("(?i)^CANON(?:ES|I)$"), "canons").when(t.rlike(chapter), "chapters")
    d = d.withColumn("__m", mode).withColumn("__mode", F.last("__m", ignorenulls=True).over(upto)).withColumn("__blk", F.count("__m").over(upto))
    here = W.partitionBy(*keys, "__blk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    body = F.col("__m").isNull()
    in_canons = body & (F.col("__mode") == "canons")
    is_group = in_canons & t.rlike(group)
    d = d.withColumn("__g", F.last(F.when(is_group, roman_to_int(F.regexp_extract(t, group, 1))), ignorenulls=True).over(here))
    opens = in_canons & ~t.rlike(group) & t.rlike(canon) & F.col("__g").isNotNull()
    d = d.withColumn("__c", F.last(F.when(is_group, F.lit(-1)).when(opens, F.regexp_extract(t, canon, 1).try_cast("int")), ignorenulls=True).over(here))
    d = d.withColumn("__k", F.sum(F.when(opens, 1).otherwise(0)).over(here))
    head = F.last(F.when(F.col("__m") == "chapters", roman_to_int(F.regexp_extract(t, chapter, 1))), ignorenulls=True).over(here)
    d = d.withColumn("__h", head)
    key = F.when(body & (F.col("__mode") == "chapters"), F.concat(F.lit("chapter:"), F.col("__h").cast("string"))).when(
        in_canons & ~is_group & (F.col("__c") > 0), F.concat_ws(":", F.lit("canon"), F.col("__g").cast("string"), F.col("__c").cast("string"))
    )
    d = d.withColumn("key", key).where("key IS NOT NULL")
    text_ = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), t.alias("t")))), lambda x: x["t"]), " ")
    got = d.groupBy(*keys, "__blk", "__k", "key").agg(text_.alias("body"), F.min(order).alias("__o"))
    return got.groupBy(*keys, "key").agg(F.max_by("body", "__o").alias("body"))
