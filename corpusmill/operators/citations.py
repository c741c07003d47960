"""Citations: scripture queries, document references with locators, references to structured works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import book_alias, clean_text, document_label, locator_token, roman_to_int, slug
from corpusmill.operators.joins import small

#: Ranges of numbers of a council's constitution, with the chapter or the canons that they stand for.
NUMBER_RANGES = (
    (3001, 3003, 1, False), (3004, 3007, 2, False), (3008, 3014, 3, False), (3015, 3020, 4, False),
    (3021, 3025, 1, True), (3026, 3029, 2, True), (3030, 3035, 3, True), (3036, 3038, 4, True),
)
#: Widest range of a locator that is expanded, editions that a scripture query may name, parts of the summa.
WIDEST, EDITIONS, SUMMA_PARTS = 32, r"(?i)\s*\((?:vulg|lxx|greek|hebrew|neb)\)\s*", ("I", "I-II", "II-II", "III")
AUTHOR = r"St\.\s*Thomas\s*Aquinas"
#: Fixed values: (kind, pattern) of references to one author's works, in order; the groups are numbers, Roman where they are letters.
WORKS = (
    ("aquinas-sth", rf"(?i)^{AUTHOR},\s*STh\.?\s*([IVX]+(?:-[IVX]+)?)\s*,?\s*(\d+)[,\s]+(\d+)(.*)$"),
    ("aquinas-scg", rf"(?i)^{AUTHOR},\s*SCG\s*([IVX]+)\s*,?\s*(\d+)\.?$"),
    ("aquinas-hebrews", rf"(?i)^{AUTHOR},\s*Hebr\.\s*(\d+)\s*,\s*(\d+)\.?$"),
    ("aquinas-creed", rf"(?i){AUTHOR},\s*(?:Expos\.\s*in\s*symb\.\s*apost\.|Symb\.?,?)\s*([IVXLC]+|\d+)\.?"),
    ("aquinas-ten-commandments", rf"(?i){AUTHOR},\s*Dec\.\s*pr[æa]c\.\s*([IVXLC]+|\d+)\.?"),
    ("aquinas-psalms", rf"(?i)^{AUTHOR},\s*Expos\.\s*in\s*Ps\.\s*(\d+)\s*,\s*(\d+)\.?$"),
    ("aquinas-de-malo", rf"(?i)^{AUTHOR},\s*De Malo\s*(\d+)\s*,\s*(\d+)\.?$"),
    ("aquinas-sentences", rf"(?i)^{AUTHOR},\s*Sent\.\s*([IVX]+)\s*,\s*Prol\.?$"),
    ("aquinas-adoro-te", rf"(?i){AUTHOR}\s*\(attr\.\),\s*Adoro te devote"),
)
#: Number of pattern groups that make the identifier of each kind.
WORK_PARTS = {"aquinas-scg": 2, "aquinas-hebrews": 2, "aquinas-creed": 1, "aquinas-ten-commandments": 1, "aquinas-psalms": 2, "aquinas-de-malo": 2}


def book_aliases(sources: DataFrame) -> DataFrame:
    """(alias, book_id, book) of every scripture of a reference list; an alias of several books goes to the smallest id."""
    names = F.concat(F.array("title", "siglum"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = sources.where("kind = 'scripture'").select("id", "title", F.explode(names).alias("n")).where("n IS NOT NULL")
    return each.groupBy(book_alias(F.col("n")).alias("alias")).agg(F.min("id").alias("book_id"), F.min_by("title", "id").alias("book"))


def scripture_queries(refs: DataFrame, books: DataFrame, key: str, label: str) -> DataFrame:
    """(key, pos, book_id, book, query) of each segment of a scripture label, book and chapter carried over semicolons.

    A segment that names an unknown book is left out and changes nothing; a number alone is a place in the current
    chapter. Null labels and segments before the first known book give no row.
    """
    text = F.trim(F.regexp_replace(document_label(F.col(label)), EDITIONS, ""))
    named = r"^((?:[1-3]\s*)?[A-Za-z][A-Za-z. ]+?)\s+(\d.*)$"
    seg = refs.where(F.col(label).isNotNull()).select(key, F.posexplode(F.split(text, r"\s*;\s*")).alias("pos", "s"))
    seg = seg.withColumn("s", F.trim("s")).where("s <> ''").withColumn("direct", F.col("s").rlike(named))
    seg = seg.withColumn("alias", F.when(F.col("direct"), book_alias(F.regexp_extract("s", named, 1))))
    seg = seg.withColumn("rest", F.when(F.col("direct"), F.trim(F.regexp_extract("s", named, 2))).otherwise(F.col("s")))
    seg = seg.join(small(books), "alias", "left").where("book_id IS NOT NULL OR (NOT direct AND s RLIKE '^[0-9]')")
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    told = F.when(F.col("direct") | F.contains("s", F.lit(":")), F.regexp_extract("rest", r"^(\d+)", 1).try_cast("int"))
    seg = seg.withColumn("chapter", F.last(told, ignorenulls=True).over(w))
    for c in ("book_id", "book"):
        seg = seg.withColumn(c, F.last(c, ignorenulls=True).over(w))
    place = F.when(F.col("direct") | F.contains("s", F.lit(":")), F.col("rest")).otherwise(F.concat_ws(":", F.col("chapter").cast("string"), "s"))
    return seg.where("book_id IS NOT NULL").select(key, "pos", "book_id", "book", F.concat_ws(" ", "book", place).alias("query"))


def verse_numbers(token: Column) -> Column:
    """Numbers of 'a-b' or 'a'; the empty array for anything else and for b < a."""
    t = F.trim(token)
    a, b = F.regexp_extract(t, r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(t, r"^(\d+)-(\d+)$", 2).try_cast("int")
    one = F.regexp_extract(t, r"^(\d+)$", 1).try_cast("int")
    none = F.array().cast("array<int>")
    return F.when(one.isNotNull(), F.array(one)).when(b >= a, F.sequence(a, F.greatest(a, b))).otherwise(none)


def selections(queries: DataFrame, single: tuple[str, ...] = ()) -> DataFrame:
    """queries with one row for each selection: sel, chapter, and verses (a list), or lo and hi (an open range), or all three null (all).

    single: ids of books of one chapter, whose number is a verse. A query without a number gives no row.
    """
    shape = r"^(.+?)\s+(\d+)(?::(.+))?$"
    n = F.regexp_extract("query", shape, 2).try_cast("int")
    spec0 = F.nullif(F.trim(F.regexp_extract("query", shape, 3)), F.lit(""))
    alone = F.col("book_id").isin(*single) if single else F.lit(False)
    q = queries.where(F.col("query").rlike(shape)).withColumn("__c", F.when(spec0.isNull() & alone, 1).otherwise(n))
    q = q.withColumn("__spec", F.coalesce(spec0, F.when(alone, n.cast("string"))))
    cross = r"^(\d+):(\d+)-(\d+):(\d+)$"

    def row(chapter: Column, verses: Column | None, lo: Column | None, hi: Column | None) -> Column:
        none = F.lit(None)
        v = none.cast("array<int>") if verses is None else verses
        return F.struct(chapter.cast("int").alias("chapter"), v.alias("verses"), (none if lo is None else lo).cast("int").alias("lo"), (none if hi is None else hi).cast("int").alias("hi"))

    def token(t: Column) -> Column:
        a, b, c, d = (F.regexp_extract(t, cross, k).try_cast("int") for k in (1, 2, 3, 4))
        within = F.when(d >= b, F.sequence(b, F.greatest(b, d))).otherwise(F.array().cast("array<int>"))
        over = F.transform(
            F.sequence(a, F.greatest(a, c)),
            lambda k: F.when((k == a) & (k == c), row(k, within, None, None)).when(k == a, row(k, None, b, None)).when(k == c, row(k, None, F.lit(1), d)).otherwise(row(k, None, None, None)),
        )
        nothing = F.array().cast("array<struct<chapter:int,verses:array<int>,lo:int,hi:int>>")
        own = F.when(t.rlike(r"^(\d+):(.+)$"), F.regexp_extract(t, r"^(\d+):", 1).try_cast("int")).otherwise(F.col("__c"))
        vs = verse_numbers(F.regexp_replace(t, r"^\d+:", ""))
        return F.when(t.rlike(cross), F.when(c >= a, over).otherwise(nothing)).when(F.size(vs) > 0, F.array(row(own, vs, None, None))).otherwise(nothing)

    tokens = F.split("__spec", r"\s*,\s*")
    sel = F.when(F.col("__spec").isNull(), F.array(row(F.col("__c"), None, None, None))).otherwise(F.flatten(F.transform(tokens, token)))
    return q.select(*queries.columns, F.posexplode(sel).alias("sel", "__s")).select(*queries.columns, "sel", "__s.*")


def selected_verses(sel: DataFrame, verses: DataFrame) -> DataFrame:
    """Rows of verses(chapter, verse, text) that each selection takes: all of the chapter, the listed ones, or an open range."""
    v = verses.select(F.col("chapter").alias("__vc"), "verse", "text")
    some = F.col("verses").isNotNull()
    fits = F.when(some, F.array_contains("verses", F.col("verse"))).otherwise((F.col("verse") >= F.coalesce("lo", F.lit(0))) & (F.col("verse") <= F.coalesce("hi", F.lit(2147483647))))
    return sel.join(v, (F.col("chapter") == F.col("__vc")) & fits).drop("__vc")


def rendered(picked: DataFrame, key: str) -> DataFrame:
    """(key, content): 'book chapter: n. text n. text' of each selection in order, joined by blanks."""
    g = picked.groupBy(key, "pos", "sel", "book", "chapter").agg(F.sort_array(F.collect_list(F.struct("verse", F.concat(F.col("verse").cast("string"), F.lit(". "), clean_text(F.col("text"))).alias("t")))).alias("vs"))
    g = g.select(key, "pos", "sel", F.concat(F.concat_ws(" ", "book", F.col("chapter").cast("string")), F.lit(": "), F.array_join(F.transform("vs", lambda x: x["t"]), " ")).alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "sel", "part")))
    return g.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), " ").alias("content"))


def catalog_match(refs: DataFrame, catalog: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, entry_id, title, locator): the first entry of catalog(id, siglum, title, aliases), by id, that a label names.

    An entry is named by its siglum as a word, by an alias or by its title, without regard to case; the locator is what
    follows the first of these that the label holds. The catalog is one row beside each label if it is small, else an
    inequality join of the distinct labels. Labels that name none give no row.
    """
    lab = refs.where(F.col(label).isNotNull()).select(key, document_label(F.col(label)).alias("label"))
    entry = F.struct("id", "title", F.concat(F.array(F.struct(F.lit(1).alias("s"), F.col("siglum").alias("n"))), F.transform(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("title")), lambda a: F.struct(F.lit(0).alias("s"), a.alias("n")))).alias("names"))
    cat = catalog.select(entry.alias("e"))

    def holds(text: Column, n: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), n["n"], F.lit("\\E"))
        word = F.concat(F.lit(r"(?iu)(?:^|[\s,(;])"), quoted, F.lit(r"(?=$|[\s,;:§])"))
        return n["n"].isNotNull() & F.contains(F.lower(text), F.lower(n["n"])) & ((n["s"] == 0) | F.call_function("rlike", text, word))

    named = lambda e: F.exists(e["names"], lambda n: holds(F.col("label"), n))
    if catalog.limit(5001).count() <= 5000:
        one = cat.agg(F.sort_array(F.collect_list("e")).alias("es"))  # a row, small by the count above
        hit = lab.crossJoin(F.broadcast(one)).withColumn("e", F.try_element_at(F.filter("es", named), F.lit(1))).where("e IS NOT NULL").drop("es")
    else:
        distinct = lab.select("label").distinct()
        found = distinct.join(cat, named(F.col("e"))).groupBy("label").agg(F.min("e").alias("e"))
        hit = lab.join(found, "label")
    name = F.try_element_at(F.filter(F.col("e")["names"], lambda n: holds(F.col("label"), n)), F.lit(1))
    hit = hit.withColumn("__n", name)
    quoted = F.concat(F.lit("\\Q"), F.col("__n")["n"], F.lit("\\E"))
    pattern = F.when(F.col("__n")["s"] == 1, F.concat(F.lit(r"(?isu)(?:^|[\s,(;])"), quoted, F.lit(r"((?:$|[\s,;:§]).*)$"))).otherwise(F.concat(F.lit("(?isu)"), quoted, F.lit("(.*)$")))
    rest = F.call_function("regexp_extract", F.col("label"), pattern, F.lit(1))
    return hit.select(key, "label", F.col("e.id").alias("entry_id"), F.col("e.title").alias("title"), F.regexp_replace(rest, r"^[\s,:-]+", "").alias("locator"))


def locator(c: Column) -> Column:
    """struct<sections array<int>, pins array<struct<section,pin>>> of a locator.

    Tokens between commas and semicolons: 'a-b' and 'a' are sections (a range wider than 32 its start), '§ n' is a pinpoint
    of the latest section, also right after it. Each section and pinpoint once, in order; others say nothing.
    """
    tokens = F.filter(F.transform(F.split(locator_token(c), r"\s*;\s*|\s*,\s*"), lambda t: F.trim(t)), lambda t: t != "")
    pin_type = "array<struct<section:int,pin:int>>"
    zero = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<int>").alias("sections"), F.array().cast(pin_type).alias("pins"))
    span = r"^(\d+)\s*-\s*(\d+)(?:\s*§+\s*(\d+))?"
    single = r"^(\d+)(?:\s*§+\s*(\d+))?"

    def pinned(section: Column, pin: Column) -> Column:
        return F.array(F.struct(section.alias("section"), pin.alias("pin"))).cast(pin_type)

    def step(acc: Column, t: Column) -> Column:
        mark = t.rlike(r"^§+\s*")
        pin = F.regexp_extract(t, r"^§+\s*(\d+)", 1).try_cast("int")
        ranged = t.rlike(span)
        a = F.regexp_extract(t, r"^(\d+)", 1).try_cast("int")
        b = F.when(ranged, F.regexp_extract(t, span, 2).try_cast("int")).otherwise(a)
        end = F.when(b - a > WIDEST, a).otherwise(b)
        new = F.when(end >= a, F.sequence(a, F.greatest(a, end))).otherwise(F.array().cast("array<int>"))
        inline = F.when(ranged, F.regexp_extract(t, span, 3)).otherwise(F.regexp_extract(t, single, 2)).try_cast("int")
        replaced = F.concat(F.filter(acc["pins"], lambda p: p["section"] != a), pinned(a, inline))
        row = lambda at, sections, pins: F.struct(at.alias("at"), sections.alias("sections"), pins.alias("pins"))
        with_pin = F.when(acc["at"].isNotNull() & pin.isNotNull(), F.array_distinct(F.concat(acc["pins"], pinned(acc["at"], pin)))).otherwise(acc["pins"])
        return F.when(mark, row(acc["at"], acc["sections"], with_pin)).when(a.isNotNull(), row(a, F.array_distinct(F.concat(acc["sections"], new)), F.when(inline.isNotNull(), replaced).otherwise(acc["pins"]))).otherwise(acc)

    got = F.aggregate(tokens, zero, step)
    return F.struct(got["sections"].alias("sections"), got["pins"].alias("pins"))


def source_parts(parsed: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(key, n, text): one labelled block for each requested section that exists, in request order.

    parsed(key, title, sections), sections(number, text).
    """
    want = parsed.select(key, "title", F.posexplode("sections").alias("n", "number"))
    return want.join(sections, "number").select(key, F.col("n").cast("bigint").alias("n"), F.concat(F.col("title"), F.lit(" "), F.col("number").cast("string"), F.lit(". "), clean_text(F.col("text"))).alias("text"))


def section_of_number(df: DataFrame, number: str) -> DataFrame:
    """df with the section key of a running number, by the first range that holds it; no row where none does."""
    ranges = df.sparkSession.createDataFrame(NUMBER_RANGES, "lo int, hi int, chapter int, canon boolean")
    hit = df.join(small(ranges), F.col(number).between(F.col("lo"), F.col("hi")))
    k = F.when(F.col("canon"), F.concat_ws(":", F.lit("canon"), F.col("chapter").cast("string"), (F.col(number) - F.col("lo") + 1).cast("string"))).otherwise(F.concat_ws(":", F.lit("chapter"), F.col("chapter").cast("string")))
    return hit.select(*df.columns, k.alias("section_key"))



def pinpoint(c: Column) -> Column:
    """Kind of the place in an article (sed-contra, corpus, objection:n, reply:n), null if there is none."""
    s = F.trim(F.regexp_replace(F.regexp_replace(clean_text(c), r"(?i),\s*art\.?$", ""), r"(?i)\bcorp\.?\s*art\.?", " corp. "))
    obj, reply = r"(?i)\bobj\.?\s*([IVXLC]+|\d+)", r"(?i)\bad\s*([IVXLC]+|\d+)"
    tagged = lambda name, p: F.concat_ws(":", F.lit(name), roman_to_int(F.regexp_extract(s, p, 1)).cast("string"))
    return (
        F.when(s == "", None).when(s.rlike(r"(?i)\bs\.\s*c\.") | s.rlike("(?i)sed contra"), "sed-contra").when(s.rlike(r"(?i)\b(?:corp\.?|corpus|c\.)\b"), "corpus")
        .when(s.rlike(obj), tagged("objection", obj)).when(s.rlike(reply), tagged("reply", reply))
    )


def work_reference(label: Column) -> Column:
    """struct<kind, source, pinpoint> of a reference to one of the author's works, null if it is none; the first pattern that fits counts."""
    text = document_label(label)
    num = lambda p, k: roman_to_int(F.regexp_extract(text, p, k)).cast("string")
    out = F.lit(None).cast("struct<kind:string,source:string,pinpoint:string>")
    for kind, p in reversed(WORKS):
        pin = F.lit(None).cast("string")
        ok = text.rlike(p)
        if kind == "aquinas-sth":
            part, tail = F.upper(F.regexp_extract(text, p, 1)), F.regexp_extract(text, p, 4)
            raw = F.concat_ws("-", part, F.regexp_extract(text, p, 2), F.regexp_extract(text, p, 3), F.when(tail == "", "full").otherwise(tail))
            source, pin = F.concat(F.lit(f"document:{kind}:"), slug(raw)), pinpoint(tail)
            known = part.isin(*SUMMA_PARTS)
        elif kind == "aquinas-adoro-te":
            source, known = F.lit(f"document:{kind}"), F.lit(True)
        elif kind == "aquinas-sentences":
            source, known = F.concat(F.lit(f"document:{kind}:"), num(p, 1), F.lit("-prologue")), num(p, 1).isNotNull()
        else:
            nums = [num(p, k + 1) for k in range(WORK_PARTS[kind])]
            source = F.concat(F.lit(f"document:{kind}:"), F.concat_ws("-", *nums))
            known = nums[0].isNotNull()
        row = F.struct(F.lit(kind).alias("kind"), source.alias("source"), pin.alias("pinpoint"))
        out = F.when(ok & known, row).when(ok, F.lit(None).cast("struct<kind:string,source:string,pinpoint:string>")).otherwise(out)
    return out


def article_cell(c: Column) -> Column:
    """Kind of a cell of an article (objection:n, reply:n, sed-contra, corpus) by how it begins, null for others."""
    t = clean_text(c)
    numbered = lambda name, p: F.concat_ws(":", F.lit(name), F.regexp_extract(t, p, 1))
    o, r = r"(?i)^Objection\s+(\d+):", r"(?i)^Reply to Objection\s+(\d+):"
    return F.when(t.rlike(o), numbered("objection", o)).when(t.rlike(r), numbered("reply", r)).when(t.rlike("(?i)^On the contrary,"), "sed-contra").when(t.rlike("(?i)^I answer that,"), "corpus")


def canon_range(url: Column) -> Column:
    """struct<lo, hi> of the numbers in a page's address, null if it names none."""
    p = r"(?i)cann?(\d+)-(\d+)"
    return F.when(url.rlike(p), F.struct(F.regexp_extract(url, p, 1).try_cast("int").alias("lo"), F.regexp_extract(url, p, 2).try_cast("int").alias("hi")))


def scripture_pattern(names: list[str]) -> str:
    """Pattern of a label that begins with a book's name, after a lead-in and a number of the book."""
    import re

    return r"(?i)^(?:cf\.\s+|see\s+|see also\s+)?(?:[1-3i]{0,3}\s*)?(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")\b"
