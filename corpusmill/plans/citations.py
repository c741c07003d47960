"""Citation and hierarchy queries: scripture, document references, structured works, levels in several languages, verse layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import document_label, int_to_roman
from corpusmill.operators import citations as C
from corpusmill.operators import hierarchy as H
from corpusmill.operators import segment as S
from corpusmill.plans.graphs import N, nodes
from corpusmill.plans.sqltext import CLEAN, LABEL, SEGMENTS
from corpusmill.session import table

#: Marks of a level in each language, with and without a title of their own, as (lang, kind, line).
MARKS = (
    ("fr", "part", "PREMIÈRE PARTIE"), ("fr", "chapter", "CHAPITRE PREMIER"), ("de", "part", "ERSTER TEIL"), ("de", "article", "ARTIKEL 3"), ("it", "section", "SEZIONE PRIMA"),
    ("la", "chapter", "CAPUT SECUNDUM"), ("es", "section", "SEGUNDA SECCIÓN"), ("zh", "chapter", "第二章"), ("ar", "article", "المقالة 1"),
)
AUTHOR = "St. Thomas Aquinas"


def _labels(spark, d):
    return table(spark, d, "external_references").where("label IS NOT NULL").select("ref_key", "label", "kind")


def _books(spark, d):
    return C.book_aliases(table(spark, d, "external_sources"))


def _scripture_pattern(spark, d):
    """The pattern of the books' names; the list is counted, as the pattern goes to every worker."""
    books = _books(spark, d).select("alias")
    n = books.count()
    if n > 20_000:
        raise ValueError(f"{n} names of books; a pattern may have 20000")
    return C.scripture_pattern(sorted(r["alias"] for r in books.collect()))


def _queries(spark, d):
    return C.scripture_queries(_labels(spark, d).where("kind = 'scripture'"), _books(spark, d), "ref_key", "label")


def _verses(spark, d):
    """The lines of each node as the verses of a chapter."""
    n = nodes(spark, d, "text").where("text IS NOT NULL")
    return n.select(F.col("id").alias("chapter"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("chapter", (F.col("p") + 1).alias("verse"), "text")


def cit_classify(spark, d):
    """SCL-13: scripture or document, by the books' names that a label begins with."""
    return _labels(spark, d).select("ref_key", F.when(document_label(F.col("label")).rlike(_scripture_pattern(spark, d)), "scripture").otherwise("document").alias("kind"))


def cit_scripture(spark, d):
    """SCL-14: segments of scripture labels, book and chapter carried over semicolons."""
    return _queries(spark, d).select("ref_key", F.col("pos").cast("bigint").alias("pos"), "book_id", "query")


def cit_selections(spark, d):
    """SCL-15: chapter with listed verses, an open range, or all, of each scripture segment."""
    s = C.selections(_queries(spark, d))
    return s.select("ref_key", F.col("pos").cast("bigint").alias("pos"), F.col("sel").cast("bigint").alias("sel"), F.col("chapter").cast("bigint").alias("chapter"), F.array_join(F.col("verses").cast("array<string>"), ",").alias("verses"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


def cit_rendered(spark, d):
    """SCL-16, SRC-21, JOIN-09, AGG-08: the selected verses of each scripture reference as one text."""
    return C.rendered(C.selected_verses(C.selections(_queries(spark, d)), _verses(spark, d)), "ref_key")


def cit_documents(spark, d):
    """SCL-17, JOIN-06: the first work of the list that each label names, and the locator after its name."""
    got = C.catalog_match(_labels(spark, d), table(spark, d, "external_sources").where("siglum IS NOT NULL"), "ref_key", "label")
    return got.select("ref_key", "entry_id", "locator")


def cit_locators(spark, d):
    """SCL-12, SET-06: sections and pinpoints of each document reference, in order, each once."""
    got = C.catalog_match(_labels(spark, d), table(spark, d, "external_sources").where("siglum IS NOT NULL"), "ref_key", "label")
    got = got.select("ref_key", C.locator(F.col("locator")).alias("l"))
    pins = F.transform("l.pins", lambda p: F.concat_ws(":", p["section"].cast("string"), p["pin"].cast("string")))
    return got.select("ref_key", F.array_join(F.col("l.sections").cast("array<string>"), ",").alias("sections"), F.array_join(F.array_sort(pins), ",").alias("pins"))


def cit_parts(spark, d):
    """PRJ-14: one labelled block for each section that a reference asks for and the nodes hold, in request order."""
    got = C.catalog_match(_labels(spark, d), table(spark, d, "external_sources").where("siglum IS NOT NULL"), "ref_key", "label")
    got = got.select("ref_key", "title", C.locator(F.col("locator"))["sections"].alias("sections"))
    sections = nodes(spark, d, "title").where("title IS NOT NULL").select(F.col("id").alias("number"), F.col("title").alias("text"))
    return C.source_parts(got, sections, "ref_key")


def cit_works(spark, d):
    """SCL-18: kind, source and pinpoint of references to one author's works, over labels in all nine forms."""
    n = nodes(spark, d).select("id")
    num, rom = F.col("id").cast("string"), int_to_roman(F.col("id") % 4 + 1)
    forms = (
        F.concat(F.lit(f"Cf. {AUTHOR}, STh "), rom, F.lit(", "), num, F.lit(", 2 ad "), int_to_roman(F.col("id") % 5 + 1)),
        F.concat(F.lit(f"{AUTHOR}, STh II-II, "), num, F.lit(", 7, s. c.")),
        F.concat(F.lit(f"{AUTHOR}, STh I-II, 3, "), num, F.lit(", obj. 2")),
        F.concat(F.lit(f"{AUTHOR}, SCG "), rom, F.lit(", "), num, F.lit(".")),
        F.concat(F.lit(f"{AUTHOR}, Hebr. "), num, F.lit(", 4")),
        F.concat(F.lit(f"see {AUTHOR}, Symb., "), rom, F.lit(".")),
        F.concat(F.lit(f"{AUTHOR}, Dec. præc. "), rom, F.lit(".")),
        F.concat(F.lit(f"{AUTHOR}, Expos. in Ps. "), num, F.lit(",1.")),
        F.concat(F.lit(f"{AUTHOR}, De Malo 4, "), num),
        F.concat(F.lit(f"{AUTHOR}, Sent. "), rom, F.lit(", Prol.")),
        F.lit(f"{AUTHOR} (attr.), Adoro te devote"),
        F.concat(F.lit(f"{AUTHOR}, Letter "), num),
    )
    n = n.select("id", F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("label"))
    return n.select("id", C.work_reference(F.col("label")).alias("w")).select("id", "w.kind", "w.source", "w.pinpoint")


def cit_cells(spark, d):
    """EXT-20: cells of an article by how they begin."""
    n = nodes(spark, d, "title").where("title IS NOT NULL")
    heads = F.array(F.concat(F.lit("Objection "), F.col("id").cast("string"), F.lit(": ")), F.concat(F.lit("Reply to Objection "), F.col("id").cast("string"), F.lit(": ")), F.lit("On the contrary, "), F.lit("I answer that, "), F.lit(""))
    return n.select("id", C.article_cell(F.concat(F.element_at(heads, (F.col("id") % 5 + 1).cast("int")), "title")).alias("cell"))


def cit_canon_range(spark, d):
    """SCL-19, SRC-19: range of numbers in an address, and the pages in order of their first number."""
    n = nodes(spark, d).select("id", F.concat(F.lit("https://hortus.example/eng_cann"), F.col("id").cast("string"), F.lit("-"), (F.col("id") + 9).cast("string"), F.lit("_en.html")).alias("url"))
    r = C.canon_range(F.col("url"))
    return n.select("id", r["lo"].cast("bigint").alias("lo"), r["hi"].cast("bigint").alias("hi"))


def cit_number_ranges(spark, d):
    """JOIN-08, SCL-17: chapter or canon of a running number, by the first range that holds it."""
    n = nodes(spark, d).select("id", (F.col("id") + 2990).alias("number"))
    return C.section_of_number(n, "number").select("id", "section_key")


def ext_references(spark, d):
    """EXT-23: references of the footnotes with ids note:kind:n; segments that only continue are joined to the document before."""
    return S.references(S.note_segments(table(spark, d, "footnotes"), "note_key", "text"), "note_key", F.col("label").rlike(_scripture_pattern(spark, d)))


def hier_segments(spark, d):
    """PRJ-04, EXT-11: breadcrumbs written as levels, the last of each level, and the entries without a level."""
    n = nodes(spark, d, "breadcrumbs").select("id", F.transform("breadcrumbs", lambda b: F.coalesce(H.normal_segment(b), b)).alias("b"))
    at, extras = H.split_levels(F.col("b"))
    return n.select("id", at["part"].alias("part"), at["chapter"].alias("chapter"), F.array_join(extras, " | ").alias("extras"))


def hier_meta(spark, d):
    """EXT-11: levels in a page's meta element, from pages that name their file and language there."""
    p = table(spark, d, "source_pages").where("lang IS NOT NULL")
    html = F.concat(F.lit('<html><head><META name="part" content="PART TWO: '), "lang", F.lit(" > nothing > CHAPTER FOUR of the "), "lang", F.lit(' > ARTICLE ix: a word"></head></html>'))
    return p.select("page_id", F.array_join(H.source_levels(html), " | ").alias("levels"))


def _marked(spark, d):
    marks = spark.createDataFrame(MARKS, "lang string, kind string, mark string")
    loc = table(spark, d, "localized_nodes").where("title IS NOT NULL").select("row_id", "lang", "title")
    return loc.join(F.broadcast(marks), "lang")  # nine rows


def hier_lines(spark, d):
    """EXT-12, EXT-13: kind and title of lines that name a level, in seven languages, with their title or without."""
    m = _marked(spark, d).select("row_id", "lang", "kind", F.concat("mark", F.lit(" "), "title").alias("line"), "mark")
    got = m.select("row_id", "kind", H.parse_line(F.col("line"), F.col("lang")).alias("a"), H.parse_line(F.col("mark"), F.col("lang")).alias("b"))
    return got.select("row_id", "kind", F.col("a.kind").alias("with_title"), F.col("b.kind").alias("alone"), F.coalesce("b.title", F.lit("-")).alias("alone_title"))


def hier_titles(spark, d):
    """EXT-14, EXT-15: levels carried down the lines of a page, a mark without a title taking the next line; emitted at paragraph starts."""
    m = _marked(spark, d).select("row_id", "lang", "kind", "mark", "title")
    lines = F.array(F.lit("a line before"), F.col("mark"), F.concat(F.lit("12. start of "), "kind"), F.concat("title", F.lit(" of "), "kind"), F.lit("13. next start"), F.lit("plain"), F.lit("13. again"))
    ls = m.select("row_id", "kind", "lang", F.posexplode(lines).alias("pos", "line"))
    start = S.paragraph_start(F.col("line"))["id"]
    got = H.titles_at_starts(ls, ["row_id", "kind"], "pos", "line", "lang", start)
    title = F.coalesce("part", "section", "chapter", "article")
    return got.select("row_id", "kind", F.col("number").cast("bigint").alias("number"), title.alias("title"))


def ext_two_levels(spark, d):
    """EXT-08: preface, chapters and groups of canons of a document, keyed chapter:n and canon:c:n."""
    n = nodes(spark, d, "title").where("title IS NOT NULL")
    lines = F.array(F.lit("preface"), F.lit("CAPUT I"), F.concat(F.lit("on "), "title"), F.col("title"), F.lit("CAPUT II"), F.lit("more"), F.lit("CANONES"), F.lit("stray"), F.lit("I. - On "), F.lit("II. - On the second"), F.concat(F.lit("1. "), "title"), F.lit("goes on"), F.lit("2. Another"), F.lit("III. - Third"), F.lit("lost"), F.lit("1. Last"), F.lit("----------"), F.lit("2. after the end"))
    return H.chapters_and_canons(n.select("id", F.posexplode(lines).alias("pos", "line")), ["id"], "pos", "line")


def _verse_lines(spark, d, lines):
    n = nodes(spark, d, "title").where("title IS NOT NULL")
    return n.select("id", F.posexplode(lines).alias("pos", "line"))


def ext_verses_apart(spark, d):
    """EXT-10: verses whose number stands in a paragraph of its own."""
    lines = F.array(F.lit("Heading"), F.lit("1"), F.col("title"), F.lit("no verse"), F.lit("2"), F.lit("3"), F.concat(F.lit("3 "), "title"), F.lit(" "), F.lit("4"))
    got = S.verses_apart(_verse_lines(spark, d, lines), ["id"], "pos", "line")
    return got.select("id", F.col("verse").cast("bigint").alias("verse"), "text")


def ext_verses_bracketed(spark, d):
    """EXT-10: '[n] text' lines, other lines continue the verse."""
    lines = F.array(F.lit("Heading"), F.concat(F.lit("[1] "), "title"), F.lit("goes  on"), F.lit("[2]"), F.lit("[3] "), F.col("title"))
    got = S.verses_marked(_verse_lines(spark, d, lines), ["id"], "pos", "line", r"^\[(\d+)\]\s*(.*)$")
    return got.select("id", F.col("verse").cast("bigint").alias("verse"), "text")


def ext_verses_inline(spark, d):
    """EXT-10: paragraphs 'n text'; all others are left out."""
    lines = F.array(F.lit("Heading"), F.concat(F.lit("1 "), "title"), F.lit("left out"), F.lit("2"), F.concat(F.lit("3 and "), "title"))
    got = S.verses_inline(_verse_lines(spark, d, lines), ["id"], "pos", "line")
    return got.select("id", F.col("verse").cast("bigint").alias("verse"), "text")


def ext_verses_anchored(spark, d):
    """EXT-10: chapters that an anchor opens, within them 'n text' lines, other lines continue the verse."""
    n = nodes(spark, d, "title").where("title IS NOT NULL")
    rows = F.array(*(F.struct(F.lit(a).cast("int").alias("anchor"), x.alias("line")) for a, x in ((None, F.lit("1 before any")), (1, F.lit("Chapter")), (None, F.concat(F.lit("1 "), "title")), (None, F.lit("more")), (2, F.lit("2 second")), (None, F.col("title")))))
    ls = n.select("id", F.posexplode(rows).alias("pos", "r")).select("id", "pos", "r.anchor", "r.line")
    got = S.verses_anchored(ls, ["id"], "pos", "line", "anchor")
    return got.select("id", F.col("chapter").cast("bigint").alias("chapter"), F.col("verse").cast("bigint").alias("verse"), "text")


def ext_verses_numbered(spark, d):
    """EXT-10: 'c:v text' lines, other lines continue the verse; verses without a text are left out."""
    lines = F.array(F.lit("Heading"), F.concat(F.lit("1:1 "), "title"), F.lit("goes on"), F.lit("1:2"), F.lit("2:1"), F.col("title"))
    got = S.verses_by_place(_verse_lines(spark, d, lines), ["id"], "pos", "line")
    return got.select("id", F.col("chapter").cast("bigint").alias("chapter"), F.col("verse").cast("bigint").alias("verse"), "text")


QUERIES = {
    f.__name__: f
    for f in (
        cit_classify, cit_scripture, cit_selections, cit_rendered, cit_documents, cit_locators, cit_parts, cit_works, cit_cells, cit_canon_range, cit_number_ranges, ext_references, hier_segments,
        hier_meta, hier_lines, hier_titles, ext_two_levels, ext_verses_apart, ext_verses_bracketed, ext_verses_inline, ext_verses_anchored, ext_verses_numbered,
    )
}

_ALIAS = r"trim(regexp_replace(regexp_replace(lower({0}), '\.', '', 'g'), '\s+', ' ', 'g'))"
_BOOKS = f"""bn AS (SELECT id, title, unnest(list_concat([title, siglum], coalesce(aliases, []))) AS nm FROM external_sources WHERE kind = 'scripture'),
b AS (SELECT {_ALIAS.format('nm')} AS alias, min(id) AS book_id, arg_min(title, id) AS book FROM bn WHERE nm IS NOT NULL GROUP BY 1)"""
_NAMED = r"^((?:[1-3]\s*)?[A-Za-z][A-Za-z. ]+?)\s+(\d.*)$"
_SCRIPTURE = f"""{_BOOKS},
sl AS (SELECT ref_key, regexp_split_to_array(trim(regexp_replace({LABEL.format('label')}, '(?i)\\s*\\((?:vulg|lxx|greek|hebrew|neb)\\)\\s*', '', 'g')), '\\s*;\\s*') AS ss FROM external_references WHERE label IS NOT NULL AND kind = 'scripture'),
sg AS (SELECT ref_key, unnest(range(len(ss))) AS pos, trim(unnest(ss)) AS s FROM sl),
sd AS (SELECT *, regexp_matches(s, '{_NAMED}') AS direct FROM sg WHERE s <> ''),
sj AS (SELECT sd.*, b.book_id AS own_id, b.book AS own, CASE WHEN direct THEN trim(regexp_extract(s, '{_NAMED}', 2)) ELSE s END AS rest FROM sd LEFT JOIN b ON direct AND b.alias = {_ALIAS.format(f"regexp_extract(s, '{_NAMED}', 1)")}),
sk AS (SELECT *, direct OR contains(s, ':') AS told FROM sj WHERE own_id IS NOT NULL OR (NOT direct AND regexp_matches(s, '^[0-9]'))),
sw AS (SELECT *, last_value(CASE WHEN told THEN try_cast(nullif(regexp_extract(rest, '^(\\d+)', 1), '') AS bigint) END IGNORE NULLS) OVER o AS chapter0, last_value(own_id IGNORE NULLS) OVER o AS book_id, last_value(own IGNORE NULLS) OVER o AS book FROM sk WINDOW o AS (PARTITION BY ref_key ORDER BY pos ROWS UNBOUNDED PRECEDING)),
q AS (SELECT ref_key, pos, book_id, book, book || ' ' || CASE WHEN told THEN rest ELSE chapter0 || ':' || s END AS query FROM sw WHERE book_id IS NOT NULL)"""
_SHAPE = r"^(.+?)\s+(\d+)(?::(.+))?$"
_VERSES = r"CASE WHEN regexp_full_match(v, '\d+') THEN [try_cast(v AS bigint)] WHEN regexp_full_match(v, '\d+-\d+') AND try_cast(regexp_extract(v, '-(\d+)', 1) AS bigint) >= try_cast(regexp_extract(v, '^(\d+)', 1) AS bigint) THEN range(try_cast(regexp_extract(v, '^(\d+)', 1) AS bigint), try_cast(regexp_extract(v, '-(\d+)', 1) AS bigint) + 1) ELSE []::bigint[] END"
_SELECTIONS = f"""{_SCRIPTURE},
x0 AS (SELECT *, try_cast(regexp_extract(query, '{_SHAPE}', 2) AS bigint) AS n, nullif(trim(regexp_extract(query, '{_SHAPE}', 3)), '') AS spec FROM q WHERE regexp_matches(query, '{_SHAPE}')),
x1 AS (SELECT *, regexp_split_to_array(spec, '\\s*,\\s*') AS ts FROM x0),
x2 AS (SELECT * EXCLUDE (ts), unnest(range(len(ts))) AS tok, unnest(ts) AS t FROM x1 WHERE spec IS NOT NULL),
x3 AS (SELECT *, regexp_matches(t, '^(\\d+):(\\d+)-(\\d+):(\\d+)$') AS crossing, trim(regexp_replace(t, '^\\d+:', '')) AS v, CASE WHEN regexp_matches(t, '^(\\d+):(.+)$') THEN try_cast(regexp_extract(t, '^(\\d+):', 1) AS bigint) ELSE n END AS own_chapter FROM x2),
x4 AS (SELECT *, {_VERSES} AS vs FROM x3),
x5 AS (SELECT *, try_cast(regexp_extract(t, '^(\\d+):(\\d+)-(\\d+):(\\d+)$', 1) AS bigint) AS ca, try_cast(regexp_extract(t, '^(\\d+):(\\d+)-(\\d+):(\\d+)$', 2) AS bigint) AS cb, try_cast(regexp_extract(t, '^(\\d+):(\\d+)-(\\d+):(\\d+)$', 3) AS bigint) AS cc, try_cast(regexp_extract(t, '^(\\d+):(\\d+)-(\\d+):(\\d+)$', 4) AS bigint) AS cd FROM x4 WHERE crossing),
x6 AS (SELECT *, unnest(range(ca, cc + 1)) AS k FROM x5 WHERE cc >= ca),
al AS (SELECT ref_key, pos, book, 0 AS tok, 0 AS sub, n AS chapter, NULL::bigint[] AS verses, NULL::bigint AS lo, NULL::bigint AS hi FROM x1 WHERE spec IS NULL
 UNION ALL SELECT ref_key, pos, book, tok, 0, own_chapter, vs, NULL, NULL FROM x4 WHERE NOT crossing AND len(vs) > 0
 UNION ALL SELECT ref_key, pos, book, tok, k, k, CASE WHEN ca = cc THEN range(cb, cd + 1) END, CASE WHEN ca <> cc AND k = ca THEN cb WHEN ca <> cc AND k = cc THEN 1 END, CASE WHEN ca <> cc AND k = cc THEN cd END FROM x6),
se AS (SELECT ref_key, pos, book, row_number() OVER (PARTITION BY ref_key, pos ORDER BY tok, sub) - 1 AS sel, chapter, verses, lo, hi FROM al)"""
_MATCH = f"""lb AS (SELECT ref_key, {LABEL.format('label')} AS label FROM external_references WHERE label IS NOT NULL),
nm AS (SELECT id, title, 1 AS s, 0 AS o, siglum AS n FROM external_sources WHERE siglum IS NOT NULL UNION ALL SELECT id, title, 0, unnest(range(1, len(aliases) + 1)), unnest(aliases) FROM external_sources WHERE siglum IS NOT NULL AND aliases IS NOT NULL UNION ALL SELECT id, title, 0, 1000, title FROM external_sources WHERE siglum IS NOT NULL),
ht AS (SELECT ref_key, label, id, title, s, n, row_number() OVER (PARTITION BY ref_key ORDER BY id, o) AS k FROM lb JOIN nm ON contains(lower(label), lower(n)) AND (s = 0 OR regexp_matches(label, '(?i)(?:^|[\\s,(;])\\Q' || n || '\\E(?:$|[\\s,;:§])'))),
mt AS (SELECT ref_key, label, id AS entry_id, title, regexp_replace(regexp_extract(label, CASE WHEN s = 1 THEN '(?is)(?:^|[\\s,(;])\\Q' || n || '\\E((?:$|[\\s,;:§]).*)$' ELSE '(?is)\\Q' || n || '\\E(.*)$' END, 1), '^[\\s,:-]+', '') AS locator FROM ht WHERE k = 1)"""
_TOKEN = "trim(regexp_replace(regexp_replace(regexp_replace(" + CLEAN.format("locator") + r", '(?i)\bpara(?:graph)?\.?\s*', '§ ', 'g'), '(?i)\bet\s+', '', 'g'), '(?i)\band\s+', '', 'g'))"
_LOCATOR = f"""{_MATCH},
lt AS (SELECT ref_key, title, unnest(range(len(ts))) AS pos, trim(unnest(ts)) AS t FROM (SELECT ref_key, title, regexp_split_to_array({_TOKEN}, '\\s*;\\s*|\\s*,\\s*') AS ts FROM mt)),
lu AS (SELECT *, regexp_matches(t, '^§') AS mark, regexp_matches(t, '^(\\d+)\\s*-\\s*(\\d+)') AS ranged, try_cast(nullif(regexp_extract(t, '^(\\d+)', 1), '') AS bigint) AS a FROM lt WHERE t <> ''),
lv AS (SELECT *, CASE WHEN ranged THEN try_cast(regexp_extract(t, '^(\\d+)\\s*-\\s*(\\d+)', 2) AS bigint) ELSE a END AS b, CASE WHEN ranged THEN try_cast(nullif(regexp_extract(t, '^\\d+\\s*-\\s*\\d+\\s*§+\\s*(\\d+)', 1), '') AS bigint) ELSE try_cast(nullif(regexp_extract(t, '^\\d+\\s*§+\\s*(\\d+)', 1), '') AS bigint) END AS inl, last_value(CASE WHEN NOT mark THEN a END IGNORE NULLS) OVER (PARTITION BY ref_key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cur FROM lu),
ls AS (SELECT ref_key, title, pos, unnest(range(a, CASE WHEN b - a > 32 THEN a ELSE b END + 1)) AS sec FROM lv WHERE NOT mark AND a IS NOT NULL),
lf AS (SELECT ref_key, title, sec, min((pos, sec)) AS first_at FROM ls GROUP BY ref_key, title, sec),
lp AS (SELECT ref_key, pos, CASE WHEN mark THEN cur ELSE a END AS sec, CASE WHEN mark THEN try_cast(nullif(regexp_extract(t, '^§+\\s*(\\d+)', 1), '') AS bigint) ELSE inl END AS pin, NOT mark AS reset FROM lv WHERE (mark AND cur IS NOT NULL) OR inl IS NOT NULL),
lq AS (SELECT *, max(CASE WHEN reset THEN pos END) OVER (PARTITION BY ref_key, sec) AS since FROM lp WHERE pin IS NOT NULL),
lr AS (SELECT DISTINCT ref_key, sec, pin FROM lq WHERE since IS NULL OR pos >= since)"""
_WORKS = f"""w AS (SELECT id, (['Cf. {AUTHOR}, STh', 'SS', 'FS', 'scg', 'hebrews', 'creed', 'ten-commandments', 'psalms', 'de-malo', 'sentences', 'adoro', 'none'])[id % 12 + 1] AS f, id % 4 + 1 AS r, (['i', 'ii', 'iii', 'iv'])[id % 4 + 1] AS rom FROM n)"""
_CONTINUES = r"(?i)^(?:\d+(?::\d+)?(?:\s*[-,]\s*\d+(?::\d+)?)?|§+\s*\d+|can(?:n)?\.?\s*\d+|cann?\.\s*\d+|preface\b|introduction\b|praenotanda\b)"
_SEGMENTS = SEGMENTS
_MARKS = " UNION ALL ".join(f"SELECT '{a}' AS lang, '{b}' AS kind, '{c}' AS mark" for a, b, c in MARKS)
SQL = {
    "cit_classify": f"WITH {_BOOKS}, p AS (SELECT '(?i)^(?:cf\\.\\s+|see\\s+|see also\\s+)?(?:[1-3i]{{0,3}}\\s*)?(?:' || string_agg(regexp_escape(alias), '|' ORDER BY length(alias) DESC, alias) || ')\\b' AS re FROM b) SELECT ref_key, CASE WHEN regexp_matches({LABEL.format('label')}, p.re) THEN 'scripture' ELSE 'document' END AS kind FROM external_references, p WHERE label IS NOT NULL",
    "ext_references": f"WITH {_BOOKS}, p AS (SELECT '(?i)^(?:cf\\.\\s+|see\\s+|see also\\s+)?(?:[1-3i]{{0,3}}\\s*)?(?:' || string_agg(regexp_escape(alias), '|' ORDER BY length(alias) DESC, alias) || ')\\b' AS re FROM b), {_SEGMENTS}, l AS (SELECT note_key, pos, compare, {LABEL.format('segment')} AS label FROM k), v AS (SELECT l.*, regexp_matches(label, p.re) AS verse, regexp_matches(label, '(?i)[a-z]') AS letter, regexp_matches(label, '{_CONTINUES}') AS goes_on FROM l, p WHERE label <> '' AND NOT regexp_matches(label, '(?i)^[,.;:\\s]*cf\\.?[,.;:\\s]*$')), dc AS (SELECT *, letter AND (NOT goes_on OR pos = min(CASE WHEN letter THEN pos END) OVER (PARTITION BY note_key)) AS opens FROM v WHERE NOT verse), dh AS (SELECT *, sum(opens::int) OVER (PARTITION BY note_key ORDER BY pos) AS head FROM dc), dg AS (SELECT note_key, min(pos) AS pos, 'document' AS kind, string_agg(label, '; ' ORDER BY pos) AS label, bool_or(compare) AS compare FROM dh WHERE head > 0 AND (opens OR goes_on) GROUP BY note_key, head), al AS (SELECT * FROM dg UNION ALL SELECT note_key, pos, 'scripture', label, compare FROM v WHERE verse) SELECT note_key, note_key || ':' || kind || ':' || row_number() OVER (PARTITION BY note_key, kind ORDER BY pos) AS ref_id, kind, label, compare FROM al",
    "cit_scripture": f"WITH {_SCRIPTURE} SELECT ref_key, pos, book_id, query FROM q",
    "cit_selections": f"WITH {_SELECTIONS} SELECT ref_key, pos, sel, chapter, array_to_string(verses, ',') AS verses, lo, hi FROM se",
    "cit_rendered": f"WITH {N}, {_SELECTIONS}, vl AS (SELECT id, string_split(text, chr(10)) AS ls FROM n WHERE text IS NOT NULL), vs AS (SELECT id AS chapter, unnest(range(1, len(ls) + 1)) AS verse, unnest(ls) AS t FROM vl), vp AS (SELECT se.ref_key, se.pos, se.sel, se.book, se.chapter, string_agg(vs.verse || '. ' || {CLEAN.format('vs.t')}, ' ' ORDER BY vs.verse) AS body FROM se JOIN vs ON vs.chapter = se.chapter AND CASE WHEN se.verses IS NOT NULL THEN list_contains(se.verses, vs.verse) ELSE vs.verse >= coalesce(se.lo, 0) AND (se.hi IS NULL OR vs.verse <= se.hi) END GROUP BY ALL) SELECT ref_key, string_agg(book || ' ' || chapter || ': ' || body, ' ' ORDER BY pos, sel) AS content FROM vp GROUP BY ref_key",
    "cit_documents": f"WITH {_MATCH} SELECT ref_key, entry_id, locator FROM mt",
    "cit_locators": f"WITH {_LOCATOR}, s AS (SELECT ref_key, string_agg(sec::varchar, ',' ORDER BY first_at) AS sections FROM lf GROUP BY ref_key), p AS (SELECT ref_key, string_agg(sec || ':' || pin, ',' ORDER BY sec || ':' || pin) AS pins FROM lr GROUP BY ref_key) SELECT mt.ref_key, coalesce(s.sections, '') AS sections, coalesce(p.pins, '') AS pins FROM mt LEFT JOIN s ON s.ref_key = mt.ref_key LEFT JOIN p ON p.ref_key = mt.ref_key",
    "cit_parts": f"WITH {N}, {_LOCATOR}, o AS (SELECT *, row_number() OVER (PARTITION BY ref_key ORDER BY first_at) - 1 AS k FROM lf) SELECT o.ref_key, o.k AS n, o.title || ' ' || o.sec || '. ' || {CLEAN.format('n.title')} AS text FROM o JOIN n ON n.id = o.sec WHERE n.title IS NOT NULL",
    "cit_works": f"WITH {N}, {_WORKS} SELECT id, CASE WHEN f LIKE 'Cf.%' THEN CASE WHEN rom IN ('i', 'iii') THEN 'aquinas-sth' END WHEN f IN ('SS', 'FS') THEN 'aquinas-sth' WHEN f = 'adoro' THEN 'aquinas-adoro-te' WHEN f <> 'none' THEN 'aquinas-' || f END AS kind, CASE WHEN f LIKE 'Cf.%' THEN CASE WHEN rom IN ('i', 'iii') THEN 'document:aquinas-sth:' || rom || '-' || id || '-2-ad-' || (['i', 'ii', 'iii', 'iv', 'v'])[id % 5 + 1] END WHEN f = 'SS' THEN 'document:aquinas-sth:ii-ii-' || id || '-7-s-c' WHEN f = 'FS' THEN 'document:aquinas-sth:i-ii-3-' || id || '-obj-2' WHEN f = 'scg' THEN 'document:aquinas-scg:' || r || '-' || id WHEN f = 'hebrews' THEN 'document:aquinas-hebrews:' || id || '-4' WHEN f IN ('creed', 'ten-commandments') THEN 'document:aquinas-' || f || ':' || r WHEN f = 'psalms' THEN 'document:aquinas-psalms:' || id || '-1' WHEN f = 'de-malo' THEN 'document:aquinas-de-malo:4-' || id WHEN f = 'sentences' THEN 'document:aquinas-sentences:' || r || '-prologue' WHEN f = 'adoro' THEN 'document:aquinas-adoro-te' END AS source, CASE WHEN f LIKE 'Cf.%' AND rom IN ('i', 'iii') THEN 'reply:' || (id % 5 + 1) WHEN f = 'SS' THEN 'sed-contra' WHEN f = 'FS' THEN 'objection:2' END AS pinpoint FROM w",
    "cit_cells": f"WITH {N} SELECT id, CASE id % 5 WHEN 0 THEN 'objection:' || id WHEN 1 THEN 'reply:' || id WHEN 2 THEN 'sed-contra' WHEN 3 THEN 'corpus' END AS cell FROM n WHERE title IS NOT NULL",
    "cit_canon_range": f"WITH {N} SELECT id, id::bigint AS lo, id + 9::bigint AS hi FROM n",
    "cit_number_ranges": f"WITH {N}, r(lo, hi, c, k) AS (VALUES {', '.join(str(r) for r in C.NUMBER_RANGES)}) SELECT id, CASE WHEN k THEN 'canon:' || c || ':' || (id + 2990 - lo + 1) ELSE 'chapter:' || c END AS section_key FROM n JOIN r ON id + 2990 BETWEEN lo AND hi",
    "hier_segments": f"WITH {N}, b AS (SELECT id, unnest(breadcrumbs) AS x, unnest(range(len(breadcrumbs))) AS pos FROM n), s AS (SELECT id, pos, x, regexp_extract(x, '(?i)^PART\\s+(ONE|TWO|THREE|FOUR)\\s*:?\\s*(.+)$', 1) AS o, string_split(regexp_extract(x, '(?i)^PART\\s+(ONE|TWO|THREE|FOUR)\\s*:?\\s*(.+)$', 2), ' ') AS r FROM b) SELECT n.id, (SELECT arg_max('Part ' || (CASE o WHEN 'ONE' THEN 1 WHEN 'TWO' THEN 2 WHEN 'THREE' THEN 3 ELSE 4 END) || ': ' || array_to_string(list_transform(r, lambda w: upper(w[1]) || lower(w[2:])), ' '), pos) FROM s WHERE s.id = n.id AND o <> '') AS part, NULL::varchar AS chapter, coalesce((SELECT string_agg(x, ' | ' ORDER BY pos) FROM s WHERE s.id = n.id AND o = ''), '') AS extras FROM n",
    "hier_meta": "SELECT page_id, 'Part 2: ' || upper(lang[1]) || lang[2:] || ' | Chapter 4: Of the ' || upper(lang[1]) || lang[2:] || ' | Article IX: A Word' AS levels FROM source_pages WHERE lang IS NOT NULL",
    "hier_lines": f"WITH m AS ({_MARKS}), l AS (SELECT row_id, lang, kind FROM localized_nodes JOIN m USING (lang) WHERE title IS NOT NULL) SELECT row_id, kind, CASE WHEN lang = 'zh' THEN NULL ELSE kind END AS with_title, kind AS alone, '' AS alone_title FROM l",
    "hier_titles": f"WITH m AS ({_MARKS}), l AS (SELECT row_id, kind, title FROM localized_nodes JOIN m USING (lang) WHERE title IS NOT NULL) SELECT row_id, kind, 12 AS number, NULL AS title FROM l UNION ALL SELECT row_id, kind, 13, title || ' of ' || kind FROM l",
    "ext_two_levels": f"WITH {N}, t AS (SELECT id, {CLEAN.format('title')} AS title FROM n WHERE title IS NOT NULL) SELECT id, 'chapter:1' AS key, 'on ' || title || ' ' || title AS body FROM t UNION ALL SELECT id, 'chapter:2', 'more' FROM t UNION ALL SELECT id, 'canon:2:1', '1. ' || title || ' goes on' FROM t UNION ALL SELECT id, 'canon:2:2', '2. Another' FROM t UNION ALL SELECT id, 'canon:3:1', '1. Last' FROM t",
    "ext_verses_apart": f"WITH {N}, t AS (SELECT id, {CLEAN.format('title')} AS title FROM n WHERE title IS NOT NULL) SELECT id, 1 AS verse, title AS text FROM t UNION ALL SELECT id, 3, title FROM t",
    "ext_verses_bracketed": f"WITH {N}, t AS (SELECT id, {CLEAN.format('title')} AS title FROM n WHERE title IS NOT NULL) SELECT id, 1 AS verse, title || ' goes on' AS text FROM t UNION ALL SELECT id, 3, title FROM t",
    "ext_verses_inline": f"WITH {N}, t AS (SELECT id, {CLEAN.format('title')} AS title FROM n WHERE title IS NOT NULL) SELECT id, 1 AS verse, title AS text FROM t UNION ALL SELECT id, 3, 'and ' || title FROM t",
    "ext_verses_anchored": f"WITH {N}, t AS (SELECT id, {CLEAN.format('title')} AS title FROM n WHERE title IS NOT NULL) SELECT id, 1 AS chapter, 1 AS verse, title || ' more' AS text FROM t UNION ALL SELECT id, 2, 2, 'second ' || title FROM t",
    "ext_verses_numbered": f"WITH {N}, t AS (SELECT id, {CLEAN.format('title')} AS title FROM n WHERE title IS NOT NULL) SELECT id, 1 AS chapter, 1 AS verse, title || ' goes on' AS text FROM t UNION ALL SELECT id, 2, 1, title FROM t",
}
