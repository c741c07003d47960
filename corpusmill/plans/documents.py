"""Document queries: variants by language, outlines, colours, section loaders, address rules, sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions import text as T
from corpusmill.operators import graph as G
from corpusmill.operators import html as H
from corpusmill.operators import joins as J
from corpusmill.operators import ordered as O
from corpusmill.operators import segment as S
from corpusmill.operators.dedupe import append_unique, keep_first
from corpusmill.operators.hierarchy import normal_segment
from corpusmill.plans.graphs import N, nodes
from corpusmill.plans.sqltext import CLEAN, LABEL
from corpusmill.session import table
from corpusmill.sources import pages as P

L = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lang ORDER BY row_id) AS rn FROM localized_nodes) WHERE rn = 1)"
#: Base colour (hue, saturation, lightness) of the parts in their order, and of any other.
PALETTE, OTHER = ((42, 26, 82), (218, 68, 52), (2, 62, 44), (50, 88, 52), (144, 50, 42)), (210, 12, 56)
#: Languages by the code in a document's address.
PATH_CODES = (("ar", "ar"), ("de", "de"), ("ge", "de"), ("en", "en"), ("es", "es"), ("sp", "es"), ("fr", "fr"), ("it", "it"), ("la", "la"), ("lt", "la"), ("pt", "pt"), ("po", "pt"), ("zh", "zh"), ("zh-t", "zh"))
PARTS = ("one", "two", "three", "four")


def prj_variants(spark, d):
    """PRJ-06, PRJ-07: each node's previews by language; without any, its own as the default; the one to show: Latin if there is one, else French, else none."""
    loc = keep_first(table(spark, d, "localized_nodes").where("lang IS NOT NULL").select("row_id", "id", "lang", "preview"), ["id", "lang"], ["row_id"])
    some = loc.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", F.coalesce("preview", F.lit("")).alias("v"))))).alias("m"))  # a language an entry
    n = nodes(spark, d, "preview").join(some, "id", "left").withColumn("m", F.coalesce("m", F.create_map(F.lit("en"), F.coalesce("preview", F.lit("")))))
    chosen = F.when(F.map_contains_key("m", "la"), "la").when(F.map_contains_key("m", "fr"), "fr")
    n = n.withColumn("selected", chosen)
    return n.select("id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("available"), "selected", F.try_element_at("m", F.col("selected")).alias("shown"))


def _crumbs(spark, d, *columns):
    """Nodes with breadcrumbs of four levels: the part as it is written in the table, the others by the node's number."""
    k = F.col("id").cast("string")
    at = lambda every, size, name: F.when(F.col("id") % every < size, F.concat(F.lit(name + " "), (F.floor(F.col("id") / every) % 9 + 1).cast("string"), F.lit(": of "), (F.floor(F.col("id") / every)).cast("string")))
    n = nodes(spark, d, "breadcrumbs", "title", "preview", *columns)
    part = normal_segment(F.try_element_at("breadcrumbs", F.lit(1)))
    return n.select("id", "title", "preview", *columns, part.alias("part"), at(40, 36, "Section").alias("section"), at(10, 7, "Chapter").alias("chapter"), at(5, 2, "Article").alias("article"), k.alias("key"))


def agg_outline(spark, d):
    """AGG-11, AGG-12: parts, sections and chapters in order of first appearance, with their blocks' node lists.

    A node with a section only is in the section's opening, with a chapter but no article in the chapter, with neither in the
    part's opening; the rest is in no block.
    """
    n = _crumbs(spark, d)
    kind = F.when(F.col("section").isNotNull() & F.col("chapter").isNull(), "section").when(F.col("section").isNotNull() & F.col("chapter").isNotNull() & F.col("article").isNull(), "chapter").when(F.col("section").isNull() & F.col("chapter").isNull(), "part")
    n = n.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("chapter", F.when(F.col("kind") == "chapter", F.col("chapter")))
    g = n.groupBy("part", "section", "chapter", "kind").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    rank = lambda *by: F.dense_rank().over(W.partitionBy(*by).orderBy("first_id"))  # noqa: E731 a row for each block
    return g.select("part", "section", "chapter", "kind", F.col("n"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), rank("part").cast("bigint").alias("ord"))


def prj_colours(spark, d):
    """PRJ-11: a colour of each node by part, section and chapter: offsets by first appearance, clamped, in five tones."""
    n = _crumbs(spark, d).withColumn("p", F.coalesce(F.regexp_extract("part", r"^Part (\d+)", 1).try_cast("int"), F.lit(0)))
    sec = n.where("section IS NOT NULL").groupBy("p", "section").agg(F.min("id").alias("f"))
    sec = sec.select("p", "section", (F.row_number().over(W.partitionBy("p").orderBy("f")) - 1).alias("si"), F.count("*").over(W.partitionBy("p")).alias("sn"))
    ch = n.where("chapter IS NOT NULL").withColumn("s", F.coalesce("section", F.lit("-"))).groupBy("p", "s", "chapter").agg(F.min("id").alias("f"))
    ch = ch.select("p", "s", "chapter", (F.row_number().over(W.partitionBy("p", "s").orderBy("f")) - 1).alias("ci"), F.count("*").over(W.partitionBy("p", "s")).alias("cn"))
    n = n.withColumn("s", F.coalesce("section", F.lit("-"))).join(sec, ["p", "section"], "left").join(ch, ["p", "s", "chapter"], "left")

    def offset(i: str, count: str, spread):
        c = (F.col(count) - 1) / 2
        return F.when(F.col(count) > 1, (F.col(i) - c) / F.greatest(c, F.lit(1.0)) * spread).otherwise(0.0)

    bright = F.col("p") == 3
    pick = lambda a, b: F.when(bright, F.lit(float(a))).otherwise(F.lit(float(b)))
    clamp = lambda c, lo, hi: F.least(F.greatest(c, lo), hi)
    base = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in PALETTE)), F.col("p") + 1)
    hue = base(0) + offset("si", "sn", pick(6, 24)) + offset("ci", "cn", pick(3, 9))
    sat = clamp(base(1) + F.when(F.col("section").isNotNull(), 6).otherwise(0) + F.when(F.col("chapter").isNotNull(), 4).otherwise(0), F.lit(20), F.lit(96))
    first = F.col("p") == 0
    light = clamp(base(2) + offset("si", "sn", pick(16, 8)) + offset("ci", "cn", pick(6, 5)), F.when(first, 70.0).otherwise(30.0), F.when(first, 88.0).otherwise(74.0))
    n = n.select("id", hue.alias("h"), sat.alias("s0"), light.alias("l0"))
    whole = lambda c: F.floor(c + 0.5).cast("string")
    tone = lambda s, x, a: F.concat(F.lit("hsl("), whole((F.col("h") + 360) % 360), F.lit(" "), whole(s), F.lit("% "), whole(x), F.lit("%" + (f" / {a}" if a else "") + ")"))
    s0, l0 = F.col("s0"), F.col("l0")
    c2 = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    return n.select(
        "id", tone(s0, l0, "").alias("solid"), tone(c2(s0 - 8, 18, 96), c2(l0 + 18, 40.0, 90.0), "0.18").alias("soft"), tone(c2(s0 - 18, 18, 92), c2(l0 + 28, 48.0, 94.0), "0.6").alias("wash"),
        tone(c2(s0 - 6, 18, 96), c2(l0 + 6, 32.0, 82.0), "0.28").alias("border"), tone(c2(s0 + 2, 20, 96), c2(l0 - 26, 18.0, 42.0), "").alias("ink"),
    )


def prj_tooltip(spark, d):
    """PRJ-09, PRJ-10: the title of the deepest breadcrumb in the language's hierarchy, else the preview of at most 96 characters, else the title."""
    titles = keep_first(table(spark, d, "localized_nodes").where("lang = 'de' AND title IS NOT NULL AND title <> ''").select("row_id", "id", "title"), ["id"], ["row_id"]).select(F.col("id").alias("tid"), F.col("title").alias("local"))
    n = nodes(spark, d, "preview", "title").join(titles, F.col("id") == F.col("tid"), "left")
    p = F.trim("preview")
    cut = F.when(F.length(p) > 96, F.concat(F.rtrim(F.substring(p, 1, 93)), F.lit("..."))).otherwise(p)
    return n.select("id", F.coalesce("local", F.nullif(cut, F.lit("")), "title").alias("tooltip"))


def prj_view(spark, d):
    """PRJ-12, SCL-25: radius, spacing, rendered place, zoom around the centre, midpoint and distance, over four zooms."""
    n = nodes(spark, d, "pos_x", "pos_y", "visual_radius").select("id", "pos_x", "pos_y", "visual_radius", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 40.0)))).alias("scale"))
    ratio = F.greatest(F.lit(1.0), F.col("scale") / 0.8)
    radius = F.greatest("visual_radius", F.lit(3.0)) * F.least(F.lit(1.85), F.pow(ratio, F.lit(0.2)))
    spacing = F.greatest(F.lit(0.54), 1 / F.pow(ratio, F.lit(0.34)))
    place = lambda v, c: c + (F.col(v) - c) * spacing
    zoomed = lambda c, v: c / 2 - (c / 2 - F.col(v)) / 0.8 * F.col("scale")
    r = lambda c, name: F.round(c, 5).alias(name)
    return n.select("id", "scale", r(radius, "radius"), r(place("pos_x", F.lit(10.0)), "x"), r(place("pos_y", F.lit(-5.0)), "y"), r(zoomed(F.lit(800.0), "pos_x"), "zoom_x"), r((F.col("pos_x") + F.col("pos_y")) / 2, "middle"), r(F.hypot("pos_x", "pos_y"), "distance"))


def srt_collated(spark, d):
    """SRT-03: titles of the reference list in the order of a locale, by collation: accents and case after the letters."""
    s = table(spark, d, "external_sources").select("id", F.regexp_replace("title", "[^\\p{L}]", "").alias("t"))
    k = F.row_number().over(W.orderBy(F.collate(F.col("t"), "UNICODE"), "id"))  # a reference list
    return s.select("id", k.cast("bigint").alias("ord"))


def set_difference(spark, d):
    """SET-03: nodes whose text holds a word, without the one that is pinned on top."""
    n = nodes(spark, d, "text")
    hits = n.where(F.contains("text", F.lit("lamp"))).select("id")
    return hits.join(n.where("id = 12").select("id"), "id", "left_anti")


def set_split(spark, d):
    """SET-04: revisions parted by a predicate into two complementary sources, null dates in the second, and their union again."""
    t = table(spark, d, "catechism_nodes").select("row_id", "updated_at")
    early = F.coalesce(F.col("updated_at") < F.lit("2025-06-01").cast("timestamp"), F.lit(False))
    return t.where(early).select("row_id", F.lit("early").alias("source")).unionByName(t.where(~early).select("row_id", F.lit("late").alias("source")))


def set_append_unique(spark, d):
    """SET-06: breadcrumbs and then headings of each node, each text once, in order of first appearance."""
    n = nodes(spark, d, "breadcrumbs", "headings")
    heads = F.transform("headings", lambda h: h["text"])
    return n.select("id", F.array_join(append_unique(F.col("breadcrumbs"), heads), " | ").alias("labels"))


def scl_labels(spark, d):
    """SCL-04: a label by all six normalisers."""
    r = table(spark, d, "external_references").where("label IS NOT NULL")
    c = F.col("label")
    return r.select("ref_key", T.document_label(c).alias("document"), T.label_key(c).alias("title_key"), T.book_alias(c).alias("book"), T.subtitle_key(c).alias("subtitle"), T.locator_token(c).alias("locator"), T.quoted_title(c, F.lit("de")).alias("quoted"))


def scl_escapes(spark, d):
    """SCL-06: texts escaped for markup and back, and as a pattern that finds them."""
    f = table(spark, d, "footnotes").where("text IS NOT NULL")
    c = F.col("text")
    return f.select("note_key", (T.unescape_html(T.escape_html(c)) == c).alias("same"), F.length(T.escape_pattern(c)).cast("bigint").alias("n"))


def scl_links(spark, d):
    """SCL-26: links to a note rewritten as links within the page, and a page's address with the filled parameters."""
    n = table(spark, d, "footnotes").where("id IS NOT NULL").select("note_key", "id", "number")
    html = F.concat(F.lit('see <a href="#!/search/s1/fn/'), "id", F.lit('">note</a> and <a href="other">x</a>'))
    out = F.regexp_replace(html, r'href="#!/search/s1/fn/([^"]+)"', r'href="#footnote-$1" data-footnote-target="$1"')
    return n.select("note_key", out.alias("html"), T.query_url(F.lit("/"), number=F.col("number"), lang=F.lit(None).cast("string"), key=F.col("note_key")).alias("link"))


def src_variant_language(spark, d):
    """SRC-18, SCL-20: documents of one stem by language, by the code in the address, else by the link's label; the last link of a language counts, pages only."""
    codes = spark.createDataFrame(PATH_CODES, "code string, language string")
    loc = table(spark, d, "localized_nodes").where("lang IS NOT NULL").select("row_id", "id", "lang")
    code = F.when(F.col("lang") == "es", "sp").when(F.col("lang") == "la", "xx").when(F.col("lang") == "zh", "zh-t").otherwise(F.col("lang"))
    end = F.when(F.col("row_id") % 11 == 0, "pdf").otherwise("html")
    links = loc.select("row_id", F.concat(F.lit("https://hortus.example/doc-"), F.col("id").cast("string"), F.lit("_"), code, F.lit("."), end).alias("url"), F.col("lang").alias("label"))
    return P.document_variants(links, J.small(codes), "row_id").select("stem", "language", "url")


def src_filtered_crawl(spark, d):
    """SRC-17: pages reached from the first one over links whose target passes the crawl's filter, by a visited set; in order."""
    e = table(spark, d, "catechism_edges")
    url = F.concat(F.lit("https://hortus.example/archive/p"), F.col("target").cast("string"), F.when(F.col("target") % 10 == 0, ".pdf").otherwise(".HTM"))
    links = e.where(url.rlike(r"(?i)^https://hortus\.example/archive/p[^/]+\.html?$"))
    return G.reachable(links, spark.createDataFrame([(1,)], "id int"), 50_000_000)


def src_sections(spark, d):
    """SRC-19, SRC-20: one table of sections of all documents (nodes as canon pages and localized rows as documents), the first page of a number counts."""
    a = nodes(spark, d, "text").where("text IS NOT NULL").select(F.lit("base").alias("document"), F.lit("en").alias("lang"), "id", F.col("row_id").alias("page"))
    b = table(spark, d, "localized_nodes").where("text IS NOT NULL AND lang IS NOT NULL").select(F.lit("pack").alias("document"), "lang", "id", F.col("row_id").alias("page"))
    return keep_first(a.unionByName(b), ["document", "lang", "id"], ["page"]).groupBy("document", "lang").agg(F.count("*").alias("sections"), F.min("page").alias("first_page"))


def src_page_lookup(spark, d):
    """SRC-22, JOIN-07: the node of each page: of English ones by the title, of others by ordinal, the k-th page of a language for the k-th node."""
    p = table(spark, d, "source_pages").where("content IS NOT NULL AND lang IS NOT NULL")
    p = p.select("page_id", "lang", T.label_key(F.regexp_extract("content", r"(?i)<title>([^|<]*?)\s*[|<-]", 1)).alias("k"))
    n = nodes(spark, d, "title")
    titles = n.where("title IS NOT NULL").groupBy(T.label_key(F.col("title")).alias("k")).agg(F.min("id").alias("id"))
    by_title = p.where("lang = 'en' AND k <> ''").join(titles, "k").select("page_id", "id", F.lit("title").alias("how"))
    order = O.with_position(p.where("lang <> 'en'").select("page_id", "lang"), ["page_id"], "ord", ["lang"])
    by_place = order.join(O.with_position(n.select("id"), ["id"], "ord"), "ord").select("page_id", "id", F.lit("place").alias("how"))
    return by_title.unionByName(by_place)


def ext_sections(spark, d):
    """EXT-07: numbered sections of a document: up to its notes or the first number that decreases, the last of a number counts."""
    n = nodes(spark, d, "title").where("title IS NOT NULL")
    lines = F.array(F.lit("before"), F.concat(F.lit("1. "), "title"), F.lit("more"), F.lit("3. three"), F.col("title"), F.lit("3. again"), F.lit("2. lower"), F.lit("4. after"))
    ls = n.select("id", F.posexplode(lines).alias("pos", "line"))
    return S.numbered_sections(ls, ["id"], "pos", "line", last_wins=True).select("id", F.col("number").cast("bigint").alias("number"), "body")


def ext_cut_paragraphs(spark, d):
    """EXT-03, EXT-04: paragraphs of a page within the range that its file's name gives, up to the first rule after one or a number that decreases; the first of a number counts."""
    n = nodes(spark, d, "title").where("title IS NOT NULL")
    file = F.concat(F.lit("nn"), (F.col("id") % 20 + 1).cast("string"), F.lit("-"), (F.col("id") % 20 + 10).cast("string"), F.lit(".pdf"))
    num = lambda k: (F.col("id") % 20 + k).cast("string")
    row = lambda tag, text: F.struct(F.lit(tag).alias("tag"), text.alias("line"))
    rows = F.array(row("hr", F.lit("")), row("p", F.concat(num(0), F.lit(". below"))), row("p", F.concat(num(1), F.lit(". "), "title")), row("p", F.lit("goes on")), row("p", F.concat(num(4), F.lit(" four"))), row("p", F.concat(num(3), F.lit(". lower"))), row("hr", F.lit("")), row("p", F.concat(num(6), F.lit(". after"))))
    ls = n.select("id", file.alias("file"), F.posexplode(rows).alias("pos", "r")).select("id", "file", "pos", "r.tag", "r.line")
    return S.page_paragraphs(ls, ["id"], "pos", "line", "tag", "file").select("id", F.col("number").cast("bigint").alias("number"), "body")


def ext_canons(spark, d):
    """EXT-09: canons of a block, an earlier version closing its canon."""
    n = nodes(spark, d, "title").where("title IS NOT NULL").select("id", F.concat(F.lit("<p>Title</p><p><b>Can. 7</b> "), T.escape_html(F.col("title")), F.lit("</p><p><b>Can. 12</b> two [Earlier version] old</p>")).alias("html"))
    return H.apply_rows(n, ["id"], ["html"], H.split_canons, "number int, body string").select("id", F.col("number").cast("bigint").alias("number"), "body")


def ext_first_table(spark, d):
    """EXT-18, EXT-19, UDF-02: rows of the first balanced table after an anchor that a caller's predicate keeps."""
    n = nodes(spark, d, "title").where("title IS NOT NULL")
    html = F.concat(F.lit('<table><tr><td>no</td></tr></table><a name="here"></a><div><table><tr><td>'), T.escape_html(F.col("title")), F.lit("</td><td>right<table><tr><td>in</td></tr></table></td></tr><tr><td>skip me</td></tr></table></div><table><tr><td>late</td></tr></table>"))
    n = n.select("id", html.alias("html"))
    got = H.apply_rows(n, ["id"], ["html"], lambda c: H.select_rows(H.bilingual_rows(H.first_table_after(c, "here")), lambda left, right: not left.startswith("skip")), "left string, right string")
    return got.select("id", F.col("pos").cast("bigint").alias("pos"), "left", "right")


def prj_payload(spark, d):
    """PRJ-02: each node as one nested JSON document with its source and statistics, nulls kept."""
    n = nodes(spark, d, "title", "part", "vatican_source", "xrefs", "incoming")
    stats = F.struct(F.size("xrefs").alias("xrefs"), F.size("incoming").alias("incoming"))
    doc = F.struct("id", "title", "part", F.struct(F.col("vatican_source.file").alias("file"), F.col("vatican_source.url").alias("url")).alias("source"), stats.alias("stats"))
    return n.select("id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


def prj_subtitles(spark, d):
    """PRJ-08: the subtitle of a localized row: its preview, unless that is the text or the title but for marks and case; a fixed one for summaries."""
    loc = table(spark, d, "localized_nodes").select("row_id", "title", "text", "preview")
    summary = F.upper(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))) == "IN BRIEF"
    key = T.subtitle_key(F.col("preview"))
    same = (key == "") | (key == T.subtitle_key(F.col("text"))) | (key == T.subtitle_key(F.col("title")))
    return loc.select("row_id", F.when(summary, "Summary").when(~same, F.trim("preview")).alias("subtitle"))


def ext_absolute(spark, d):
    """EXT-21: markup whose links within the page are made absolute, without style attributes: how many of either, and a hash of the result."""
    p = table(spark, d, "source_pages").where("content IS NOT NULL AND url IS NOT NULL").select("page_id", "url", "content")
    html = F.replace(F.regexp_replace("content", r"(?i)\sstyle\s*=\s*\"[^\"]*\"", ""), F.lit('href="#'), F.concat(F.lit('href="'), "url", F.lit("#")))
    return p.select("page_id", F.regexp_count("content", F.lit('href="#')).cast("bigint").alias("inner_links"), F.md5(html).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        prj_variants, agg_outline, prj_colours, prj_tooltip, prj_view, srt_collated, set_difference, set_split, set_append_unique, scl_labels, scl_escapes, scl_links, src_variant_language,
        src_filtered_crawl, src_sections, prj_payload, prj_subtitles, ext_absolute, src_page_lookup, ext_sections, ext_cut_paragraphs, ext_canons, ext_first_table,
    )
}

_PART = "CASE WHEN breadcrumbs[1] LIKE 'PART %:%' THEN 'Part ' || (CASE split_part(breadcrumbs[1], ' ', 2) WHEN 'ONE:' THEN 1 WHEN 'TWO:' THEN 2 WHEN 'THREE:' THEN 3 WHEN 'FOUR:' THEN 4 END) || ': ' || array_to_string(list_transform(string_split(regexp_extract(breadcrumbs[1], ': (.*)$', 1), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"
_LEVEL = "CASE WHEN id % {0} < {1} THEN '{2} ' || (id // {0} % 9 + 1) || ': of ' || (id // {0}) END"
_CRUMBS = f"{N}, c AS (SELECT id, title, {_PART} AS part, {_LEVEL.format(40, 36, 'Section')} AS section, {_LEVEL.format(10, 7, 'Chapter')} AS chapter, {_LEVEL.format(5, 2, 'Article')} AS article FROM n)"
_OFF = "CASE WHEN {1} > 1 THEN ({0} - ({1} - 1) / 2.0) / greatest(({1} - 1) / 2.0, 1.0) * {2} ELSE 0.0 END"
_PICK = "CASE WHEN p = 3 THEN {0}.0 ELSE {1}.0 END"
_H, _S0, _L0 = ([x[k] for x in PALETTE] for k in range(3))
_R = "floor({0} + 0.5)::bigint"


def _tone(s: str, x: str, a: str) -> str:
    return f"'hsl(' || {_R.format('(h + 360) % 360')} || ' ' || {_R.format(s)} || '% ' || {_R.format(x)} || '%{' / ' + a if a else ''})'"


_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '\\bthe\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_SUBTITLE = "lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '[.,;:!?''\"“”‘’«»()\\[\\]{{}}-]', '', 'g')))"
_TITLE = f"WITH {N}, t AS (SELECT id, title FROM n WHERE title IS NOT NULL)"
_CLEANED = f"WITH {N}, t AS (SELECT id, {CLEAN.format('title')} AS title FROM n WHERE title IS NOT NULL)"
SQL = {
    "prj_variants": f"WITH {N}, {L}, g AS (SELECT id, string_agg(lang, ',' ORDER BY lang) AS a, max(CASE WHEN lang = 'la' THEN 'la' END) AS la, max(CASE WHEN lang = 'fr' THEN 'fr' END) AS fr FROM l WHERE lang IS NOT NULL GROUP BY id) SELECT n.id, coalesce(g.a, 'en') AS available, coalesce(la, fr) AS selected, CASE WHEN coalesce(la, fr) IS NOT NULL THEN coalesce(l.preview, '') END AS shown FROM n LEFT JOIN g ON g.id = n.id LEFT JOIN l ON l.id = n.id AND l.lang = coalesce(la, fr)",
    "agg_outline": f"WITH {_CRUMBS}, k AS (SELECT id, part, section, CASE WHEN section IS NOT NULL AND chapter IS NULL THEN 'section' WHEN section IS NOT NULL AND article IS NULL THEN 'chapter' WHEN section IS NULL AND chapter IS NULL THEN 'part' END AS kind, chapter FROM c), g AS (SELECT part, section, CASE WHEN kind = 'chapter' THEN chapter END AS chapter, kind, min(id) AS lo, max(id) AS hi, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL) SELECT part, section, chapter, kind, n, lo::bigint AS lo, hi::bigint AS hi, dense_rank() OVER (PARTITION BY part ORDER BY lo) AS ord FROM g",
    "prj_colours": f"WITH {_CRUMBS}, q AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(part, '^Part (\\d+)', 1), '') AS int), 0) AS p, coalesce(section, '-') AS s FROM c), s1 AS (SELECT p, section, row_number() OVER (PARTITION BY p ORDER BY min(id)) - 1 AS si, count(*) OVER (PARTITION BY p) AS sn FROM q WHERE section IS NOT NULL GROUP BY p, section), c1 AS (SELECT p, s, chapter, row_number() OVER (PARTITION BY p, s ORDER BY min(id)) - 1 AS ci, count(*) OVER (PARTITION BY p, s) AS cn FROM q WHERE chapter IS NOT NULL GROUP BY p, s, chapter), j AS (SELECT q.*, si, sn, ci, cn FROM q LEFT JOIN s1 ON s1.p = q.p AND s1.section = q.section LEFT JOIN c1 ON c1.p = q.p AND c1.s = q.s AND c1.chapter = q.chapter), v AS (SELECT id, ({_H})[p + 1] + {_OFF.format('si', 'sn', _PICK.format(6, 24))} + {_OFF.format('ci', 'cn', _PICK.format(3, 9))} AS h, least(greatest(({_S0})[p + 1] + CASE WHEN section IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN chapter IS NOT NULL THEN 4 ELSE 0 END, 20), 96) AS sa, least(greatest(({_L0})[p + 1] + {_OFF.format('si', 'sn', _PICK.format(16, 8))} + {_OFF.format('ci', 'cn', _PICK.format(6, 5))}, CASE WHEN p = 0 THEN 70 ELSE 30 END), CASE WHEN p = 0 THEN 88 ELSE 74 END) AS li FROM j) SELECT id, {_tone('sa', 'li', '')} AS solid, {_tone('least(greatest(sa - 8, 18), 96)', 'least(greatest(li + 18, 40), 90)', '0.18')} AS soft, {_tone('least(greatest(sa - 18, 18), 92)', 'least(greatest(li + 28, 48), 94)', '0.6')} AS wash, {_tone('least(greatest(sa - 6, 18), 96)', 'least(greatest(li + 6, 32), 82)', '0.28')} AS border, {_tone('least(greatest(sa + 2, 20), 96)', 'least(greatest(li - 26, 18), 42)', '')} AS ink FROM v",
    "prj_tooltip": f"WITH {N}, t AS (SELECT id, arg_min(title, row_id) AS title FROM localized_nodes WHERE lang = 'de' AND title <> '' GROUP BY id) SELECT n.id, coalesce(t.title, nullif(CASE WHEN length(trim(preview)) > 96 THEN rtrim(substring(trim(preview), 1, 93)) || '...' ELSE trim(preview) END, ''), n.title) AS tooltip FROM n LEFT JOIN t ON t.id = n.id",
    "prj_view": f"WITH {N}, z(scale) AS (VALUES (0.5::double), (1.0::double), (1.5::double), (40.0::double)), v AS (SELECT id, scale, pos_x, pos_y, visual_radius, greatest(1.0, scale / 0.8) AS r FROM n, z) SELECT id, scale, round(greatest(visual_radius, 3.0) * least(1.85, pow(r, 0.2)), 5) AS radius, round(10.0 + (pos_x - 10.0) * greatest(0.54, 1 / pow(r, 0.34)), 5) AS x, round(-5.0 + (pos_y + 5.0) * greatest(0.54, 1 / pow(r, 0.34)), 5) AS y, round(400.0 - (400.0 - pos_x) / 0.8 * scale, 5) AS zoom_x, round((pos_x + pos_y) / 2, 5) AS middle, round(sqrt(pos_x * pos_x + pos_y * pos_y), 5) AS distance FROM v",
    "srt_collated": "WITH t AS (SELECT id, regexp_replace(title, '[^\\p{L}]', '', 'g') AS t FROM external_sources) SELECT id, row_number() OVER (ORDER BY lower(strip_accents(t)), strip_accents(t) <> t, lower(t), translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'), id) AS ord FROM t",
    "set_difference": f"WITH {N} SELECT id FROM n WHERE contains(text, 'lamp') AND id <> 12",
    "set_split": "SELECT row_id, CASE WHEN updated_at < TIMESTAMP '2025-06-01' THEN 'early' ELSE 'late' END AS source FROM catechism_nodes",
    "set_append_unique": f"WITH {N}, u AS (SELECT id, unnest(list_concat(coalesce(breadcrumbs, []), list_transform(coalesce(headings, []), lambda h: h.text))) AS x, unnest(range(len(coalesce(breadcrumbs, [])) + len(coalesce(headings, [])))) AS pos FROM n), f AS (SELECT id, x, min(pos) AS pos FROM u WHERE x IS NOT NULL GROUP BY id, x), g AS (SELECT id, string_agg(x, ' | ' ORDER BY pos) AS labels FROM f GROUP BY id) SELECT n.id, coalesce(labels, '') AS labels FROM n LEFT JOIN g ON g.id = n.id",
    "scl_labels": f"WITH t AS (SELECT ref_key, label, {CLEAN.format('label')} AS c, {LABEL.format('label')} AS document FROM external_references WHERE label IS NOT NULL) SELECT ref_key, document, trim(regexp_replace(regexp_replace(lower(c), '\\bthe\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS title_key, trim(regexp_replace(regexp_replace(lower(label), '\\.', '', 'g'), '\\s+', ' ', 'g')) AS book, lower(trim(regexp_replace(regexp_replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '[.,;:!?''\"“”‘’«»()\\[\\]{{}}-]', '', 'g'))) AS subtitle, trim(regexp_replace(regexp_replace(regexp_replace(c, '(?i)\\bpara(?:graph)?\\.?\\s*', '§ ', 'g'), '(?i)\\bet\\s+', '', 'g'), '(?i)\\band\\s+', '', 'g')) AS locator, CASE WHEN regexp_matches(c, '^[\"„«]\\s*(.*?)\\s*[\"»]$') THEN '„' || trim(regexp_extract(c, '^[\"„«]\\s*(.*?)\\s*[\"»]$', 1)) || '“' ELSE c END AS quoted FROM t",
    "scl_escapes": r"SELECT note_key, true AS same, length(regexp_replace(text, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')) AS n FROM footnotes WHERE text IS NOT NULL",
    "scl_links": "SELECT note_key, 'see <a href=\"#footnote-' || id || '\" data-footnote-target=\"' || id || '\">note</a> and <a href=\"other\">x</a>' AS html, '/?' || concat_ws('&', 'number=' || replace(url_encode(number), '%2A', '*'), 'key=' || note_key) AS link FROM footnotes WHERE id IS NOT NULL",
    "src_variant_language": "SELECT 'https://hortus.example/doc-' || id AS stem, lang AS language, 'https://hortus.example/doc-' || id || '_' || CASE lang WHEN 'es' THEN 'sp' WHEN 'la' THEN 'xx' WHEN 'zh' THEN 'zh-t' ELSE lang END || '.html' AS url FROM localized_nodes WHERE lang IS NOT NULL AND row_id % 11 <> 0 GROUP BY id, lang",
    "src_filtered_crawl": "WITH RECURSIVE r AS (SELECT 1 AS id UNION SELECT target FROM r JOIN catechism_edges ON source = r.id WHERE target % 10 <> 0) SELECT id::int AS id FROM r",
    "src_sections": f"WITH {N}, a AS (SELECT 'base' AS document, 'en' AS lang, id, row_id AS page FROM n WHERE text IS NOT NULL UNION ALL SELECT 'pack', lang, id, row_id FROM localized_nodes WHERE text IS NOT NULL AND lang IS NOT NULL) SELECT document, lang, count(DISTINCT id) AS sections, min(page) AS first_page FROM a GROUP BY document, lang",
    "src_page_lookup": f"WITH {N}, p AS (SELECT page_id, lang, {_KEY.format(CLEAN.format('x'))} AS k FROM (SELECT page_id, lang, regexp_extract(content, '(?i)<title>([^|<]*?)\\s*[|<-]', 1) AS x FROM source_pages WHERE content IS NOT NULL AND lang IS NOT NULL)), t AS (SELECT {_KEY.format(CLEAN.format('title'))} AS k, min(id) AS id FROM n WHERE title IS NOT NULL GROUP BY 1), o AS (SELECT page_id, row_number() OVER (PARTITION BY lang ORDER BY page_id) AS r FROM p WHERE lang <> 'en'), m AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM n) SELECT page_id, id, 'title' AS how FROM p JOIN t USING (k) WHERE lang = 'en' AND k <> '' UNION ALL SELECT page_id, id, 'place' FROM o JOIN m USING (r)",
    "prj_payload": f"WITH {N} SELECT id, to_json({{'id': id, 'title': title, 'part': part, 'source': {{'file': vatican_source.file, 'url': vatican_source.url}}, 'stats': {{'xrefs': len(xrefs), 'incoming': len(incoming)}}}})::varchar AS doc FROM n",
    "prj_subtitles": f"WITH k AS (SELECT row_id, title, preview, {_SUBTITLE.format('preview')} AS p, {_SUBTITLE.format('text')} AS t, {_SUBTITLE.format('title')} AS h FROM localized_nodes) SELECT row_id, CASE WHEN upper(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))) = 'IN BRIEF' THEN 'Summary' WHEN p <> '' AND p <> t AND p <> h THEN trim(preview) END AS subtitle FROM k",
    "ext_absolute": r'''SELECT page_id, len(regexp_extract_all(content, 'href="#')) AS inner_links, md5(replace(regexp_replace(content, '(?i)\sstyle\s*=\s*"[^"]*"', '', 'g'), 'href="#', 'href="' || url || '#')) AS hash FROM source_pages WHERE content IS NOT NULL AND url IS NOT NULL''',
    "ext_sections": f"{_CLEANED} SELECT id, 1 AS number, title || chr(10) || 'more' AS body FROM t UNION ALL SELECT id, 3, 'again' FROM t",
    "ext_cut_paragraphs": f"{_CLEANED} SELECT id, id % 20 + 1 AS number, title || ' goes on' AS body FROM t UNION ALL SELECT id, id % 20 + 4, 'four' FROM t",
    "ext_canons": f"{_TITLE} SELECT id, 7 AS number, title AS body FROM t UNION ALL SELECT id, 12, 'two' FROM t",
    "ext_first_table": f"{_TITLE} SELECT id, 0 AS pos, title AS \"left\", 'rightin' AS \"right\" FROM t UNION ALL SELECT id, 1, 'in', 'in' FROM t",
}
