"""Relational queries: deduplication, joins, aggregations, ordered operators, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.operators import joins as J
from corpusmill.operators import ordered as O
from corpusmill.functions.text import clean_text, document_label
from corpusmill.operators.dedupe import keep_first, keep_last
from corpusmill.operators.hierarchy import LEVELS, normal_segment
from corpusmill.operators.segment import COMPARE_ONLY, CONTINUES
from corpusmill.plans.graphs import N, nodes
from corpusmill.plans.sqltext import LABEL
from corpusmill.session import table

L = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, lang ORDER BY row_id) AS rn FROM localized_nodes) WHERE rn = 1)"
LANGS = ("fr", "de", "es", "it")
LANGUAGES = (("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish"), ("it", "Italian"), ("la", "Latin"), ("zh", "Chinese"), ("ar", "Arabic"))
RULES = (("synod", r"^Synod of"), ("letter", r"^Letter to"), ("book", r"^Book of"), ("authored", r", "), ("latin", r"^[A-Z][a-z]+ [a-z]"))
BANDS = ((1, 1, 50, "opening"), (2, 40, 120, "middle"), (3, 100, 5000, "closing"))
VISITS = "v AS (SELECT source_id AS reader, node_id AS page, ref_key AS ts FROM external_references WHERE source_id IS NOT NULL)"


def _loc(spark, d, *columns):
    return keep_first(table(spark, d, "localized_nodes").select("row_id", "id", "lang", *columns), ["id", "lang"], ["row_id"])


def agg_keep_first(spark, d):
    """AGG-05, EXT-06, JOIN-04: the first row of each id and language whose text isn't empty."""
    t = table(spark, d, "localized_nodes").where("text IS NOT NULL AND text <> ''").select("id", "lang", "row_id")
    return keep_first(t, ["id", "lang"], ["row_id"])


def agg_keep_last(spark, d):
    """AGG-06: the last revision of each node."""
    return keep_last(table(spark, d, "catechism_nodes").select("id", "row_id", "title"), ["id"], ["row_id"])


def agg_stats(spark, d):
    """AGG-01, AGG-03, AGG-04, SET-02, SNK-03: counts, sums of list lengths, distinct values and the bounding box, in one pass."""
    n = nodes(spark, d, "xrefs", "incoming", "part", "pos_x", "pos_y")
    return n.agg(
        F.count("*").alias("nodes"), F.sum(F.size("xrefs")).cast("bigint").alias("xrefs"), F.sum(F.size("incoming")).cast("bigint").alias("incoming"),
        F.count_distinct("part").alias("parts"), F.min("pos_x").alias("min_x"), F.max("pos_x").alias("max_x"), F.min("pos_y").alias("min_y"), F.max("pos_y").alias("max_y"),
    )


def agg_kind_counts(spark, d):
    """AGG-02: references of each node by kind."""
    r = table(spark, d, "external_references")
    return r.groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "scripture").alias("scripture"), F.count_if(F.col("kind") == "document").alias("document"), F.count_if(F.col("kind").isNull()).alias("other"))


def agg_ordered_text(spark, d):
    """AGG-08: labels of each footnote in order, joined."""
    r = table(spark, d, "external_references").where("label IS NOT NULL AND footnote_id IS NOT NULL")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ref_key", "label"))), lambda x: x["label"])
    return r.groupBy("footnote_id").agg(F.array_join(ordered, " / ").alias("labels"))


def join_lookup(spark, d):
    """JOIN-01, JOIN-03: how many cross-references of each part find their node by an inner lookup, and how many miss it."""
    n = nodes(spark, d, "part", "xrefs")
    refs = n.select("part", F.explode("xrefs").alias("id"))
    found, missing = J.lookup(refs, n.select("id"), ["id"])
    both = found.select("part", F.lit(1).alias("hit")).unionByName(missing.select("part", F.lit(0).alias("hit")))
    return both.groupBy("part").agg(F.sum("hit").alias("found"), F.sum(1 - F.col("hit")).alias("missing"))


def join_overlay(spark, d):
    """JOIN-02: English rows with each language's columns where there are any, in every language of the packs."""
    base = nodes(spark, d, "title", "text", "preview").drop("row_id")
    langs = table(spark, d, "localized_nodes").where("lang IS NOT NULL").select("lang").distinct()
    want = base.join(_loc(spark, d).select("id", "lang").join(J.small(langs), "lang", "left_semi"), "id").withColumn("key", F.concat_ws(":", F.col("id").cast("string"), "lang"))
    over = _loc(spark, d, "title", "text", "preview").where("lang IS NOT NULL").withColumn("key", F.concat_ws(":", F.col("id").cast("string"), "lang"))
    return J.overlay(want, over, "key", ["title", "text", "preview"]).select("id", "lang", "title", "text", "preview")


def join_fallback(spark, d):
    """JOIN-05, SRC-21: the localized preview of each node in each language of the list, else the id's wildcard row."""
    langs = spark.createDataFrame(LANGUAGES, "lang string, name string").select("lang")
    want = nodes(spark, d).select("id").crossJoin(F.broadcast(langs))  # eight rows
    exact = _loc(spark, d, "preview").select("id", "lang", "preview").where("lang <> '*'")
    wild = nodes(spark, d, "preview").select("id", F.lit("*").alias("lang"), "preview")
    return J.with_fallback(want, exact.unionByName(wild), ["id", "lang"], ["id"], "preview", {"lang": F.lit("*")}).select("id", "lang", "preview")


def join_first_rule(spark, d):
    """JOIN-06: the first rule that each title matches."""
    s = table(spark, d, "external_sources")
    return s.select("id", J.first_rule(s, F.col("title"), list(RULES)).alias("rule"))


def join_zip(spark, d):
    """JOIN-07, SRC-22: footnotes and references of a node paired by ordinal."""
    f = table(spark, d, "footnotes").where("node_id IS NOT NULL").select("node_id", "note_key")
    r = table(spark, d, "external_references").where("node_id IS NOT NULL").select("node_id", "ref_key")
    return J.zip_ordered(f, r, ["node_id"], ["note_key"], ["ref_key"]).select("node_id", "note_key", "ref_key")


def join_range_first(spark, d):
    """JOIN-08: the first band that holds each id."""
    bands = spark.createDataFrame(BANDS, "ord int, lo int, hi int, band string")
    return J.range_first(nodes(spark, d).select("id"), "id", bands, "lo", "hi", "ord", "band", ["id"])


def join_selection(spark, d):
    """JOIN-09: nodes chosen by list, by open-ended range, or all of a part."""
    sel = spark.createDataFrame([("list", [1, 5, 9], None, None), ("range", None, 20, 30), ("open", None, 290, None)], "name string, ids array<int>, lo int, hi int")
    n = nodes(spark, d).select("id")
    hit = F.array_contains("ids", F.col("id")) | F.col("id").between(F.col("lo"), F.coalesce("hi", F.lit(2147483647)))
    return n.join(J.small(sel), hit).select("name", "id")


def join_resolve(spark, d):
    """JOIN-15: sources of references by canonical label, else by siglum, else null."""
    s = table(spark, d, "external_sources")
    r = table(spark, d, "external_references").select("ref_key", "label", "canonical_label")
    a = s.select(F.col("title").alias("canonical_label"), F.col("id").alias("by_title"))
    b = s.select(F.col("siglum").alias("label"), F.col("id").alias("by_siglum"))
    return r.join(J.small(a), "canonical_label", "left").join(J.small(b), "label", "left").select("ref_key", F.coalesce("by_title", "by_siglum").alias("source"))


def win_prev_next(spark, d):
    """WIN-01: previous and next id in the global order, without a window over all rows."""
    return O.prev_next(nodes(spark, d).select("id"), "id").select("id", "prev_id", "next_id")


def win_position(spark, d):
    """WIN-02, SRT-01: 0-based position in id order."""
    return O.with_position(nodes(spark, d).select("id"), ["id"])


def win_first_appearance(spark, d):
    """WIN-05: index of each section by first appearance within its part, and its place on the part's colour scale."""
    g = nodes(spark, d, "part", "breadcrumbs").select("part", F.try_element_at("breadcrumbs", F.lit(2)).alias("section"), "id").where("section IS NOT NULL")
    g = g.groupBy("part", "section").agg(F.min("id").alias("first_id"))
    w = W.partitionBy("part").orderBy("first_id")
    g = g.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint")).withColumn("n", F.count("*").over(W.partitionBy("part")))
    c = (F.col("n") - 1) / 2
    return g.select("part", "section", "idx", "n", F.round((F.col("idx") - c) / F.greatest(c, F.lit(1.0)) * 24.0, 6).alias("offset"))


def win_hierarchy(spark, d):
    """WIN-03: five levels carried over the whole id order; a changed level clears all lower ones, the source counts only where nothing is carried."""
    n = nodes(spark, d, "breadcrumbs", "headings", "title")
    heading = lambda kind: F.try_element_at(F.filter("headings", lambda h: h["kind"] == kind), F.lit(-1))["text"]
    crumb = lambda k: F.try_element_at("breadcrumbs", F.lit(k))
    given = {"part": normal_segment(crumb(1)), "section": crumb(2), "chapter": heading("major"), "article": heading("minor"), "paragraph": F.lit(None).cast("string")}
    source = {"part": F.lit(None).cast("string"), "section": F.col("title"), "chapter": F.lit(None).cast("string"), "article": F.lit(None).cast("string"), "paragraph": F.col("title")}
    n = n.select("id", *(c.alias(lv) for lv, c in given.items()), *(c.alias(f"src_{lv}") for lv, c in source.items()))
    ident = lambda c: F.regexp_extract(c, "^([^:]*)", 1)
    return O.fill_levels_ordered(n, "id", list(LEVELS), ident).select("id", *(f"full_{lv}" for lv in LEVELS))


def win_sticky(spark, d):
    """WIN-04: a mode that the latest row with headings sets: whether one of them is the mode's, in the global id order; off before the first."""
    n = nodes(spark, d, "headings").select("id", "headings")
    flag = F.when(F.size("headings") > 0, F.exists("headings", lambda h: F.upper(clean_text(h["text"])) == "THE CUP"))
    return O.carry_forward(n, ["id"], flag, "mode").select("id", F.coalesce("mode", F.lit(False)).alias("mode"))


def win_segment_id(spark, d):
    """WIN-06: number of headed nodes so far within the part."""
    n = nodes(spark, d, "headings", "part").select("id", "part", "headings")
    return O.running_id(n, ["part"], ["id"], F.size("headings") > 0).select("id", "segment")


def win_recent(spark, d):
    """WIN-07, STR-01, SNK-04: the ten most recent distinct pages of each reader, oldest first."""
    v = table(spark, d, "external_references").where("source_id IS NOT NULL").select(F.col("source_id").alias("reader"), F.col("node_id").alias("page"), F.col("ref_key").alias("at"))
    last = v.groupBy("reader", "page").agg(F.max("at").alias("at"))
    k = F.row_number().over(W.partitionBy("reader").orderBy(F.desc("at")))
    top = last.withColumn("k", k).where("k <= 10")
    n = F.count("*").over(W.partitionBy("reader"))
    return top.select("reader", "page", (n - F.col("k") + 1).cast("bigint").alias("ord"))


def win_first_reference(spark, d):
    """WIN-08: the first reference of each footnote."""
    r = table(spark, d, "external_references").where("footnote_id IS NOT NULL").select("footnote_id", "ref_key", "label")
    return keep_first(r, ["footnote_id"], ["ref_key"])


def win_sequence_ids(spark, d):
    """WIN-09: ids note:kind:n numbered within note and kind."""
    r = table(spark, d, "external_references").where("footnote_id IS NOT NULL")
    n = F.row_number().over(W.partitionBy("footnote_id", "kind").orderBy("ref_key"))
    return r.select("ref_key", F.concat_ws(":", "footnote_id", F.coalesce("kind", F.lit("none")), n.cast("string")).alias("rid"))


def flt_search(spark, d):
    """FLT-03, SRT-06: substring search over id, title, text and part, an exact id first, 14 rows as in the client."""
    q = "12"
    n = nodes(spark, d, "title", "text", "part")
    hay = F.lower(F.concat_ws(" ", F.col("id").cast("string"), "title", "text", "part"))
    hits = n.where(F.contains(hay, F.lit(q.strip().lower()))).select("id", "title", (F.col("id").cast("string") == q).alias("exact"))
    return hits.orderBy(F.desc("exact"), "id").limit(14)


def flt_languages(spark, d):
    """FLT-01, FLT-02, FLT-04, SET-05, JOIN-03: rows in allowed languages of nodes that exist, with a title."""
    loc = table(spark, d, "localized_nodes").where(F.col("lang").isin(*LANGS) & F.col("title").isNotNull() & (F.col("title") != ""))
    return loc.join(table(spark, d, "catechism_nodes").select("id").distinct(), "id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


def flt_clamp_date(spark, d):
    """FLT-05: days clamped to the schedule's first and last day."""
    n = table(spark, d, "catechism_nodes").where("updated_at IS NOT NULL").select("row_id", F.to_date("updated_at").alias("day"))
    lo, hi = F.to_date(F.lit("2025-03-01")), F.to_date(F.lit("2025-10-31"))
    return n.select("row_id", F.date_format(F.least(F.greatest("day", lo), hi), "yyyy-MM-dd").alias("clamped"))


def flt_validity(spark, d):
    """FLT-06: labels that are a comparison only, hold no letter, or only continue the document before."""
    r = table(spark, d, "external_references").where("label IS NOT NULL")
    return r.select("ref_key", F.col("label").rlike(COMPARE_ONLY).alias("compare_only"), (~F.col("label").rlike("[A-Za-z]")).alias("no_letter"), document_label(F.col("label")).rlike(CONTINUES).alias("continues"))


def flt_reuse(spark, d):
    """FLT-07: revisions that aren't in the base output yet."""
    t = table(spark, d, "catechism_nodes").select("row_id", "id")
    return t.join(nodes(spark, d).select("row_id"), "row_id", "left_anti")


def flt_plain_notes(spark, d):
    """FLT-08, JOIN-03: footnotes without any reference."""
    return table(spark, d, "footnotes").select("note_key", F.col("id").alias("footnote_id")).join(table(spark, d, "external_references").select("footnote_id").distinct(), "footnote_id", "left_anti")


def flt_capability(spark, d):
    """FLT-09: pages of the councils' archive, over the pages' addresses with that folder before every file whose page is known by language."""
    moved = F.when(F.col("lang").isNull(), F.col("url")).otherwise(F.regexp_replace("url", "/archive/", "/ARCHIVE/hist_councils/"))
    return table(spark, d, "source_pages").select("page_id", moved.rlike(r"(?i)/archive/hist_councils/").alias("archived"))


def srt_locale(spark, d):
    """SRT-03, SRT-04, SRT-07: languages of each node in locale order, and pages by the number in their name."""
    p = table(spark, d, "source_pages").select("page_id", F.regexp_extract("file", r"([0-9]+)", 1).try_cast("bigint").alias("num"), "lang")
    last = p.withColumn("late", F.col("num").isNull())  # numbers first; a language may hold any share of the pages
    out = O.with_position(last, ["late", "num", "page_id"], "ord", ["lang"])
    return out.select("page_id", "num", "lang", (F.col("ord") + 1).alias("ord"))


def set_union_distinct(spark, d):
    """SET-01, SET-02: ids of all tables in one set, with the tables that hold them."""
    parts = [table(spark, d, "catechism_nodes").select("id", F.lit("n").alias("t")), table(spark, d, "localized_nodes").select("id", F.lit("l").alias("t")), table(spark, d, "footnotes").select(F.col("node_id").alias("id"), F.lit("f").alias("t"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return u.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("t")), "").alias("tables"))


def src_catalog(spark, d):
    """SRC-16: rows of each language pack beside the dimension of languages; a missing pack counts 0."""
    dim = spark.createDataFrame(LANGUAGES, "lang string, name string")
    packs = table(spark, d, "localized_nodes").groupBy("lang").agg(F.count("*").alias("n"))
    return J.small(dim).join(packs, "lang", "left").select("lang", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def prj_nested(spark, d):
    """PRJ-05, PRJ-08, SRT-07: title by fallback, label, source page and length of each node."""
    n = nodes(spark, d, "title", "headings", "breadcrumbs", "text", "vatican_source")
    title = F.coalesce(F.try_element_at("headings", F.lit(-1))["text"], F.try_element_at("breadcrumbs", F.lit(-1)), F.concat(F.lit("Paragraph "), F.col("id").cast("string")))
    return n.select("id", title.alias("title"), F.coalesce("title", title).alias("label"), F.col("vatican_source.local_path").alias("page"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))


def prj_breadcrumbs(spark, d):
    """PRJ-03, PRJ-09: part number, kind and title of the first breadcrumb, tooltip from the deepest one or the preview."""
    n = nodes(spark, d, "breadcrumbs", "preview", "title")
    first = F.coalesce(F.try_element_at("breadcrumbs", F.lit(1)), F.lit("Prologue"))
    part = F.when(first.rlike("(?i)^part one"), "one").when(first.rlike("(?i)^part two"), "two").when(first.rlike("(?i)^part three"), "three").when(first.rlike("(?i)^part four"), "four").otherwise("prologue")
    tip = F.coalesce(F.try_element_at("breadcrumbs", F.lit(-1)), F.substring("preview", 1, 96), "title")
    return n.select("id", part.alias("part_no"), F.regexp_extract(first, r"^(\w+ \w+):", 1).alias("kind"), tip.alias("tooltip"))


QUERIES = {
    f.__name__: f
    for f in (
        agg_keep_first, agg_keep_last, agg_stats, agg_kind_counts, agg_ordered_text, join_lookup, join_overlay, join_fallback, join_first_rule, join_zip, join_range_first,
        join_selection, join_resolve, win_prev_next, win_position, win_first_appearance, win_hierarchy, win_sticky, win_segment_id, win_recent, win_first_reference, win_sequence_ids, flt_search,
        flt_languages, flt_clamp_date, flt_validity, flt_reuse, flt_plain_notes, flt_capability, srt_locale, set_union_distinct, src_catalog, prj_nested, prj_breadcrumbs,
    )
}

_LV = ("part", "section", "chapter", "article", "paragraph")


def _steps() -> str:
    """One row of the walk: of each level its explicit value, then the carried one unless a higher level changed."""
    out, reset = [], "false"
    for lv in _LV:
        out.append(f"CASE WHEN {reset} THEN NULL ELSE r.{lv} END AS c_{lv}")
        same = f"x.{lv} IS NOT NULL AND c_{lv} IS NOT NULL AND regexp_extract(x.{lv}, '^([^:]*)', 1) = regexp_extract(c_{lv}, '^([^:]*)', 1)"
        out.append(f"CASE WHEN {same} THEN c_{lv} WHEN x.{lv} IS NOT NULL THEN x.{lv} WHEN c_{lv} IS NULL THEN x.src_{lv} END AS e_{lv}")
        out.append(f"coalesce(e_{lv}, c_{lv}) AS f_{lv}")
        out.append(f"({reset} OR (e_{lv} IS NOT NULL AND e_{lv} IS DISTINCT FROM c_{lv})) AS z_{lv}")
        reset = f"z_{lv}"
    return ", ".join(out)


_HIERARCHY = (
    f"WITH RECURSIVE {N}, x AS (SELECT row_number() OVER (ORDER BY id) AS i, id, 'Part ' || (CASE WHEN breadcrumbs[1] LIKE 'PART ONE%' THEN 1 WHEN breadcrumbs[1] LIKE 'PART TWO%' THEN 2 WHEN breadcrumbs[1] LIKE 'PART THREE%' THEN 3 WHEN breadcrumbs[1] LIKE 'PART FOUR%' THEN 4 END) || ': ' || array_to_string(list_transform(string_split(regexp_extract(breadcrumbs[1], ': (.*)$', 1), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS part, NULL::varchar AS src_part, breadcrumbs[2] AS section, title AS src_section, "
    "list_filter(headings, lambda h: h.kind = 'major')[-1].text AS chapter, NULL::varchar AS src_chapter, list_filter(headings, lambda h: h.kind = 'minor')[-1].text AS article, NULL::varchar AS src_article, NULL::varchar AS paragraph, title AS src_paragraph FROM n), "
    f"r AS (SELECT 0::bigint AS i, 0 AS id, {', '.join('NULL::varchar AS ' + lv for lv in _LV)} UNION ALL SELECT i, id, {', '.join('f_' + lv for lv in _LV)} FROM (SELECT x.i, x.id, {_steps()} FROM r JOIN x ON x.i = r.i + 1)) "
    f"SELECT id, {', '.join(f'{lv} AS full_{lv}' for lv in _LV)} FROM r WHERE i > 0"
)
_RULES = " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in RULES)
_BANDS = " UNION ALL ".join(f"SELECT {o} AS ord, {a} AS lo, {b} AS hi, '{n}' AS band" for o, a, b, n in BANDS)
_LANG_DIM = " UNION ALL ".join(f"SELECT '{a}' AS lang, '{b}' AS name" for a, b in LANGUAGES)
SQL = {
    "agg_keep_first": "SELECT id, lang, min(row_id) AS row_id FROM localized_nodes WHERE text <> '' GROUP BY id, lang",
    "agg_keep_last": "SELECT id, row_id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) AS k FROM catechism_nodes) WHERE k = 1",
    "agg_stats": f"WITH {N} SELECT count(*) AS nodes, sum(len(xrefs))::bigint AS xrefs, sum(len(incoming))::bigint AS incoming, count(DISTINCT part) AS parts, min(pos_x) AS min_x, max(pos_x) AS max_x, min(pos_y) AS min_y, max(pos_y) AS max_y FROM n",
    "agg_kind_counts": "SELECT node_id, count(*) AS n, count(*) FILTER (kind = 'scripture') AS scripture, count(*) FILTER (kind = 'document') AS document, count(*) FILTER (kind IS NULL) AS other FROM external_references GROUP BY node_id",
    "agg_ordered_text": "SELECT footnote_id, string_agg(label, ' / ' ORDER BY ref_key) AS labels FROM external_references WHERE label IS NOT NULL AND footnote_id IS NOT NULL GROUP BY footnote_id",
    "join_lookup": f"WITH {N}, x AS (SELECT part, unnest(xrefs) AS id FROM n) SELECT part, count(*) FILTER (id IN (SELECT id FROM n)) AS found, count(*) FILTER (id NOT IN (SELECT id FROM n)) AS missing FROM x GROUP BY part",
    "join_overlay": f"WITH {N}, {L} SELECT n.id, l.lang, coalesce(l.title, n.title) AS title, coalesce(l.text, n.text) AS text, coalesce(l.preview, n.preview) AS preview FROM n JOIN l ON l.id = n.id WHERE l.lang IS NOT NULL",
    "join_fallback": f"WITH {N}, {L}, d AS ({_LANG_DIM}) SELECT n.id, d.lang, coalesce(l.preview, n.preview) AS preview FROM n CROSS JOIN d LEFT JOIN l ON l.id = n.id AND l.lang = d.lang",
    "join_first_rule": f"SELECT id, CASE {_RULES} END AS rule FROM external_sources",
    "join_zip": "WITH f AS (SELECT node_id, note_key, row_number() OVER (PARTITION BY node_id ORDER BY note_key) AS k FROM footnotes), r AS (SELECT node_id, ref_key, row_number() OVER (PARTITION BY node_id ORDER BY ref_key) AS k FROM external_references) SELECT f.node_id, note_key, ref_key FROM f JOIN r ON f.node_id = r.node_id AND f.k = r.k",
    "join_range_first": f"WITH {N}, b AS ({_BANDS}) SELECT n.id, (SELECT band FROM b WHERE n.id BETWEEN lo AND hi ORDER BY ord LIMIT 1) AS band FROM n",
    "join_selection": f"WITH {N} SELECT 'list' AS name, id FROM n WHERE id IN (1, 5, 9) UNION ALL SELECT 'range', id FROM n WHERE id BETWEEN 20 AND 30 UNION ALL SELECT 'open', id FROM n WHERE id >= 290",
    "join_resolve": "SELECT ref_key, coalesce(a.id, b.id) AS source FROM external_references r LEFT JOIN external_sources a ON a.title = r.canonical_label LEFT JOIN external_sources b ON b.siglum = r.label",
    "win_prev_next": f"WITH {N} SELECT id, lag(id) OVER (ORDER BY id) AS prev_id, lead(id) OVER (ORDER BY id) AS next_id FROM n",
    "win_position": f"WITH {N} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM n",
    "win_first_appearance": f"WITH {N}, g AS (SELECT part, breadcrumbs[2] AS section, min(id) AS first_id FROM n WHERE breadcrumbs[2] IS NOT NULL GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY first_id) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM g) SELECT part, section, idx, n, round((idx - (n - 1) / 2.0) / greatest((n - 1) / 2.0, 1.0) * 24.0, 6) AS \"offset\" FROM h",
    "win_hierarchy": _HIERARCHY,
    "win_sticky": f"WITH {N} SELECT id, coalesce(last_value(CASE WHEN len(headings) > 0 THEN len(list_filter(headings, lambda h: upper(h.text) = 'THE CUP')) > 0 END IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING), false) AS mode FROM n",
    "win_segment_id": f"WITH {N} SELECT id, sum(CASE WHEN len(headings) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY id)::bigint AS segment FROM n",
    "win_recent": f"WITH {VISITS}, a AS (SELECT reader, page, max(ts) AS ts FROM v GROUP BY reader, page), b AS (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY ts DESC) AS k FROM a) SELECT reader, page, count(*) OVER (PARTITION BY reader) - k + 1 AS ord FROM b WHERE k <= 10",
    "win_first_reference": "SELECT footnote_id, ref_key, label FROM (SELECT *, row_number() OVER (PARTITION BY footnote_id ORDER BY ref_key) AS k FROM external_references WHERE footnote_id IS NOT NULL) WHERE k = 1",
    "win_sequence_ids": "SELECT ref_key, footnote_id || ':' || coalesce(kind, 'none') || ':' || row_number() OVER (PARTITION BY footnote_id, kind ORDER BY ref_key) AS rid FROM external_references WHERE footnote_id IS NOT NULL",
    "flt_search": f"WITH {N} SELECT id, title, id = 12 AS exact FROM n WHERE contains(lower(concat_ws(' ', id::varchar, title, text, part)), '12') ORDER BY id = 12 DESC, id LIMIT 14",
    "flt_languages": "SELECT lang, count(*) AS n FROM localized_nodes WHERE lang IN ('fr', 'de', 'es', 'it') AND title <> '' AND id IN (SELECT id FROM catechism_nodes) GROUP BY lang",
    "flt_clamp_date": "SELECT row_id, strftime(least(greatest(updated_at::date, DATE '2025-03-01'), DATE '2025-10-31'), '%Y-%m-%d') AS clamped FROM catechism_nodes WHERE updated_at IS NOT NULL",
    "flt_validity": rf"SELECT ref_key, regexp_matches(label, '(?i)^[,.;:\s]*cf\.?[,.;:\s]*$') AS compare_only, NOT regexp_matches(label, '[A-Za-z]') AS no_letter, regexp_matches({LABEL.format('label')}, '(?i)^(?:\d+(?::\d+)?(?:\s*[-,]\s*\d+(?::\d+)?)?|§+\s*\d+|can(?:n)?\.?\s*\d+|cann?\.\s*\d+|preface\b|introduction\b|praenotanda\b)') AS continues FROM external_references WHERE label IS NOT NULL",
    "flt_reuse": f"WITH {N} SELECT row_id, id FROM catechism_nodes WHERE row_id NOT IN (SELECT row_id FROM n)",
    "flt_plain_notes": "SELECT note_key, id AS footnote_id FROM footnotes f WHERE NOT EXISTS (SELECT 1 FROM external_references r WHERE r.footnote_id = f.id)",
    "flt_capability": "SELECT page_id, regexp_matches(CASE WHEN lang IS NULL THEN url ELSE replace(url, '/archive/', '/ARCHIVE/hist_councils/') END, '(?i)/archive/hist_councils/') AS archived FROM source_pages",
    "srt_locale": "WITH p AS (SELECT page_id, try_cast(nullif(regexp_extract(file, '([0-9]+)', 1), '') AS bigint) AS num, lang FROM source_pages) SELECT *, row_number() OVER (PARTITION BY lang ORDER BY num ASC NULLS LAST, page_id) AS ord FROM p",
    "set_union_distinct": "WITH u AS (SELECT id, 'n' AS t FROM catechism_nodes UNION SELECT id, 'l' FROM localized_nodes UNION SELECT node_id, 'f' FROM footnotes) SELECT id, string_agg(t, '' ORDER BY t) AS tables FROM u GROUP BY id",
    "src_catalog": f"WITH d AS ({_LANG_DIM}) SELECT d.lang, d.name, (SELECT count(*) FROM localized_nodes l WHERE l.lang = d.lang) AS n FROM d",
    "prj_nested": f"WITH {N}, t AS (SELECT *, coalesce(headings[len(headings)].text, breadcrumbs[len(breadcrumbs)], 'Paragraph ' || id) AS tt FROM n) SELECT id, tt AS title, coalesce(title, tt) AS label, vatican_source.local_path AS page, coalesce(length(text), 0) AS n_chars FROM t",
    "prj_breadcrumbs": f"WITH {N}, t AS (SELECT *, coalesce(breadcrumbs[1], 'Prologue') AS f FROM n) SELECT id, CASE WHEN regexp_matches(f, '(?i)^part one') THEN 'one' WHEN regexp_matches(f, '(?i)^part two') THEN 'two' WHEN regexp_matches(f, '(?i)^part three') THEN 'three' WHEN regexp_matches(f, '(?i)^part four') THEN 'four' ELSE 'prologue' END AS part_no, regexp_extract(f, '^(\\w+ \\w+):', 1) AS kind, coalesce(breadcrumbs[len(breadcrumbs)], substring(preview, 1, 96), title) AS tooltip FROM t",
}
