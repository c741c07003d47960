"""Text queries: scalar functions, segmentation, references, HTML extraction, schedule, streaming twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import html as H
from corpusmill.operators import segment as S
from corpusmill.operators.dedupe import keep_first
from corpusmill.operators.joins import priority_pick
from corpusmill.plans.graphs import N, nodes
from corpusmill.sources import pages as P
from corpusmill.sources.sinks import document
from corpusmill.streaming import state
from corpusmill.plans.sqltext import CLEAN, LABEL, SEGMENTS, SPACE
from corpusmill.session import table

START, END = "2025-04-03", "2026-04-02"
#: Themes of the schedule: (key, score, patterns of the day, of its readings, of its season, paragraph ids).
PROFILES = (
    ("lamp", 10.0, ("lamp", "light"), ("watch",), (), (1, 2, 3)),
    ("water", 10.0, ("water",), ("spring", "river"), ("easter",), (7, 8)),
    ("bread", 8.0, ("bread", "harvest"), (), ("lent",), (11, 12, 13, 14)),
)
#: Weights of hits in the day, its readings and its season.
HITS = (1.0, 0.7, 0.35)
#: Paragraphs of each season.
SEASONAL = {
    "Advent": (522, 524, 559, 671, 972), "Christmas": (456, 461, 483, 525, 526, 563), "Lent": (540, 1430, 1434, 2015, 2846), "Holy Week": (571, 595, 612, 618, 624),
    "Easter": (638, 659, 731, 1085, 1169), "Ordinary Time": (426, 1691, 1700, 1812, 2013, 2558, 748, 849),
}
RAW_SEASONS = (" Advent, first week", "Christmas Octave", "Lent", "Holy Week in Lent", "Easter season", "ordinary time after Easter", "Harvest ", "")


def scl_clean_preview_slug(spark, d):
    """SCL-01 to SCL-04: cleaned text, preview, slug and label key of every node."""
    n = nodes(spark, d, "text", "title").where("text IS NOT NULL")
    t = T.clean_text(F.col("text"))
    return n.select("id", F.length(t).cast("bigint").alias("n"), T.preview(t).alias("preview"), T.slug(F.col("title")).alias("slug"), T.label_key(F.col("title")).alias("label_key"))


def scl_title_case(spark, d):
    """SCL-05: titles of the reference list and of the parts in title case."""
    t = table(spark, d, "external_sources").select("id", F.lower("title").alias("t"))
    parts = table(spark, d, "catechism_nodes").where("part IS NOT NULL").select(F.col("part").alias("id"), F.concat(F.lit("("), F.regexp_replace("part", ": ", ": vi. of "), F.lit(") to")).alias("t")).distinct()
    return t.unionByName(parts).select("id", T.title_case(F.col("t")).alias("title"))


def scl_html(spark, d):
    """SCL-06: texts escaped for HTML."""
    return table(spark, d, "footnotes").where("text IS NOT NULL").select("note_key", T.escape_html(F.col("text")).alias("html"))


def scl_roman(spark, d):
    """SCL-07: Roman numerals of the ids and back."""
    n = nodes(spark, d).select("id", T.int_to_roman(F.col("id")).alias("roman"))
    return n.select("id", "roman", T.roman_to_int(F.col("roman")).cast("bigint").alias("back"))


def scl_hash_pick(spark, d):
    """SCL-08: the hash of each title as a number, and a pick by it."""
    n = nodes(spark, d, "part").where("part IS NOT NULL")
    key = F.concat_ws(":", F.col("id").cast("string"), "part")
    return n.select("id", T.hash32(key).alias("hash"), T.hash_pick(key, F.array(F.lit(3), F.lit(5), F.lit(7))).cast("bigint").alias("pick"))


def scl_numbers(spark, d):
    """SCL-09, SCL-10, SCL-11, SRT-04: numbers of each label expanded, its pinpoints, and the first number."""
    r = table(spark, d, "external_references").where("label IS NOT NULL")
    nums = T.expand_numbers(F.col("label"))
    pins = S.pinpoints(F.col("label"))
    return r.select("ref_key", F.size(nums).cast("bigint").alias("n"), F.coalesce(F.aggregate(nums, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("total"), F.size(pins).cast("bigint").alias("pins"), T.number_in(F.col("label")).cast("bigint").alias("first"))


def scl_url_language(spark, d):
    """SCL-20, SCL-27: language and number in a page's address, the language to show, and a link."""
    p = table(spark, d, "source_pages").where("url IS NOT NULL")
    lang = F.regexp_extract("url", r"/([a-z]{2})/", 1)
    shown = T.first_language(F.nullif(lang, F.lit("")), F.col("lang"), allowed=("en", "fr", "de", "es", "it", "la", "zh", "ar"))
    return p.select("page_id", lang.alias("path_lang"), shown.alias("shown"), T.query_url(F.col("url"), lang=F.col("lang"), id=F.col("page_id")).alias("link"))


def _raw_season(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RAW_SEASONS)), (k % len(RAW_SEASONS) + 1).cast("int"))


def scl_corpus_season(spark, d):
    """SCL-21, SCL-22: joined non-empty fields, and a season by ordered rules."""
    n = nodes(spark, d, "part", "title", "preview")
    c = T.join_filled(" | ", F.col("part"), F.col("title"), F.col("preview"))
    return n.select("id", c.alias("corpus"), T.season(_raw_season(F.col("id"))).alias("season"))


def scl_dates(spark, d):
    """SCL-23, SCL-24: ISO day, year, month-day and a rounded age of each revision."""
    n = table(spark, d, "catechism_nodes").where("updated_at IS NOT NULL")
    return n.select("row_id", F.date_format("updated_at", "yyyy-MM-dd").alias("day"), F.year("updated_at").cast("bigint").alias("year"), F.date_format("updated_at", "MM-dd").alias("month_day"), F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("updated_at")).cast("bigint").alias("age"))


def ext_lines(spark, d):
    """EXT-02: segments of each node's lines, opened by lines that begin with a saint or a question."""
    ls = S.lines(nodes(spark, d, "text"), "id", "text")
    return S.marker_segments(ls, ["id"], "pos", "line", r"^(?:St\.|Is it|How well)").select("id", F.col("segment").cast("bigint").alias("segment"), F.col("first_pos").cast("bigint").alias("first_pos"), "n_lines", "body")


def ext_paragraph_start(spark, d):
    """EXT-03, EXT-04, EXT-05: numbered paragraph starts of the documents' lines."""
    ls = S.lines(table(spark, d, "documents"), "doc_id", "text")
    p = ls.withColumn("s", S.paragraph_start(F.col("line"))).where("s IS NOT NULL")
    return p.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.id").cast("bigint").alias("number"), F.col("s.rest").alias("rest"))


def ext_note_segments(spark, d):
    """EXT-22: reference segments of the footnotes with a sticky comparison flag."""
    return S.note_segments(table(spark, d, "footnotes"), "note_key", "text").select("note_key", F.col("pos").cast("bigint").alias("pos"), "segment", "compare")


def ext_inline_notes(spark, d):
    """EXT-25: parenthetical notes with a digit in the documents, numbered."""
    return S.inline_notes(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("n").cast("bigint").alias("n"), "note")


def ext_paragraphs(spark, d):
    """EXT-01, EXT-21: paragraphs of every page with anchor and the number of headings and links (rows only)."""
    p = table(spark, d, "source_pages").where("content IS NOT NULL")
    return H.apply_rows(p, ["page_id"], ["content"], lambda c: [(a, t, len(h), len(x)) for a, t, h, x in H.paragraphs(c)], "anchor string, text string, headings int, links int")


def ext_links(spark, d):
    """EXT-16: absolute links of every page (rows only)."""
    return H.apply_rows(table(spark, d, "source_pages").where("content IS NOT NULL"), ["page_id"], ["content", "url"], H.links, "link string")


def ext_raw_links(spark, d):
    """EXT-16: quoted addresses of every page, JVM-side."""
    p = table(spark, d, "source_pages").where("content IS NOT NULL")
    got = p.select("page_id", F.explode(F.regexp_extract_all("content", F.lit('href="([^"#]+)"'), F.lit(1))).alias("href"))
    return got.groupBy("page_id", "href").agg(F.count("*").alias("n"))


def ext_index(spark, d):
    """EXT-17: list items of every page with title link and chapter links (rows only)."""
    return H.apply_rows(table(spark, d, "source_pages").where("content IS NOT NULL"), ["page_id"], ["content", "url"], lambda c, u: [(t, x, len(k)) for t, x, k in H.index_entries(c, u)], "title string, link string, chapters int")


def ext_tables(spark, d):
    """EXT-18, EXT-19: two-column rows of the pages' tables (rows only)."""
    return H.apply_rows(table(spark, d, "source_pages").where("content IS NOT NULL"), ["page_id"], ["content"], H.bilingual_rows, "left string, right string")


def src_date_spine(spark, d):
    """SRC-15: the days of the schedule."""
    return P.date_spine(spark, START, END).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


def src_variants(spark, d):
    """SRC-18: language variants of each page stem."""
    return P.language_variants(table(spark, d, "source_pages").where("lang IS NOT NULL"))


def src_totals(spark, d):
    """SRC-10: totals of result lines, built from the nodes' numbers."""
    n = nodes(spark, d).select("id", F.concat(F.lit("Results 1 - 25 of "), F.col("id").cast("string")).alias("line"))
    return n.select("id", P.result_total(F.col("line")).cast("bigint").alias("total"))


def src_charset(spark, d):
    """SRC-02, SRC-03: pages as bytes in their own charset, read back by what they declare: UTF-8, or Latin-1 if it is declared or nothing is.

    Latin-1 bytes are made of the pages all of whose characters it has.
    """
    p = table(spark, d, "source_pages").where("content IS NOT NULL").select("page_id", "content")
    low = F.regexp_replace("content", r"(?i)charset\s*=\s*[\"']?utf-?8", "charset=iso-8859-1")
    latin = F.when(F.col("content").rlike(r"\A[\x00-\xFF]*\z"), F.encode(low, "ISO-8859-1"))
    utf = F.encode("content", "UTF-8")
    return p.select("page_id", (T.decode_page(latin) == low).alias("latin_read"), F.length(T.decode_page(utf)).cast("bigint").alias("utf_length"))


def snk_document(spark, d):
    """SNK-01, SRC-11: the reference list as one JSON document, read back under an explicit schema."""
    doc = document(table(spark, d, "external_sources").select("id", "title"), "id")
    back = doc.select(F.from_json("document", "rows array<struct<id:string,title:string>>, count bigint").alias("j"))
    return back.select(F.inline("j.rows"))


def _days(spark, d):
    """Every day of the schedule with its 0-based index, and what the node of the day's number holds, if there is one."""
    n = nodes(spark, d, "title", "preview", "headings").select("id", F.col("title").alias("name"), F.col("preview").alias("reading"), F.try_element_at("headings", F.lit(-1))["kind"].alias("type"))
    k = F.datediff("day", F.lit(START).cast("date"))
    day = P.date_spine(spark, START, END).select(F.date_format("day", "yyyy-MM-dd").alias("day"), k.alias("idx"), (k + 1).alias("id"))
    return day.join(n, "id", "left").withColumn("season", T.season(_raw_season(F.col("idx"))))


def sch_theme_pick(spark, d):
    """AGG-10, JOIN-14, SRT-02, SRT-05, SCL-28: the best theme of every day by weighted pattern hits, else its season's; a paragraph by hash."""
    days = _days(spark, d).withColumn("corpus", T.join_filled(" | ", "season", F.coalesce("name", F.lit("Ferial Day")), F.coalesce("type", F.lit("FERIA")), "reading"))

    def score(p):
        hits = [(c, F.col("corpus"), HITS[0]) for c in p[2]] + [(c, F.col("corpus"), HITS[1]) for c in p[3]] + [(c, F.col("season"), HITS[2]) for c in p[4]]
        return sum((F.when(of.rlike(f"(?i){c}"), p[1] * w).otherwise(0.0) for c, of, w in hits), F.lit(0.0))

    # profiles are literals: scores are columns of one projection, so there is neither a cross join nor a shuffle
    hits = F.array(*[F.struct(score(p).alias("score"), F.lit(-o).alias("neg"), F.lit(p[0]).alias("key"), F.array(*map(F.lit, p[5])).alias("ids")) for o, p in enumerate(PROFILES)])
    out = days.withColumn("b", F.array_max(F.filter(hits, lambda x: x["score"] > 0)))
    lists = F.create_map(*(x for k, v in SEASONAL.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    seasonal = F.coalesce(F.try_element_at(lists, F.col("season")), F.array(*map(F.lit, SEASONAL["Ordinary Time"])))
    picked = T.hash_pick(F.concat_ws(":", "day", F.col("b.key")), F.col("b.ids"))
    fallback = T.hash_pick(F.concat_ws(":", "day", "season", F.col("idx").cast("string")), seasonal, F.col("idx"))
    return out.select("day", F.coalesce(F.col("b.key"), T.slug(F.col("season"))).alias("theme"), F.round(F.coalesce(F.col("b.score"), F.lit(0.0)), 2).alias("score"), F.coalesce(picked, fallback).cast("bigint").alias("paragraph"))


def sch_calendar(spark, d):
    """SRC-13, SRC-14, JOIN-13: entries of a calendar with the readings of their day, by date, one entry for each day: prioritized, else a solemnity, else the first.

    Days in one of both only are kept, with a default name and type.
    """
    n = table(spark, d, "catechism_nodes").where("updated_at IS NOT NULL")
    kind = F.when(F.exists(F.coalesce("headings", F.array().cast("array<struct<kind:string,text:string>>")), lambda h: h["kind"] == "major"), "SOLEMNITY").otherwise("FEAST")
    entries = n.select(F.date_format("updated_at", "yyyy-MM-dd").alias("day"), "row_id", F.col("title").alias("name"), kind.alias("type"), F.col("vatican_source").isNull().alias("first"))
    best = priority_pick(entries, ["day"], [F.when(F.col("first"), 0).when(F.col("type") == "SOLEMNITY", 1).otherwise(2), "row_id"])
    read = table(spark, d, "localized_nodes").where("updated_at IS NOT NULL").select(F.date_format("updated_at", "yyyy-MM-dd").alias("day"), "row_id", "lang")
    readings = keep_first(read, ["day"], ["row_id"]).select("day", F.col("lang").alias("reading"))
    got = best.join(readings, "day", "full")
    return got.select("day", F.coalesce("name", F.lit("Ferial Day")).alias("name"), F.coalesce("type", F.lit("FERIA")).alias("type"), "reading")


def str_debounce(spark, d):
    """STR-02, STR-03: events after which their user was quiet for a minute."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return state.debounce(e, "user_id", "ts", 60.0, "event_id").groupBy("user_id").agg(F.count("*").alias("n"))


def str_recent(spark, d):
    """STR-01: batch twin of the per-user recency state over the events."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    last = e.withColumn("at", F.struct("ts", "event_id"))
    return state.recent_batch(last, "user_id", "event_type", "at", 3).select("user_id", F.col("ord").cast("bigint").alias("ord"), "event_type")


def agg_profile_hits(spark, d):
    """AGG-10: summed scores of the themes' day patterns over all nodes."""
    n = nodes(spark, d, "text").select(F.coalesce("text", F.lit("")).alias("t"))
    return n.agg(*[F.sum(F.when(F.col("t").rlike("(?i)" + "|".join(p[2])), p[1]).otherwise(0.0)).alias(p[0]) for p in PROFILES])


QUERIES = {
    f.__name__: f
    for f in (
        scl_clean_preview_slug, scl_title_case, scl_html, scl_roman, scl_hash_pick, scl_numbers, scl_url_language, scl_corpus_season, scl_dates, ext_lines,
        ext_paragraph_start, ext_note_segments, ext_inline_notes, ext_paragraphs, ext_links, ext_raw_links, ext_index, ext_tables, src_date_spine, src_variants, src_totals, src_charset,
        snk_document, sch_theme_pick, sch_calendar, str_debounce, str_recent, agg_profile_hits,
    )
}

_SP, _CLEAN = SPACE, CLEAN
_HASH = "('0x' || substr(sha1({0}), 1, 8))::bigint"
_SEASON = "(SELECT CASE WHEN r = '' THEN 'Ordinary Time' WHEN contains(lower(r), 'holy week') THEN 'Holy Week' WHEN contains(lower(r), 'ordinary') THEN 'Ordinary Time' WHEN contains(lower(r), 'christmas') THEN 'Christmas' WHEN contains(lower(r), 'advent') THEN 'Advent' WHEN contains(lower(r), 'lent') THEN 'Lent' WHEN contains(lower(r), 'easter') THEN 'Easter' ELSE trim(r) END FROM (SELECT (" + str(list(RAW_SEASONS)) + ")[{0} % 8 + 1] AS r))"


def _score(p) -> str:
    hits = [(c, "corpus", HITS[0]) for c in p[2]] + [(c, "corpus", HITS[1]) for c in p[3]] + [(c, "season", HITS[2]) for c in p[4]]
    return "(" + " + ".join(f"CASE WHEN regexp_matches({of}, '(?i){c}') THEN {p[1]}::double * {w}::double ELSE 0.0::double END" for c, of, w in hits) + ")"


SQL = {
    "scl_clean_preview_slug": f"WITH {N}, c AS (SELECT id, title, {_CLEAN.format('text')} AS t FROM n WHERE text IS NOT NULL) SELECT id, length(t) AS n, CASE WHEN length(t) > 220 THEN regexp_replace(substring(t, 1, 217), '{_SP}$', '') || '...' ELSE t END AS preview, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, trim(regexp_replace(regexp_replace(lower({_CLEAN.format('title')}), '\\bthe\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS label_key FROM c",
    "scl_title_case": "WITH t AS (SELECT id, lower(title) AS t FROM external_sources UNION ALL SELECT DISTINCT part, '(' || replace(part, ': ', ': vi. of ') || ') to' FROM catechism_nodes WHERE part IS NOT NULL), w AS (SELECT id, string_split({0}, ' ') AS ws FROM t), u AS (SELECT id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM w), g AS (SELECT *, lag(w) OVER (PARTITION BY id ORDER BY i) AS before, regexp_extract(w, '^([^A-Za-z]*)([A-Za-z][A-Za-z'']*)([^A-Za-z]*)$', ['a', 'b', 'c']) AS p FROM u), c AS (SELECT *, lower(p.b) AS core FROM g), d AS (SELECT *, CASE WHEN core = '' THEN w ELSE p.a || CASE WHEN core IN ('i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x') THEN upper(core) WHEN i = 1 OR i = n OR before LIKE '%.' OR before LIKE '%:' OR core NOT IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with') THEN upper(core[1]) || core[2:] ELSE core END || p.c END AS o FROM c) SELECT id, string_agg(o, ' ' ORDER BY i) AS title FROM d GROUP BY id".format(CLEAN.format("t")),
    "scl_html": "SELECT note_key, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM footnotes WHERE text IS NOT NULL",
    "scl_roman": f"WITH {N} SELECT id, repeat('M', id // 1000) || (['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'])[id // 100 % 10 + 1] || (['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'])[id // 10 % 10 + 1] || (['','I','II','III','IV','V','VI','VII','VIII','IX'])[id % 10 + 1] AS roman, id::bigint AS back FROM n",
    "scl_hash_pick": f"WITH {N}, h AS (SELECT id, {_HASH.format(chr(39).join(['id || ', ':', ' || part']))} AS hash FROM n WHERE part IS NOT NULL) SELECT id, hash, ([3, 5, 7])[hash % 3 + 1]::bigint AS pick FROM h",
    "scl_numbers": r"WITH t AS (SELECT ref_key, label, unnest(regexp_extract_all(label, '(\d+\s*[-–]\s*\d+|\d+)')) AS tok FROM external_references WHERE label IS NOT NULL), p AS (SELECT ref_key, try_cast(regexp_extract(tok, '^(\d+)', 1) AS bigint) AS a, try_cast(nullif(regexp_extract(tok, '[-–]\s*(\d+)$', 1), '') AS bigint) AS b FROM t), x AS (SELECT ref_key, unnest(CASE WHEN b IS NULL THEN [a] WHEN b >= a AND b - a <= 100 THEN range(a, b + 1) ELSE []::bigint[] END) AS v FROM p), y AS (SELECT ref_key, unnest(CASE WHEN b IS NULL THEN [a] WHEN b >= a AND b - a <= 32 THEN range(a, b + 1) WHEN b >= a THEN [a] ELSE []::bigint[] END) AS v FROM p), gx AS (SELECT ref_key, count(*) AS n, sum(v)::bigint AS total FROM x GROUP BY ref_key), gy AS (SELECT ref_key, count(DISTINCT v) AS pins FROM y GROUP BY ref_key) SELECT r.ref_key, coalesce(gx.n, 0) AS n, coalesce(gx.total, 0) AS total, coalesce(gy.pins, 0) AS pins, try_cast(nullif(regexp_extract(label, '(\d+)', 1), '') AS bigint) AS first FROM external_references r LEFT JOIN gx ON gx.ref_key = r.ref_key LEFT JOIN gy ON gy.ref_key = r.ref_key WHERE label IS NOT NULL",
    "scl_corpus_season": f"WITH {N} SELECT id, concat_ws(' | ', nullif(part, ''), nullif(title, ''), nullif(preview, '')) AS corpus, {_SEASON.format('id')} AS season FROM n",
    "scl_dates": "SELECT row_id, strftime(updated_at, '%Y-%m-%d') AS day, year(updated_at) AS year, strftime(updated_at, '%m-%d') AS month_day, datediff('day', updated_at::date, DATE '2026-01-01') AS age FROM catechism_nodes WHERE updated_at IS NOT NULL",
    "ext_lines": f"WITH {N}, l AS (SELECT id, string_split(text, chr(10)) AS ls FROM n WHERE text IS NOT NULL), p AS (SELECT id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l), s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(?:St\\.|Is it|How well)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS segment FROM p) SELECT id, segment::bigint AS segment, min(pos) AS first_pos, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS body FROM s WHERE segment > 0 GROUP BY id, segment",
    "ext_note_segments": f"WITH {SEGMENTS} SELECT note_key, pos, segment, compare FROM k",
    "ext_inline_notes": "WITH m AS (SELECT doc_id, regexp_extract_all(text, '\\(([^()]{{1,260}})\\)', 1) AS ms FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(ms))) AS pos, unnest(ms) AS raw FROM m), c AS (SELECT doc_id, pos, {0} AS note FROM u), s AS (SELECT *, regexp_split_to_array(regexp_replace(note, '(?i)\\b(cf\\.?)(\\s|$)', chr(1) || '\\1\\2', 'g'), '[;' || chr(1) || ']') AS ps FROM c WHERE regexp_matches(note, '\\d')), k AS (SELECT * FROM s WHERE len(list_filter(ps, lambda p: regexp_matches({1}, '(?i)[a-z]') AND NOT regexp_matches({1}, '(?i)^[,.;:\\s]*cf\\.?[,.;:\\s]*$'))) > 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, note FROM k".format(CLEAN.format("raw"), LABEL.format("p")),
    "ext_raw_links": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(content, 'href=\"([^\"#]+)\"', 1)) AS href FROM source_pages WHERE content IS NOT NULL) GROUP BY page_id, href",
    "src_date_spine": f"SELECT strftime(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)), '%Y-%m-%d') AS day",
    "src_variants": "SELECT regexp_replace(url, '/(?:en|fr|de|es|it|la|zh|ar)/', '/*/', 'g') AS stem, lang, arg_max(url, page_id) AS url FROM source_pages WHERE url IS NOT NULL AND lang IS NOT NULL GROUP BY ALL",
    "src_totals": f"WITH {N} SELECT id, id::bigint AS total FROM n",
    "src_charset": "SELECT page_id, CASE WHEN regexp_full_match(content, '(?s)[\\x{00}-\\x{FF}]*') THEN true END AS latin_read, CASE WHEN regexp_matches(content, '(?i)charset\\s*=\\s*[\"'']?utf-?8[^\\w-]') OR regexp_matches(content, '(?i)charset\\s*=\\s*[\"'']?utf-?8$') THEN length(content) ELSE strlen(content) END AS utf_length FROM source_pages WHERE content IS NOT NULL",
    "snk_document": "SELECT id, title FROM external_sources",
    "str_debounce": "WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT user_id, count(*) AS n FROM e WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 60000000 GROUP BY user_id",
    "str_recent": "WITH a AS (SELECT user_id, event_type, max(row(ts, event_id)) AS seen FROM events WHERE event_type IS NOT NULL GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, event_type) AS k FROM a) SELECT user_id, count(*) OVER (PARTITION BY user_id) - k + 1 AS ord, event_type FROM b WHERE k <= 3",
    "scl_url_language": "WITH p AS (SELECT *, regexp_extract(url, '/([a-z]{2})/', 1) AS path_lang FROM source_pages WHERE url IS NOT NULL) SELECT page_id, path_lang, CASE WHEN path_lang IN ('en', 'fr', 'de', 'es', 'it', 'la', 'zh', 'ar') THEN path_lang WHEN lang IN ('en', 'fr', 'de', 'es', 'it', 'la', 'zh', 'ar') THEN lang ELSE 'en' END AS shown, url || '?' || concat_ws('&', 'lang=' || lang, 'id=' || page_id) AS link FROM p",
    "ext_paragraph_start": r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(ls) AS line0, unnest(range(len(ls))) AS pos FROM l), t AS (SELECT doc_id, pos, regexp_replace(line0, '[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g') AS line FROM p), m AS (SELECT *, regexp_matches(line, '^(?:[-–]\s*)?(\d{1,4})[.)]\s*(.*)$') AS marked FROM t), s AS (SELECT doc_id, pos, marked, try_cast(nullif(CASE WHEN marked THEN regexp_extract(line, '^(?:[-–]\s*)?(\d{1,4})[.)]\s*(.*)$', 1) ELSE regexp_extract(line, '^(?:[-–]\s*)?(\d{1,4})\s+(.+)$', 1) END, '') AS bigint) AS number, CASE WHEN marked THEN regexp_extract(line, '^(?:[-–]\s*)?(\d{1,4})[.)]\s*(.*)$', 2) ELSE regexp_extract(line, '^(?:[-–]\s*)?(\d{1,4})\s+(.+)$', 2) END AS r FROM m) SELECT doc_id, pos, number, "
    + _CLEAN.format("r")
    + " AS rest FROM s WHERE number BETWEEN 1 AND 2865 AND (marked OR NOT regexp_matches(r, '^[:：]'))",
    "sch_theme_pick": f"WITH {N}, d AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY))::date AS dt), e AS (SELECT strftime(dt, '%Y-%m-%d') AS day, datediff('day', DATE '{START}', dt) AS idx FROM d), f AS (SELECT day, idx, {_SEASON.format('idx')} AS season, title, preview, headings[len(headings)].kind AS kind FROM e LEFT JOIN n ON n.id = idx + 1), c AS (SELECT *, concat_ws(' | ', nullif(season, ''), nullif(coalesce(title, 'Ferial Day'), ''), coalesce(kind, 'FERIA'), nullif(preview, '')) AS corpus FROM f), p AS (SELECT *, {', '.join(_score(p) + ' AS s_' + p[0] for p in PROFILES)} FROM c), b AS (SELECT *, greatest({', '.join('s_' + p[0] for p in PROFILES)}) AS top FROM p), k AS (SELECT *, CASE WHEN top = 0 THEN NULL {' '.join(f"WHEN s_{p[0]} = top THEN '{p[0]}'" for p in PROFILES)} END AS k FROM b) SELECT day, coalesce(k, trim(regexp_replace(lower(season), '[^a-z0-9]+', '-', 'g'), '-')) AS theme, round(top, 2) AS score, CASE k {' '.join(f"WHEN '{p[0]}' THEN ({list(p[5])})[('0x' || substr(sha1(day || ':' || k), 1, 8))::bigint % {len(p[5])} + 1]" for p in PROFILES)} ELSE CASE season {' '.join(f"WHEN '{s}' THEN ({list(v)})[(('0x' || substr(sha1(day || ':' || season || ':' || idx), 1, 8))::bigint + idx) % {len(v)} + 1]" for s, v in SEASONAL.items())} ELSE ({list(SEASONAL['Ordinary Time'])})[(('0x' || substr(sha1(day || ':' || season || ':' || idx), 1, 8))::bigint + idx) % 8 + 1] END END::bigint AS paragraph FROM k",
    "sch_calendar": "WITH e AS (SELECT strftime(updated_at, '%Y-%m-%d') AS day, row_id, title, CASE WHEN len(list_filter(headings, lambda h: h.kind = 'major')) > 0 THEN 'SOLEMNITY' ELSE 'FEAST' END AS type, vatican_source IS NULL AS first FROM catechism_nodes WHERE updated_at IS NOT NULL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN first THEN 0 WHEN type = 'SOLEMNITY' THEN 1 ELSE 2 END, row_id) AS k FROM e) WHERE k = 1), r AS (SELECT strftime(updated_at, '%Y-%m-%d') AS day, arg_min(lang, row_id) AS reading FROM localized_nodes WHERE updated_at IS NOT NULL GROUP BY 1) SELECT coalesce(b.day, r.day) AS day, coalesce(title, 'Ferial Day') AS name, coalesce(type, 'FERIA') AS type, reading FROM b FULL JOIN r ON r.day = b.day",
    "agg_profile_hits": f"WITH {N} SELECT " + ", ".join(f"sum(CASE WHEN regexp_matches(coalesce(text, ''), '(?i){'|'.join(p[2])}') THEN {p[1]} ELSE 0.0 END)::double AS {p[0]}" for p in PROFILES) + " FROM n",
}
