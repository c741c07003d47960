"""Operators against brute force, and on nulls, ties, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import graph as G
from corpusmill.operators import html as H
from corpusmill.operators import joins as J
from corpusmill.operators import ordered as O
from corpusmill.operators import citations as C
from corpusmill.operators import hierarchy as HI
from corpusmill.operators import segment as S
from corpusmill.operators.dedupe import keep_first, keep_last
from tests.conftest import rows


def brute_rank(ids, edges, rounds=45, d=0.85):
    n = len(ids)
    out = {i: [] for i in ids}
    for s, t in edges:
        if s in out and t in out:
            out[s].append(t)
    r = {i: 1 / n for i in ids}
    for _ in range(rounds):
        nxt = {i: (1 - d) / n for i in ids}
        for i in ids:
            for t in out[i] or ids:
                nxt[t] += d * r[i] / (len(out[i]) or n)
        r = nxt
    return r


def test_pagerank(spark):
    rng = random.Random(3)
    ids = list(range(1, 31))
    edges = [(rng.randint(1, 34), rng.randint(1, 34)) for _ in range(80)] + [(5, 5), (1, 2), (1, 2)]
    edges = [e for e in edges if e[0] % 7]  # some nodes without edges
    got = {r["id"]: r["rank"] for r in G.pagerank(spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame(edges, "source int, target int")).collect()}
    want = brute_rank(ids, edges)
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-12 for i in ids)


def test_pagerank_empty(spark):
    n, e = spark.createDataFrame([], "id int"), spark.createDataFrame([], "source int, target int")
    assert G.pagerank(n, e, rounds=2).count() == 0
    one = G.pagerank(spark.createDataFrame([(1,), (None,)], "id int"), e, rounds=2).collect()
    assert [(r["id"], round(r["rank"], 12)) for r in one] == [(1, 1.0)]


def test_bfs_and_crawl(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (9, 9), (3, 3)], "source int, target int")
    root = spark.createDataFrame([(1,)], "id int")
    assert rows(G.bfs(e, root, 2)) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert rows(G.reachable(e, root, 10)) == [(1,), (2,), (3,), (4,)]
    with pytest.raises(ValueError):
        G.reachable(e, root, 2)


def test_crawl_does_not_stop_short(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 7)], "source int, target int")
    root = spark.createDataFrame([(1,)], "id int")
    assert G.reachable(chain, root, 10, most_rounds=6).count() == 7
    with pytest.raises(ValueError):
        G.reachable(chain, root, 10, most_rounds=3)


def test_layout_is_deterministic(spark):
    n = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(1, 8)], "id int, group string")
    e = spark.createDataFrame([(1, 2), (2, 3), (6, 7)], "source int, target int")
    a, b = rows(G.layout(n, e, ticks=2)), rows(G.layout(n, e, ticks=2))
    assert a == b and len(a) == 7


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 1, "a"), (None, 2, None), (2, 5, "x")], "k int, o int, v string")
    assert rows(keep_first(df, ["k"], ["o"])) == [(1, 1, "a"), (2, 5, "x"), (None, 2, None)]
    assert rows(keep_last(df, ["k"], ["o"])) == [(1, 3, "c"), (2, 5, "x"), (None, 2, None)]
    assert keep_first(df.limit(0), ["k"], ["o"]).count() == 0


def test_global_order(spark):
    rng = random.Random(1)
    vals = rng.sample(range(1000), 60)
    df = spark.createDataFrame([(v, "m" if v % 9 == 0 else None) for v in vals], "id int, m string")
    order = sorted(vals)
    got = {r["id"]: r for r in O.prev_next(df, "id", 5).collect()}
    for k, v in enumerate(order):
        assert got[v]["prev_id"] == (order[k - 1] if k else None) and got[v]["next_id"] == (order[k + 1] if k + 1 < len(order) else None)
    assert {r["id"]: r["position"] for r in O.with_position(df, ["id"], parts=5).collect()} == {v: k for k, v in enumerate(order)}
    tagged = df.withColumn("tag", F.when(F.col("id") % 9 == 0, F.col("id")))
    last, want = None, {}
    for v in order:
        last = v if v % 9 == 0 else last
        want[v] = last
    assert {r["id"]: r["c"] for r in O.carry_forward(tagged, ["id"], F.col("tag"), "c", 5).collect()} == want


def test_fill_levels_against_fold(spark):
    rng = random.Random(5)
    levels = ["a", "b", "c"]
    data = []
    for i in range(400):
        pick = lambda p: rng.choice(["x1:t", "x1:u", "x2:t", "x3:t"]) if rng.random() < p else None
        data.append((1, i, pick(0.15), pick(0.25), pick(0.3), pick(0.1), pick(0.1), pick(0.1)))
    df = spark.createDataFrame(data, "g int, id int, a string, b string, c string, src_a string, src_b string, src_c string")
    ident = lambda s: s.split(":")[0] if s else None
    ctx, want = dict.fromkeys(levels), {}
    for r in data:
        exp, src = dict(zip(levels, r[2:5])), dict(zip(levels, r[5:8]))
        for k, lv in enumerate(levels):
            v = exp[lv]
            value = ctx[lv] if v and ctx[lv] and ident(v) == ident(ctx[lv]) else v if v is not None else (None if ctx[lv] else src[lv])
            if not value:
                continue
            if ctx[lv] != value:
                for low in levels[k + 1 :]:
                    ctx[low] = None
            ctx[lv] = value
        want[r[1]] = tuple(ctx[lv] for lv in levels)
    out = O.fill_levels(df, ["g"], "id", levels, lambda c: F.substring_index(c, ":", 1))
    got = {r["id"]: (r["full_a"], r["full_b"], r["full_c"]) for r in out.collect()}
    assert got == want


def fold_levels(data, levels, ident):
    """data: (id, explicit values, source values) in order; the filled levels of each id."""
    ctx, out = dict.fromkeys(levels), {}
    for key, explicit, source in data:
        for k, lv in enumerate(levels):
            v = explicit[k]
            value = ctx[lv] if v and ctx[lv] and ident(v) == ident(ctx[lv]) else v if v is not None else (None if ctx[lv] else source[k])
            if not value:
                continue
            if ctx[lv] != value:
                for low in levels[k + 1 :]:
                    ctx[low] = None
            ctx[lv] = value
        out[key] = tuple(ctx[lv] for lv in levels)
    return out


def test_fill_levels_over_the_whole_order(spark):
    rng = random.Random(8)
    levels, pick = ["a", "b", "c"], lambda p: rng.choice(["x1:t", "x1:u", "x2:t", "x3:t"]) if rng.random() < p else None
    data = [(i, [pick(0.02), pick(0.06), pick(0.2)], [pick(0.1) for _ in levels]) for i in range(400)]
    df = spark.createDataFrame([(i, *e, *s) for i, e, s in data], "id int, a string, b string, c string, src_a string, src_b string, src_c string").repartition(3)
    want = fold_levels(data, levels, lambda s: s.split(":")[0])
    for parts in (1, 7):
        out = O.fill_levels_ordered(df, "id", levels, lambda c: F.substring_index(c, ":", 1), parts)
        assert {r["id"]: (r["full_a"], r["full_b"], r["full_c"]) for r in out.collect()} == want
    assert O.fill_levels_ordered(df.limit(0), "id", levels, lambda c: c).count() == 0


def test_hierarchy_is_carried_past_each_hundredth_id(spark, tmp_path):
    from corpusmill.plans.relational import win_hierarchy

    crumbs = {1: ["PART ONE: A", "s1"], 150: [None, "s2"], 297: ["PART TWO: B"], 303: ["PART TWO: B", "s3"], 450: ["PART THREE: C", "s3"]}
    data = [(i, crumbs.get(i) or [], "t" if i in (1, 298, 300, 301) else None) for i in range(1, 501)]
    spark.createDataFrame([(i, i, c, [], t) for i, c, t in data], "row_id long, id int, breadcrumbs array<string>, headings array<struct<kind:string,text:string>>, title string").write.parquet(f"{tmp_path}/catechism_nodes.parquet")
    want = fold_levels([(i, [*c, None, None][:2], [None, t]) for i, c, t in data], ["part", "section"], lambda s: s.split(":")[0])
    as_written = {"PART ONE: A": "Part 1: A", "PART TWO: B": "Part 2: B", "PART THREE: C": "Part 3: C"}
    want = {k: (as_written.get(v[0], v[0]), v[1]) for k, v in want.items()}
    assert want[300] == ("Part 2: B", "t") and want[200] == ("Part 1: A", "s2")
    assert {r["id"]: (r["full_part"], r["full_section"]) for r in win_hierarchy(spark, str(tmp_path)).collect()} == want


def test_joins(spark):
    base = spark.createDataFrame([(1, "a", None), (2, None, "z")], "id int, t string, u string")
    over = spark.createDataFrame([(1, None, "n"), (2, "b", None)], "id int, t string, u string")
    assert rows(J.overlay(base, over, "id", ["t", "u"])) == [(1, "a", "n"), (2, "b", "z")]
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 100.0, 0.0)], "id int, pos_x double, pos_y double")
    assert rows(J.nearest(pts, pts, 6.0)) == [(1, 2, 5.0), (2, 1, 5.0)]
    r = spark.createDataFrame([(1, 0, 10, "x"), (2, 5, 20, "y")], "ord int, lo int, hi int, band string")
    v = spark.createDataFrame([(3,), (7,), (15,), (99,), (None,)], "v int")
    assert rows(J.range_first(v, "v", r, "lo", "hi", "ord", "band", ["v"])) == [(15, "y"), (3, "x"), (7, "x"), (99, None), (None, None)]


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize("label,want", [("12-15, 3", [12, 13, 14, 15, 3]), ("5-3", []), ("1-200", []), ("(all)", []), ("", []), (None, [])])
def test_expand_numbers(spark, label, want):
    assert one(spark, T.expand_numbers(F.col("v")), label) == want


def test_scalars(spark):
    assert one(spark, T.clean_text(F.col("v")), "  a ­b &amp;\n c​ ") == "a b & c"
    assert one(spark, T.preview(F.col("v"), 10), "abcdefg hijklmn") == "abcdefg..."
    assert one(spark, T.slug(F.col("v")), "--The Lamp, and Oil!") == "the-lamp-and-oil"
    assert one(spark, T.title_case(F.col("v")), "the lamp of the house: the xiv psalm") == "The Lamp of the House: The Xiv Psalm"
    assert one(spark, T.title_case(F.col("v")), "songs of li bai") == "Songs of Li Bai"
    assert one(spark, T.title_case(F.col("v")), "WHAT TO REST ON (and) book ix. of it, but not") == "What to Rest on (and) Book IX. Of It, But Not"
    assert one(spark, T.title_case(F.col("v")), "what to rest on") == "What to Rest On"
    assert one(spark, T.roman_to_int(F.col("v")), "mcmxciv") == 1994
    assert one(spark, T.roman_to_int(F.col("v")), "12") == 12
    assert one(spark, T.roman_to_int(F.col("v")), "ABC") is None
    assert one(spark, T.int_to_roman(F.col("v")), 1994, "int") == "MCMXCIV"
    assert one(spark, T.decode_page(F.col("v")), "x charset=utf-8 é".encode(), "binary").endswith("é")
    assert one(spark, T.decode_page(F.col("v")), "caf\xe9".encode("latin-1"), "binary") == "café"


def test_segments(spark):
    df = spark.createDataFrame([(1, "pre\n# a\nb\n# c"), (2, None), (3, "none")], "id int, t string")
    assert rows(S.marker_segments(S.lines(df, "id", "t"), ["id"], "pos", "line", "^#").select("id", "segment", "body")) == [(1, 1, "# a\nb"), (1, 2, "# c")]
    s = S.paragraph_start(F.col("v"))
    assert one(spark, s, "12. The lamp") == (12, "The lamp")
    assert one(spark, s, "– 7 oil") == (7, "oil")
    assert one(spark, s, "7 : oil") is None and one(spark, s, "9999 x") is None and one(spark, s, None) is None
    notes = spark.createDataFrame([(1, "Book of A 1; cf. Synod B 2; 3"), (2, None), (3, "")], "id int, t string")
    seg = S.note_segments(notes, "id", "t")
    assert rows(seg.select("segment", "compare")) == [("3", True), ("Book of A 1", False), ("cf. Synod B 2", True)]
    cut = spark.createDataFrame([(1, "see A 1 cf B 2; C 3")], "id int, t string")
    assert rows(S.note_segments(cut, "id", "t").select("pos", "segment", "compare")) == [(0, "see A 1", False), (1, "cf B 2", True), (2, "C 3", True)]
    verse = F.col("label").rlike("^Book")
    assert rows(S.references(seg, "id", verse).select("ref_id", "label")) == [("1:document:1", "Synod B 2; 3"), ("1:scripture:1", "Book of A 1")]
    more = spark.createDataFrame([(1, "12; cf.; preface; A work; 7; B work; can. 4, 5; 9!")], "id int, t string")
    assert rows(S.references(S.note_segments(more, "id", "t"), "id", F.lit(False)).select("ref_id", "label")) == [("1:document:1", "preface"), ("1:document:2", "A work; 7"), ("1:document:3", "B work; can. 4, 5; 9!")]
    inline = spark.createDataFrame([(1, "x (Book 3) y (12) z (cf. 4) (no digit) (A 2; B 3)"), (2, None)], "id int, t string")
    assert rows(S.inline_notes(inline, "id", "t")) == [(1, 1, "Book 3"), (1, 2, "A 2; B 3")]
    secs = spark.createDataFrame([(1, k, t) for k, t in enumerate(["1. a", "more", "2. b", "1. c", "3. d"])], "id int, pos int, t string")
    assert rows(S.numbered_sections(secs, ["id"], "pos", "t")) == [(1, 1, "a\nmore"), (1, 2, "b")]


def test_html():
    page = '<h2>T</h2><p><a name="1"></a>1 x <a href="a.htm#f">y</a><p>z<ul><li><a href="b.htm">B</a> <a href="1.htm">1</a></ul>'
    assert [(a, t, h) for a, t, h, _ in H.paragraphs(page)] == [("1", "1 x y", ["T"]), (None, "z", [])]
    assert H.links(page, "http://h.example/d/") == ["http://h.example/d/a.htm", "http://h.example/d/b.htm", "http://h.example/d/1.htm"]
    assert H.index_entries(page, "http://h.example/")[0][1:] == ("http://h.example/b.htm", ["http://h.example/1.htm"])
    assert H.first_table_after("<a name=x></a><table><tr><td><table></table></td></tr></table><table>", "x").count("table") == 4
    assert H.bilingual_rows("<table><tr><td>a<td>b<tr><td>c</table>") == [("a", "b"), ("c", "c")]
    assert H.split_canons("<b>Can. 1</b> one <b>Can. 2</b> two [Earlier version] old") == [(1, "one"), (2, "two")]
    assert H.paragraphs(None) == [] and H.links(None, None) == []


def test_seasons(spark):
    for given, want in (("Holy Week", "Holy Week"), ("", "Ordinary Time"), (None, "Ordinary Time"), ("the silent season", "Lent"), ("Octave of Christmas in Advent", "Christmas"), (" Harvest ", "Harvest"), ("ordinary Lent", "Ordinary Time")):
        assert one(spark, T.season(F.col("v")), given) == want


def test_scripture(spark):
    books = spark.createDataFrame([("gen", "GEN", "Genesis"), ("1 sam", "1SA", "1 Samuel"), ("jude", "JUD", "Jude")], "alias string, book_id string, book string")
    refs = spark.createDataFrame([(1, "Cf. Gen. 1:3-5; 7; 2:4, 6; Foo 3:1; 9"), (2, "1 Sam 3"), (3, "Jude 5"), (4, "Gen 1:30-3:2, 12a"), (5, None), (6, "7:1; nothing"), (7, "Gen 4:9-7")], "id int, label string")
    q = C.scripture_queries(refs, books, "id", "label")
    assert rows(q.where("id = 1").select("pos", "query")) == [(0, "Genesis 1:3-5"), (1, "Genesis 1:7"), (2, "Genesis 2:4, 6"), (4, "Genesis 2:9")]
    got = rows(C.selections(q, ("JUD",)).select("id", "pos", "sel", "chapter", "verses", "lo", "hi"))
    assert [g for g in got if g[0] == 1] == [(1, 0, 0, 1, [3, 4, 5], None, None), (1, 1, 0, 1, [7], None, None), (1, 2, 0, 2, [4], None, None), (1, 2, 1, 2, [6], None, None), (1, 4, 0, 2, [9], None, None)]
    assert [g[3:] for g in got if g[0] in (2, 3)] == [(3, None, None, None), (1, [5], None, None)]
    assert [g[3:] for g in got if g[0] == 4] == [] and [g for g in got if g[0] in (5, 6, 7)] == []
    over = C.selections(C.scripture_queries(spark.createDataFrame([(4, "Gen 1:30-3:2")], "id int, label string").select("id", F.concat(F.lit("Gen 9:1, "), F.expr("substring(label, 5)")).alias("label")), books, "id", "label"))
    assert [g[3:] for g in rows(over.select("id", "pos", "sel", "chapter", "verses", "lo", "hi"))] == [(9, [1], None, None), (1, None, 30, None), (2, None, None, None), (3, None, 1, 2)]
    verses = spark.createDataFrame([(1, k, f"v{k}") for k in range(1, 9)] + [(3, 1, "c")], "chapter int, verse int, text string")
    assert rows(C.rendered(C.selected_verses(C.selections(q.where("id = 1 AND pos < 2")), verses), "id")) == [(1, "Genesis 1: 3. v3 4. v4 5. v5 Genesis 1: 7. v7")]


def test_document_references(spark):
    catalog = spark.createDataFrame([("a", "LG", "Lumen orientis", ["Light of the East"]), ("b", "GS", "Gaudium (et) montes", None), ("c", None, "Lumen", None)], "id string, siglum string, title string, aliases array<string>")
    refs = spark.createDataFrame([(1, "Cf. LG 11 § 2; 13, 15-17"), (2, "see light of the east, 4"), (3, "gaudium (ET) montes: 2-60"), (4, "ALGAE 3"), (5, None), (6, "in lumen 3 and GS 2")], "id int, label string")
    got = C.catalog_match(refs, catalog, "id", "label")
    assert rows(got.select("id", "entry_id", "locator")) == [(1, "a", "11 § 2; 13, 15-17"), (2, "a", "4"), (3, "b", "2-60"), (6, "b", "2")]
    loc = lambda t: one(spark, C.locator(F.col("v")), t)
    assert loc("11 § 2; 13, 15-17, § 4 , §5, § 4") == ([11, 13, 15, 16, 17], [(11, 2), (15, 4), (15, 5)])
    assert loc("10-60 § 3, para. 7") == ([10], [(10, 3), (10, 7)]) and loc("§ 7, x") == ([], []) and loc("") == ([], [])
    assert loc("4 and 5, 4") == ([4], []) or loc("4 and 5, 4")[0] == [4]


def test_works(spark):
    w = lambda t: one(spark, C.work_reference(F.col("v")), t)
    a = "St. Thomas Aquinas, "
    assert w("Cf. " + a + "STh II-II, 2, 3 ad 1") == ("aquinas-sth", "document:aquinas-sth:ii-ii-2-3-ad-1", "reply:1")
    assert w(a + "STh I, 8, 1, corp. art.") == ("aquinas-sth", "document:aquinas-sth:i-8-1-corp-art", "corpus")
    assert w(a + "STh I 5, 4")[1:] == ("document:aquinas-sth:i-5-4-full", None) and w(a + "STh IX 5, 4") is None
    assert w(a + "SCG III, 71.")[1] == "document:aquinas-scg:3-71" and w(a + "Symb., 1.")[1] == "document:aquinas-creed:1"
    assert w("Somebody, STh I 1, 2") is None and w(None) is None


def test_levels(spark):
    assert one(spark, HI.normal_segment(F.col("v")), "CHAPTER two:  the LAMP of oil") == "Chapter 2: The Lamp of Oil"
    assert one(spark, HI.normal_segment(F.col("v")), "Article iv of x") == "Article IV: Of X" and one(spark, HI.normal_segment(F.col("v")), "The lamp") is None
    line = lambda lang, t: one(spark, HI.parse_line(F.col("v"), F.lit(lang)), t)
    assert line("fr", "Première partie « La lampe »") == ("part", "« La lampe »") or line("fr", "Première partie «La lampe»")[1] == "«La lampe»"
    assert line("de", "ARTIKEL 3") == ("article", "") and line("zh", "第二章") == ("chapter", "") and line("zh", "第二章 x") is None and line("fr", None) is None


def test_two_level_document(spark):
    ls = ["preface", "CAPUT I", "a", "", "CANONES", "1. stray", "II. - Group", "1. one", "goes", "2. two", "1. again", "-" * 9, "3. late"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(ls)], "id int, pos int, t string")
    assert rows(HI.chapters_and_canons(df, ["id"], "pos", "t")) == [(1, "canon:2:1", "1. again"), (1, "canon:2:2", "2. two"), (1, "chapter:1", "a")]
