"""Lines into segments, notes into reference segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import clean_text, document_label, expand_numbers, strip_bidi

#: Bounds of paragraph numbers; how a paragraph begins, with a mark after its number and without; a note in parentheses.
FIRST_ID, LAST_ID = 1, 2865
DELIMITED = r"^(?:[-–]\s*)?(\d{1,4})[.)]\s*(.*)$"
SPACED = r"^(?:[-–]\s*)?(\d{1,4})\s+(.+)$"
NOTE = r"\(([^()]{1,260})\)"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line) of each line; null texts have none."""
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))


def marker_segments(df: DataFrame, keys: list[str], order: str, text: str, marker: str) -> DataFrame:
    """Segments of lines: one that matches the marker opens a segment, the others join the open one, lines before the first are dropped.

    (keys, segment, first_pos, n_lines, body): a running count of markers and an ordered aggregation per document.
    """
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    seg = df.withColumn("segment", F.sum(F.when(F.col(text).rlike(marker), 1).otherwise(0)).over(w)).where("segment > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return seg.groupBy(*keys, "segment").agg(F.min(order).alias("first_pos"), F.count("*").alias("n_lines"), body.alias("body"))


def paragraph_start(c: Column, lo: int = FIRST_ID, hi: int = LAST_ID, noise: bool = False) -> Column:
    """struct<id, rest> of a line that begins a numbered paragraph, null otherwise.

    An optional dash, 1 to 4 digits in the bounds, then a period or parenthesis, or blanks before the rest; a rest that
    begins with a colon needs the delimiter. With noise up to six characters may stand before the number.
    """
    t = strip_bidi(c)
    if noise:
        t = F.regexp_replace(t, r"^[^\d\-–]{0,6}(?=[\-–]?\d{1,4})", "")
    delimited, spaced = DELIMITED, SPACED
    with_mark = t.rlike(delimited)
    n = F.when(with_mark, F.regexp_extract(t, delimited, 1)).otherwise(F.regexp_extract(t, spaced, 1)).try_cast("int")
    rest = clean_text(F.when(with_mark, F.regexp_extract(t, delimited, 2)).otherwise(F.regexp_extract(t, spaced, 2)))
    return F.when(n.between(lo, hi) & (with_mark | ~rest.rlike("^[:：]")), F.struct(n.alias("id"), rest.alias("rest")))


def numbered_sections(df: DataFrame, keys: list[str], order: str, text: str, last_wins: bool = False, stop: str = r"^\s*NOTES\s*$") -> DataFrame:
    """Numbered paragraphs of a document's lines, up to a stop line or the first number that decreases; one row per number."""
    start = df.withColumn("__s", paragraph_start(F.col(text)))
    w = W.partitionBy(*keys).orderBy(order)
    top = F.max(F.col("__s.id")).over(w.rowsBetween(W.unboundedPreceding, -1))
    start = start.withColumn("__stop", F.col(text).rlike(stop) | (F.col("__s.id") < F.coalesce(top, F.lit(0))))
    ended = F.max(F.col("__stop").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    live = start.withColumn("__ended", F.coalesce(ended, F.lit(0))).where("__ended = 0")
    seg = live.withColumn("__n", F.sum(F.when(F.col("__s").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("__n > 0")
    line = F.coalesce(F.col("__s.rest"), F.col(text))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n")
    got = seg.groupBy(*keys, "__n").agg(F.max("__s.id").alias("number"), body.alias("body"))
    pick = F.max_by if last_wins else F.min_by
    return got.groupBy(*keys, "number").agg(pick("body", "__n").alias("body"))


#: What cuts a note before a comparison, a label that is a comparison only, a segment that continues the document before it.
COMPARE = r"(?i)\bcf\.?(?=\s|$)"
COMPARE_ONLY = r"(?i)^[,.;:\s]*cf\.?[,.;:\s]*$"
CONTINUES = r"(?i)^(?:\d+(?::\d+)?(?:\s*[-,]\s*\d+(?::\d+)?)?|§+\s*\d+|can(?:n)?\.?\s*\d+|cann?\.\s*\d+|preface\b|introduction\b|praenotanda\b)"


def page_paragraphs(df: DataFrame, keys: list[str], order: str, text: str, tag: str, file: str) -> DataFrame:
    """(keys, number, body): numbered paragraphs of a page's blocks, the first of a number counts, empty ones left out.

    The range in the file's name (nn12-40) bounds the numbers, if there is one. A rule or note block (hr, div) after the first
    paragraph, or a number below the one before it, ends the page.
    """
    lo = F.coalesce(F.regexp_extract(file, r"(?i)(?:nn)?(\d{1,4})-(\d{1,4})", 1).try_cast("int"), F.lit(FIRST_ID))
    hi = F.coalesce(F.regexp_extract(file, r"(?i)(?:nn)?(\d{1,4})-(\d{1,4})", 2).try_cast("int"), F.lit(LAST_ID))
    block = F.col(tag).isin("hr", "div")
    d = df.withColumn("__t", clean_text(F.col(text))).where((F.col("__t") != "") | block)
    start = F.when(~block, paragraph_start(F.col("__t")))
    d = d.withColumn("__s", start).withColumn("__s", F.when(F.col("__s.id").between(lo, hi), F.col("__s")))
    w = W.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    last = F.last("__s.id", ignorenulls=True).over(before)
    d = d.withColumn("__stop", (block & last.isNotNull()) | (F.col("__s.id") < last))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__end", F.max(F.coalesce("__stop", F.lit(False))).over(upto)).where("NOT __end")
    d = d.where(~block).withColumn("__n", F.sum(F.col("__s").isNotNull().cast("int")).over(upto)).where("__n > 0")
    line = F.when(F.col("__s").isNotNull(), F.col("__s.rest")).otherwise(F.col("__t"))
    body = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"])
    got = d.groupBy(*keys, "__n").agg(F.max("__s.id").alias("number"), F.trim(F.array_join(body, " ")).alias("body")).where("body <> ''")
    return got.groupBy(*keys, "number").agg(F.min_by("body", "__n").alias("body"))


def note_segments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, segment, compare) of each note: cut at semicolons and before each 'cf' or 'cf.'.

    compare holds from the first 'cf' on to the note's end; the segment keeps its 'cf'. Null and blank notes have none.
    """
    cut = F.split(F.regexp_replace(F.col(text_col), COMPARE, "\u0001$0"), "[;\u0001]")
    parts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.transform(cut, clean_text)).alias("pos", "segment")).where("segment <> ''")
    w = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    compare = F.max(F.col("segment").rlike(r"(?i)^cf\.?(?:\s|$)").cast("int")).over(w) == 1
    return parts.select(id_col, "pos", "segment", compare.alias("compare"))


def references(segments: DataFrame, id_col: str, scripture: Column, scripture_labels=None) -> DataFrame:
    """References of note segments: classified by the column scripture, a document segment that only continues is joined to the one before.

    (id, ref_id, kind, label, compare). ref_id is note:kind:n, n counted within note and kind. A segment without a letter
    and one that is a comparison only give none. scripture_labels(label): array of the labels of a scripture segment,
    by default the label itself.
    """
    s = segments.withColumn("label", document_label(F.col("segment"))).where((F.col("label") != "") & ~F.col("label").rlike(COMPARE_ONLY))
    s = s.withColumn("kind", F.when(scripture, "scripture").otherwise("document"))
    w = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    docs = s.where("kind = 'document'")
    letter = F.col("label").rlike("(?i)[a-z]")
    opens = letter & ~F.col("label").rlike(CONTINUES)
    # a continuation before any document opens one itself if it holds a letter
    docs = docs.withColumn("__open", opens).withColumn("__some", F.max(letter.cast("int")).over(w))
    first = F.min(F.when(letter, F.col("pos"))).over(W.partitionBy(id_col))
    docs = docs.withColumn("__open", F.col("__open") | (F.col("pos") == first))
    docs = docs.withColumn("head", F.sum(F.col("__open").cast("int")).over(w)).where("head > 0")
    docs = docs.where(F.col("__open") | F.col("label").rlike(CONTINUES))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), "; ")
    docs = docs.groupBy(id_col, "head").agg(F.min("pos").alias("pos"), text.alias("label"), F.max("compare").alias("compare")).select(id_col, "pos", F.lit("document").alias("kind"), "label", "compare")
    many = scripture_labels(F.col("label")) if scripture_labels else F.array("label")
    verses = s.where("kind = 'scripture'").select(id_col, "pos", "kind", F.explode(many).alias("label"), "compare")
    both = docs.unionByName(verses)
    n = F.row_number().over(W.partitionBy(id_col, "kind").orderBy("pos"))
    return both.withColumn("n", n).select(id_col, F.concat_ws(":", F.col(id_col).cast("string"), "kind", F.col("n").cast("string")).alias("ref_id"), "kind", "label", "compare")


def inline_notes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, note): parenthetical notes of up to 260 characters that hold a digit and yield a reference, numbered in order of those kept.

    A note yields a reference if one of its segments holds a letter and is more than a comparison.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(NOTE), F.lit(1))
    parts = lambda x: F.split(F.regexp_replace(x, COMPARE, "\u0001$0"), "[;\u0001]")
    yields = lambda x: F.exists(parts(x), lambda p: document_label(p).rlike("(?i)[a-z]") & ~document_label(p).rlike(COMPARE_ONLY))
    kept = F.filter(F.transform(found, clean_text), lambda x: x.rlike(r"\d") & yields(x))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(kept).alias("n", "note")).select(id_col, (F.col("n") + 1).alias("n"), "note")


def pinpoints(c: Column) -> Column:
    """Locator numbers of a label; a range wider than 32 gives its start; each number once."""
    return F.array_distinct(expand_numbers(c, 32, collapse_wide=True))


def verses_apart(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, verse, text): a paragraph that is a number takes the next one that holds text as its verse; of numbers in a row the last counts."""
    t = clean_text(F.col(text))
    w = W.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, order, t.alias("__t")).where("__t <> ''").withColumn("__n", F.when(F.col("__t").rlike(r"^\d+$"), F.col("__t").try_cast("int")))
    d = d.withColumn("verse", F.lag("__n").over(w)).where("__n IS NULL AND verse IS NOT NULL")
    return d.select(*keys, "verse", F.regexp_replace("__t", r"^\d+\s+", "").alias("text"))


def verses_inline(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, verse, text) of the paragraphs 'n text'."""
    t, p = clean_text(F.col(text)), r"^(\d+)\s+(.+)$"
    return df.where(t.rlike(p)).select(*keys, F.regexp_extract(t, p, 1).try_cast("int").alias("verse"), F.regexp_extract(t, p, 2).alias("text"))


def verses_marked(df: DataFrame, keys: list[str], order: str, text: str, marker: str = r"^(\d+)\s+(.+)$") -> DataFrame:
    """(keys, verse, text): a line that fits the marker (number, rest) opens a verse, the others continue it; empty verses are left out."""
    t = clean_text(F.col(text))
    d = df.select(*keys, order, t.alias("__t")).where("__t <> ''")
    opens = F.col("__t").rlike(marker)
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__seg", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where("__seg > 0")
    d = d.withColumn("__n", F.when(opens, F.regexp_extract("__t", marker, 1).try_cast("int"))).withColumn("__b", F.when(opens, F.regexp_extract("__t", marker, 2)).otherwise(F.col("__t")))
    body = F.transform(F.filter(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__b").alias("t")))), lambda x: x["t"] != ""), lambda x: x["t"])
    got = d.groupBy(*keys, "__seg").agg(F.max("__n").alias("verse"), clean_text(F.array_join(body, " ")).alias("text"))
    return got.where("text <> ''").select(*keys, "verse", "text")


def verses_anchored(df: DataFrame, keys: list[str], order: str, text: str, anchor: str) -> DataFrame:
    """(keys, chapter, verse, text): a paragraph with a numeric anchor opens a chapter; within it as verses_marked."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("chapter", F.last(anchor, ignorenulls=True).over(w)).where("chapter IS NOT NULL")
    return verses_marked(d, [*keys, "chapter"], order, text)


def verses_by_place(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, chapter, verse, text): a line 'c:v text' opens a verse, the others continue it; empty verses are left out."""
    p = r"^(\d+):(\d+)\s*(.*)$"
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = df.select(*keys, order, clean_text(F.col(text)).alias("__l")).where("__l <> ''")
    d = d.withColumn("chapter", F.last(F.when(F.col("__l").rlike(p), F.regexp_extract("__l", p, 1).try_cast("int")), ignorenulls=True).over(w)).where("chapter IS NOT NULL")
    d = d.withColumn("__l", F.regexp_replace("__l", r"^\d+:(?=\d+)", ""))
    return verses_marked(d, [*keys, "chapter"], order, "__l", r"^(\d+)\s*(.*)$")
