"""The pN_ queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import materialize, spread, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k; the empty list for null and empty texts."""
    from corpusmill.llm.bpe import encode

    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in tokens of byte_bpe_50k, in a container of every capacity."""
    from corpusmill.llm.bpe import token_count
    from corpusmill.llm.packing import pack

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", token_count(F.col("text")).alias("size"))
    return pack(docs, table(spark, sf_dir, "pack_capacities"))


def _node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, row_id, id, lang and text of both node tables; English is the language of catechism_nodes."""
    n = table(spark, sf_dir, "catechism_nodes").select(F.lit("catechism_node").alias("rec_kind"), "row_id", "id", F.lit("en").alias("lang"), "text")
    return spread(n.unionByName(table(spark, sf_dir, "localized_nodes").select(F.lit("localized_node").alias("rec_kind"), "row_id", "id", "lang", "text")))


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of each node text."""
    from corpusmill.llm.lookalike import canonical, spellings

    nodes = _node_texts(spark, sf_dir)
    return nodes.select("rec_kind", "row_id", canonical(F.col("text"), spellings(nodes)).alias("form"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that looks like another of its id (and language) in other characters, with its class and how many it looks like."""
    from corpusmill.llm.lookalike import alike_classes, spellings

    nodes = _node_texts(spark, sf_dir)
    return alike_classes(nodes, spellings(nodes), ["rec_kind", "id", "lang"]).select("rec_kind", "row_id", "class_id", "links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of one id (and language) whose texts look the same but differ in their characters."""
    from corpusmill.llm.lookalike import alike_pairs, spellings

    nodes = _node_texts(spark, sf_dir)
    return alike_pairs(nodes, spellings(nodes), ["rec_kind", "id", "lang"]).select("rec_kind", "row_id_a", "row_id_b")


#: Texts of ASCII only hold no garbled sequence and no unit that the garbled-text model counts: they are passed over JVM-side.
_BEYOND = r"[^\x00-\x7F]"


def _garble_model(spark: SparkSession, sf_dir: str):
    from corpusmill.llm.garble import corpus_counts

    texts = table(spark, sf_dir, "localized_nodes").select("text").unionByName(table(spark, sf_dir, "footnotes").select("text"))
    return corpus_counts(spread(texts.where(F.col("text").rlike(_BEYOND))))


def _beyond_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = table(spark, sf_dir, "localized_nodes").select(F.lit("localized_node").alias("rec_kind"), F.col("row_id").alias("rec_id"), "text")
    both = loc.unionByName(table(spark, sf_dir, "footnotes").select(F.lit("footnote").alias("rec_kind"), F.col("note_key").alias("rec_id"), "text"))
    return spread(both.where(F.col("text").rlike(_BEYOND)))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each garbled record with its restored text and the number of garbled stretches; losses are read under the legible records."""
    from corpusmill.llm.garble import relost, restored
    from corpusmill.llm.lattice import count_grams

    model = _garble_model(spark, sf_dir)
    rows = _beyond_ascii(spark, sf_dir).withColumn("r", restored(F.col("text"), *model))
    rows = materialize(rows.select("rec_kind", "rec_id", "text", F.col("r.text").alias("read"), F.col("r.garbled").alias("garbled"), F.col("r.lost").alias("lost")))
    grams = count_grams(rows.where("garbled = 0"), "text")
    found = rows.where("garbled > 0")
    whole = found.where("NOT lost").select("rec_kind", "rec_id", F.col("read").alias("text"), "garbled")
    lost = spread(found.where("lost"), scan=False)
    return whole.unionByName(lost.select("rec_kind", "rec_id", relost(F.col("text"), *model, grams).alias("text"), "garbled"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind and rec_id of each record with a garbled sequence."""
    from corpusmill.llm.garble import is_garbled

    return _beyond_ascii(spark, sf_dir).where(is_garbled(F.col("text"), *_garble_model(spark, sf_dir))).select("rec_kind", "rec_id")


def _legible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node texts of both tables that are not null and that p1_found does not list."""
    from corpusmill.llm.garble import is_garbled

    nodes = _node_texts(spark, sf_dir).where("text IS NOT NULL")
    asked = (F.col("rec_kind") == "localized_node") & F.col("text").rlike(_BEYOND)
    return nodes.where(~asked).unionByName(nodes.where(asked & ~is_garbled(F.col("text"), *_garble_model(spark, sf_dir))))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each sentence unit of the legible node texts."""
    from corpusmill.llm import sentences

    splitter = sentences.train(_node_texts(spark, sf_dir))
    starts = sentences.unit_starts(F.col("text"), splitter)
    return _legible(spark, sf_dir).select("rec_kind", "row_id", F.explode(starts).alias("sent_start"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sentence units, of the first row of each id and of each id and language, that translate one another."""
    from corpusmill.llm import align, sentences
    from corpusmill.llm.garble import is_garbled

    nodes, loc = table(spark, sf_dir, "catechism_nodes"), table(spark, sf_dir, "localized_nodes")
    right = align.first_rows(loc, ["id", "lang"]).where("text IS NOT NULL AND lang IS NOT NULL")
    asked = F.col("text").rlike(_BEYOND)
    right = materialize(right.where(~asked).unionByName(spread(right.where(asked), scan=False).where(~is_garbled(F.col("text"), *_garble_model(spark, sf_dir)))))
    left = align.first_rows(nodes, ["id"]).where("text IS NOT NULL").join(right.select("id").distinct(), "id", "left_semi")
    splitter = sentences.train(_node_texts(spark, sf_dir))
    e = align.prepared(spread(left, scan=False), ["id"], "e", splitter)
    f = align.prepared(spread(right), ["id", "lang"], "f", splitter)
    units = materialize(spread(e.join(f, "id"), scan=False))
    return align.found(units, align.train(materialize(align.beads(units))))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work that each reference without a canonical label names, or 'none'."""
    from corpusmill.llm.reference import resolve

    return resolve(table(spark, sf_dir, "external_references"), table(spark, sf_dir, "external_sources"))


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm import pages

    return pages.lines(spread(table(spark, sf_dir, "source_pages").select("page_id", "local_path", "site", "content")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and line_no of each line of a page's main body, from the rendered page."""
    from corpusmill.llm import pages

    # the looks of the lines are written, not their texts
    return pages.body_lines(materialize(_page_lines(spark, sf_dir).drop("text", "place", "kind", "cells")))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each page as it is rendered; pages without a body have no row."""
    from corpusmill.llm import pages

    found = materialize(_page_lines(spark, sf_dir))
    return pages.body_text(found, pages.body_lines(found))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's words that lie in link lists, tag lists and menus."""
    from corpusmill.llm import spam

    observed = materialize(spam.observe(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return spam.shares(observed, spam.train(observed)).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly keywords, links or tags."""
    from corpusmill.llm import spam

    return p10_shares(spark, sf_dir).where(F.col("share") > spam.SHARE).select("doc_id")


def p9_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity, how many documents the packing holds, and whether every container fits."""
    packed = p9_packing(spark, sf_dir)
    per = packed.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("pieces"))
    docs = per.groupBy("capacity_id").agg(F.count("*").alias("documents"))
    fill = packed.groupBy("capacity_id", "container_id").agg(F.sum("piece_size").alias("fill")).groupBy("capacity_id").agg(F.max("fill").alias("most"))
    caps = table(spark, sf_dir, "pack_capacities").select("capacity_id", "capacity_tokens")
    return docs.join(fill, "capacity_id").join(caps, "capacity_id").select("capacity_id", "documents", (F.col("most") <= F.col("capacity_tokens")).alias("fits"))


def p8_no_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every document, and whether its list of ids is empty: it is for null and empty texts and for no other."""
    return p8_ids(spark, sf_dir).select("doc_id", (F.size("ids") == 0).alias("empty"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p3_found, p4_found, p4_text, p7_found, p6_found, p6_classes, p6_canonical, p8_ids, p8_no_ids, p9_packing, p9_totals, p10_found, p10_shares)}


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express: which documents have no ids, and that the packing holds every document in containers that fit."""
    return {
        "p8_no_ids": "SELECT doc_id, coalesce(text, '') = '' AS empty FROM documents",
        "p9_totals": "SELECT capacity_id, (SELECT count(*) FROM documents) AS documents, true AS fits FROM pack_capacities",
    }
