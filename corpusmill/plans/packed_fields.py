"""Problem 5: several citations packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.packed import packed_citations
from corpusmill.session import table


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation of a packed field with its position and text."""
    return packed_citations(*(table(spark, sf_dir, t) for t in ("footnotes", "external_references", "external_sources")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, rec_id and pos of each value of the fields that hold two or more."""
    return p5_values(spark, sf_dir).select("rec_kind", "rec_id", "pos")


QUERIES = {"p5_found": p5_found, "p5_values": p5_values}
