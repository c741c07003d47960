"""Scans of page files, JSON documents and date spines, and a paged reader that works offline."""

from __future__ import annotations

import fnmatch
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions.text import decode_page


class PageFiles(DataSource):
    """Files of a shared folder with their bytes, those included whose names begin with an underscore.

    Spark's own file sources pass over such names as hidden. The driver lists names only; each partition reads `batch` files.
    Options: path, pattern (of fnmatch, without regard to case), batch.
    """

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "file string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


class _FileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "").removeprefix("file://")
        self.pattern, self.batch = options.get("pattern", "*"), int(options.get("batch", "200"))

    def partitions(self):
        names = sorted(n for n in os.listdir(self.path) if fnmatch.fnmatch(n.lower(), self.pattern.lower()))
        return [InputPartition(names[k : k + self.batch]) for k in range(0, len(names), self.batch)] or [InputPartition([])]

    def read(self, partition):
        for n in partition.value:
            with open(os.path.join(self.path, n), "rb") as f:
                yield (n, os.path.join(self.path, n), f.read())


def scan_pages(spark: SparkSession, path: str, pattern: str = "__*.htm") -> DataFrame:
    """file, path and text of every page file whose name matches; charset sniffed, Latin-1 unless the page says UTF-8."""
    spark.dataSource.register(PageFiles)
    raw = spark.read.format("page_files").option("path", path).option("pattern", pattern).load()
    return raw.select("file", "path", decode_page(F.col("content")).alias("text"))


def paragraph_pages(pages: DataFrame, id_pattern: str = r"(?m)(?:^|>)\s*(\d{1,4})\s*\n") -> DataFrame:
    """paragraph_id and the first file, by name, in which it is marked."""
    found = pages.select("file", F.explode(F.regexp_extract_all("text", F.lit(id_pattern), F.lit(1))).alias("n"))
    return found.groupBy(F.col("n").try_cast("int").alias("paragraph_id")).agg(F.min("file").alias("file"))


def read_documents(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """Rows of the array `rows` in whole-file JSON documents, under an explicit schema (never inferred)."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(rows))


def load_pack(spark: SparkSession, path: str, schema: str, needed: bool = False) -> DataFrame:
    """A pack of JSON rows under an explicit schema; one that isn't there is empty, or an error if it is needed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).json(path)
    if needed:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from start to end, both included; none if end is before start."""
    days = F.when(F.lit(end) >= F.lit(start), F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("INTERVAL 1 DAY")))
    return spark.range(1).select(F.explode(days).alias("day"))


def result_total(c: Column) -> Column:
    """Total of 'Results a - b of N', null where there is none."""
    return F.regexp_extract(c, r"(?i)results\s+\d+\s*-\s*\d+\s+of\s+(\d+)", 1).try_cast("int")


def language_variants(pages: DataFrame) -> DataFrame:
    """(stem, lang, url): pages of one stem in several languages, the last url of each language."""
    stem = F.regexp_replace("url", r"/(?:en|fr|de|es|it|la|zh|ar)/", "/*/")
    return pages.where("url IS NOT NULL").groupBy(stem.alias("stem"), "lang").agg(F.max_by("url", "page_id").alias("url"))


def document_variants(links: DataFrame, codes: DataFrame, order: str) -> DataFrame:
    """(stem, language, url): pages linked as url with a label, by the language of the code in their address, else of their label.

    codes(code, language). Only html pages count, the last link (by order) of a language wins; links of no language are left out.
    """
    p = r"(?i)^(.*)_([a-z]{2}(?:-[a-z])?)\.(html?|pdf)$"
    d = links.where(F.col("url").rlike(r"(?i)\.html?$")).withColumn("stem", F.regexp_extract("url", p, 1)).withColumn("code", F.lower(F.regexp_extract("url", p, 2)))
    a, b = (codes.select(F.col("code").alias(k), F.col("language").alias(v)) for k, v in (("code", "__by_path"), ("__label", "__by_label")))
    d = d.withColumn("__label", F.lower(F.trim("label"))).join(a, "code", "left").join(b, "__label", "left").withColumn("language", F.coalesce("__by_path", "__by_label"))
    return d.where("language IS NOT NULL AND stem <> ''").groupBy("stem", "language").agg(F.max_by("url", order).alias("url"))


class PagedFiles(DataSource):
    """A paged source: one partition per section, pages read by offset until the stated total; offline, from JSON files.

    Options: path (folder with <section>-<offset>.json holding {"total", "per", "rows": [...]}), sections (comma-separated).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "section string, pos int, row string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sections = options.get("path"), [s for s in options.get("sections", "").split(",") if s]

    def partitions(self):
        return [InputPartition(s) for s in self.sections]

    def read(self, partition):
        offset, pos, total = 0, 0, None
        while total is None or offset < total:
            name = os.path.join(self.path, f"{partition.value}-{offset}.json")
            if not os.path.exists(name):
                return
            with open(name, encoding="utf-8") as f:
                page = json.load(f)
            for r in page.get("rows", []):
                yield (partition.value, pos, json.dumps(r, sort_keys=True))
                pos += 1
            total, per = page.get("total", 0), page.get("per", 0)
            if not per or not total:
                return
            offset += per
