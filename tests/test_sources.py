"""Scans, sinks, the paged source and streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import pages as P
from corpusmill.sources import sinks as K
from corpusmill.streaming import state
from tests.conftest import rows


def test_scan_pages(spark, tmp_path):
    (tmp_path / "__P2.HTM").write_bytes(b"<p>\n12\ncaf\xe9</p>")
    (tmp_path / "__P1.HTM").write_bytes("charset=utf-8 <p>\n12\nä</p>".encode())
    (tmp_path / "other.txt").write_text("no")
    pages = P.scan_pages(spark, str(tmp_path))
    assert sorted(r["text"][-5] for r in pages.collect()) == ["ä", "é"]
    assert rows(P.paragraph_pages(pages, r">\s*(\d{1,4})\s*\n")) == [(12, "__P1.HTM")]


def test_paged_source(spark, tmp_path):
    for off, ids in ((0, [1, 2]), (2, [3])):
        (tmp_path / f"s0-{off}.json").write_text(json.dumps({"total": 3, "per": 2, "rows": [{"id": i} for i in ids]}))
    spark.dataSource.register(P.PagedFiles)
    df = spark.read.format("paged_files").option("path", str(tmp_path)).option("sections", "s0,s1").load()
    assert rows(df.select("section", "pos")) == [("s0", 0), ("s0", 1), ("s0", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "en"), (2, "fr"), (3, "fr")], "id int, lang string")
    K.write_language_packs(df, str(tmp_path / "packs"))
    assert spark.read.json(str(tmp_path / "packs")).groupBy("lang").count().count() == 2
    K.write_with_stats(df, str(tmp_path / "all"), [F.count("*").alias("n")])
    assert spark.read.json(str(tmp_path / "all/stats")).first()["n"] == 3
    assert json.loads(K.document(df, "id").first()["document"])["count"] == 3


def test_documents_and_packs(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"rows": [{"id": 1, "t": "a"}, {"id": 2}], "count": 2}))
    assert rows(P.read_documents(spark, str(tmp_path / "doc.json"), "rows array<struct<id:int,t:string>>, count int", "rows")) == [(1, "a"), (2, None)]
    K.write_rows(spark.createDataFrame([(1, "a")], "id int, t string"), str(tmp_path / "pack"))
    assert rows(P.load_pack(spark, str(tmp_path / "pack"), "id int, t string")) == [(1, "a")]
    assert P.load_pack(spark, str(tmp_path / "none"), "id int").count() == 0
    with pytest.raises(FileNotFoundError):
        P.load_pack(spark, str(tmp_path / "none"), "id int", needed=True)


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "w"
    data = [("2025-01-01 00:01:00", "a"), ("2025-01-01 00:02:00", "a"), ("2025-01-01 00:11:00", "a"), ("2025-01-01 00:01:00", "b")]
    spark.createDataFrame(data, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(src))
    q = state.windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("windowed").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["count"]) for r in spark.table("windowed").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_date_spine(spark):
    assert P.date_spine(spark, "2025-01-30", "2025-02-02").count() == 4
    assert P.date_spine(spark, "2025-02-02", "2025-01-30").count() == 0


def test_debounce(spark):
    df = spark.createDataFrame([("a", "2025-01-01 00:00:00", 1), ("a", "2025-01-01 00:00:10", 2), ("a", "2025-01-01 00:02:00", 3), ("b", "2025-01-01 00:00:00", 4)], "u string, t string, i int").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r["i"] for r in state.debounce(df, "u", "t", 60.0, "i").collect()) == [2, 3, 4]


def test_recent_stream_equals_batch(spark, tmp_path):
    data = [(k % 2, f"p{(k * 7) % 5}", k) for k in range(40)]
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame(data, "user_id long, page string, ts int").coalesce(1).write.mode("overwrite").parquet(str(src))
    stream = spark.readStream.schema("user_id long, page string, ts int").parquet(str(src))
    q = state.recent_pages(stream, keep=3).writeStream.format("memory").queryName("recent").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = rows(spark.table("recent").select("user_id", "ord", "page"))
    want = rows(state.recent_batch(spark.createDataFrame(data, "user_id long, page string, ts int"), "user_id", "page", "ts", 3).select("user_id", "ord", "page"))
    assert got == want
