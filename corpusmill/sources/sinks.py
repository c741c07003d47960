"""Sinks: whole-document JSON, one folder per language, payload with statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines, in parallel: the form for data of any size."""
    df.write.mode("overwrite").json(path)


def write_language_packs(df: DataFrame, path: str, lang_col: str = "lang") -> None:
    """One folder per language. Rows are spread by language and a salt, so that a large language has several files."""
    salted = df.repartition(F.col(lang_col), (F.rand(7) * 8).cast("int"))
    salted.write.mode("overwrite").partitionBy(lang_col).json(path)


def write_with_stats(df: DataFrame, path: str, stats: list) -> None:
    """Rows beside one row of statistics, each in its folder."""
    df.write.mode("overwrite").json(f"{path}/rows")
    df.agg(*stats).coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def document(df: DataFrame, order: str, name: str = "rows", most: int = 100_000) -> DataFrame:
    """The whole table as one JSON document in one row, in order. For small tables only: raises beyond `most` rows."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows; use write_rows")
    got = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])
    return df.agg(F.to_json(F.struct(got.alias(name), F.count("*").alias("count"))).alias("document"))
