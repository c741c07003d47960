"""Keep-first, keep-last and top-1 by key, as aggregations with partial results (no window over a hot key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by(df: DataFrame, keys: list[str], order: list[str | Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*o)).alias("__row"))
    return got.select(*keys, *(F.col("__row")[c].alias(c) for c in rest)).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the smallest order of each key; a null key is a key of its own, rows whose whole order is equal are one."""
    return _by(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the largest order of each key."""
    return _by(df, keys, order, F.max_by)


def append_unique(first: Column, second: Column) -> Column:
    """Both arrays one after the other, each value once, in order of first appearance."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))
