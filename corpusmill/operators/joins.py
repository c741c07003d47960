"""Lookups and joins: overlays, fallbacks, rules, ranges, selections, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule or dimension table of more rows than this isn't sent to every worker.
SMALL = 50_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if a count shows at most `most` rows, else as it is: an equality join then shuffles, one on ranges or conditions compares blocks."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lookup(df: DataFrame, dim: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their entry, rows without one): an inner lookup whose misses can be reported."""
    return df.join(dim, on, "inner"), df.join(dim.select(*on).distinct(), on, "left_anti")


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with each of the columns replaced where the overlay has a value."""
    o = over.select(key, *(F.col(c).alias(f"__o_{c}") for c in columns))
    got = base.join(o, key, "left")
    return got.select(*(F.coalesce(F.col(f"__o_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def with_fallback(df: DataFrame, dim: DataFrame, exact: list[str], wild: list[str], value: str, wildcard: dict[str, Column]) -> DataFrame:
    """dim's value by the exact keys, else by the keys in wild among dim's wildcard rows: two equality joins, no OR join."""
    is_wild = None
    for c, v in wildcard.items():
        cond = F.col(c).eqNullSafe(v)
        is_wild = cond if is_wild is None else is_wild & cond
    a = dim.where(~is_wild).select(*exact, F.col(value).alias("__exact"))
    b = dim.where(is_wild).select(*wild, F.col(value).alias("__wild"))
    return df.join(a, exact, "left").join(b, wild, "left").withColumn(value, F.coalesce("__exact", "__wild")).drop("__exact", "__wild")


def first_rule(df: DataFrame, text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern matches: an expression, so rules cost neither a join nor a shuffle."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def zip_ordered(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides paired by their ordinal within the key, from 1; the longer side is cut.

    Ordinals are found by ranges of the order and the pairs joined on key and ordinal, so a key with a third of the rows is
    neither sorted nor joined in one task.
    """
    from corpusmill.operators.ordered import with_position

    a = with_position(left, left_order, "ordinal", keys).withColumn("ordinal", F.col("ordinal") + 1)
    b = with_position(right, right_order, "ordinal", keys).withColumn("ordinal", F.col("ordinal") + 1)
    return a.join(b, [*keys, "ordinal"])


def range_first(df: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, order: str, name: str, keep: list[str]) -> DataFrame:
    """The first range [lo, hi] that holds the value, by order; null where none does. ranges is counted before it is broadcast."""
    hit = df.join(small(ranges), F.col(value).between(F.col(lo), F.col(hi)), "left")
    return hit.groupBy(*keep).agg(F.min_by(name, order).alias(name))


def nearest(points: DataFrame, queries: DataFrame, radius: float, id_col: str = "id", xy: tuple[str, str] = ("pos_x", "pos_y")) -> DataFrame:
    """The nearest point (other than itself) of each query point within the radius, ties to the smaller id.

    Points are put in cells of the radius' size; a query looks into its cell and the eight around it, so the join is an
    equality join on cells and no cross join.
    """
    x, y = xy
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    p = points.select(F.col(id_col).alias("near_id"), F.col(x).alias("px"), F.col(y).alias("py"), cell(x).alias("gx"), cell(y).alias("gy"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = queries.select(F.col(id_col).alias("id"), F.col(x).alias("qx"), F.col(y).alias("qy"), cell(x).alias("cx"), cell(y).alias("cy"), F.explode(offsets).alias("o"))
    q = q.select("id", "qx", "qy", (F.col("cx") + F.col("o.i")).alias("gx"), (F.col("cy") + F.col("o.j")).alias("gy"))
    d = F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")))
    hit = q.join(p, ["gx", "gy"]).where(F.col("near_id") != F.col("id")).withColumn("dist", d).where(F.col("dist") < radius)
    got = hit.groupBy("id").agg(F.min(F.struct("dist", "near_id")).alias("m"))
    return got.select("id", F.col("m.near_id").alias("near_id"), F.col("m.dist").alias("dist"))


def priority_pick(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The best entry of each key by an order of preference."""
    from corpusmill.operators.dedupe import keep_first

    return keep_first(df, keys, order)
