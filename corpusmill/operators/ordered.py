"""Operators on one global order, without a window over the whole table.

The rows are split into ranges of the order; each range works by itself, and what a range must know of the others (its
offset, the last row before it) comes from one small row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.session import materialize


def _ranged(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the sampled range bounds, and so the range of a row, must not change between the steps
    return materialize(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Sum of the value over the rows of the key up to each row in the order (rows that tie may count each other or not).

    A key may hold any share of the rows: it is cut into ranges of (keys, order), each sums by itself, and a range gets the
    sums of the key's earlier ranges from a table with a row for each key and range.
    """
    df = _ranged(df.withColumn("__v", value), [*keys, *order], parts)
    sums = df.groupBy(*keys, "__p").agg(F.sum("__v").alias("__s"))
    key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ahead = key.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    sums = sums.withColumn("__o", F.coalesce(F.sum("__s").over(ahead), F.lit(0))).select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__p").alias("__q"), "__o")
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    local = F.sum("__v").over(W.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("__l", local).join(sums, same)
    return out.withColumn(name, (F.col("__l") + F.col("__o")).cast("bigint")).drop("__v", "__p", "__q", "__o", "__l", *(f"__k_{k}" for k in keys))


def with_position(df: DataFrame, order: list[str], name: str = "position", keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """0-based position of each row in the order, within the key if there is one; ties stand in any order among themselves."""
    got = running_sum(df, keys or [], order, F.lit(1), name, parts)
    return got.withColumn(name, F.col(name) - 1)


def prev_next(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """prev_<key> and next_<key> of each row in the order of a unique key; null at the ends."""
    df = _ranged(df, [key], parts)
    ends = df.groupBy("__p").agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    w = W.orderBy("__p")  # a row for each range
    ends = ends.select("__p", F.lag("__hi").over(w).alias("__before"), F.lead("__lo").over(w).alias("__after"))
    own = W.partitionBy("__p").orderBy(key)
    out = df.join(F.broadcast(ends), "__p")
    out = out.withColumn(f"prev_{key}", F.coalesce(F.lag(key).over(own), F.col("__before"))).withColumn(f"next_{key}", F.coalesce(F.lead(key).over(own), F.col("__after")))
    return out.drop("__p", "__before", "__after")


def carry_forward(df: DataFrame, order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """The latest non-null value up to each row in the global order."""
    df = _ranged(df.withColumn("__v", value), order, parts)
    last = df.groupBy("__p").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__last"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    last = last.select("__p", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    own = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.join(F.broadcast(last), "__p").withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(own), F.col("__before")))
    return out.drop("__p", "__v", "__before")


def running_id(df: DataFrame, keys: list[str], order: list[str], opens: Column, name: str = "segment", parts: int | None = None) -> DataFrame:
    """Number of opening rows so far within the key: 0 before the first."""
    return running_sum(df, keys, order, F.when(opens, 1).otherwise(0), name, parts)


def fill_levels(df: DataFrame, part: list[str], order: str, levels: list[str], identify) -> DataFrame:
    """Hierarchical carry-forward with cascade reset, level by level (explicit columns are <level>, sources are src_<level>).

    Per row in order: the explicit value, else what is carried, else the source value as long as nothing is carried; a
    value with the carried one's identifier keeps the carried value; a changed level clears all lower ones. Each level
    adds a reset epoch to the partition of the next, so deep levels work on ever smaller groups.
    """
    keys = list(part)
    for lv in levels:
        upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        either = F.coalesce(F.col(lv), F.col(f"src_{lv}"))
        df = df.withColumn("__seen", F.coalesce(F.max(either.isNotNull()).over(before), F.lit(False)))
        df = df.withColumn("__cand", F.when(F.col("__seen"), F.col(lv)).otherwise(either))
        df = df.withColumn("__prev", F.last(identify(F.col("__cand")), ignorenulls=True).over(before))
        df = df.withColumn("__changed", F.col("__cand").isNotNull() & (F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(identify(F.col("__cand")))))
        df = df.withColumn(f"full_{lv}", F.last(F.when(F.col("__changed"), F.col("__cand")), ignorenulls=True).over(upto))
        df = df.withColumn(f"__epoch_{lv}", F.sum(F.when(F.col("__changed"), 1).otherwise(0)).over(upto))
        keys.append(f"__epoch_{lv}")
    return df.drop("__seen", "__cand", "__prev", "__changed", *(f"__epoch_{lv}" for lv in levels))


def fill_levels_ordered(df: DataFrame, order: str, levels: list[str], identify, parts: int | None = None) -> DataFrame:
    """fill_levels over the whole order of a unique key, by ranges: what a range must know comes from a row for each range and epoch."""
    df = _ranged(df.withColumn("__e", F.lit(0).cast("bigint")), [order], parts)
    keys = ["__e"]
    for lv in levels:
        ahead = W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of the epoch
        own = W.partitionBy("__p", *keys).orderBy(order)
        upto, before = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(W.unboundedPreceding, -1)
        at = [*keys, "__p"]
        # the source value counts only where nothing is carried: in the first row of the epoch that has any value
        either = F.coalesce(F.col(lv), F.col(f"src_{lv}"))
        first = df.groupBy(*keys).agg(F.min(F.when(either.isNotNull(), F.col(order))).alias("__first"))
        df = df.join(first, keys).withColumn("__cand", F.when(F.col(order) == F.col("__first"), either).otherwise(F.col(lv)))
        df = df.withColumn("__id", identify(F.col("__cand")))
        last = df.groupBy(*at).agg(F.max_by("__id", F.when(F.col("__id").isNotNull(), F.col(order))).alias("__last"))
        last = last.select(*at, F.last("__last", ignorenulls=True).over(ahead).alias("__carried"))
        df = df.join(last, at).withColumn("__prev", F.coalesce(F.last("__id", ignorenulls=True).over(before), F.col("__carried")))
        df = df.withColumn("__changed", F.col("__cand").isNotNull() & (F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(F.col("__id"))))
        df = df.drop("__first", "__id", "__carried", "__prev")
        sums = df.groupBy(*at).agg(F.max_by("__cand", F.when(F.col("__changed"), F.col(order))).alias("__last"), F.count_if("__changed").alias("__n"))
        sums = sums.select(*at, F.last("__last", ignorenulls=True).over(ahead).alias("__value"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__epochs"))
        value = F.last(F.when(F.col("__changed"), F.col("__cand")), ignorenulls=True).over(upto)
        df = df.join(sums, at).withColumn(f"full_{lv}", F.coalesce(value, F.col("__value")))
        df = df.withColumn(f"__epoch_{lv}", F.sum(F.when(F.col("__changed"), 1).otherwise(0)).over(upto) + F.col("__epochs"))
        df = materialize(df.drop("__cand", "__changed", "__value", "__epochs"))
        keys.append(f"__epoch_{lv}")
    return df.drop("__p", *keys)
