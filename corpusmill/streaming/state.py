"""Event streams: per-user recency state, quiet-delay debouncing, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Pages remembered for each user.
RECENT = 10


def recent_pages(stream: DataFrame, user: str = "user_id", page: str = "page", ts: str = "ts", keep: int = RECENT) -> DataFrame:
    """Streaming: after each batch, the user's most recent distinct pages, oldest first. The state has at most `keep` entries."""
    schema = f"{user} bigint, ord int, {page} string"

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        for p in rows[page].dropna():
            if p in seen:
                seen.remove(p)
            seen.append(p)
        seen = seen[-keep:]
        state.update((seen,))
        yield pd.DataFrame({user: [key[0]] * len(seen), "ord": range(1, len(seen) + 1), page: seen})

    return stream.groupBy(user).applyInPandasWithState(update, schema, "pages array<string>", "update", GroupStateTimeout.NoTimeout)


def recent_batch(df: DataFrame, user: str, page: str, ts: str, keep: int = RECENT) -> DataFrame:
    """The same over a whole table: (user, ord, page)."""
    last = df.where(F.col(page).isNotNull()).groupBy(user, page).agg(F.max(ts).alias("__at"))
    k = F.row_number().over(W.partitionBy(user).orderBy(F.desc("__at"), page))
    top = last.withColumn("__k", k).where(F.col("__k") <= keep)
    n = F.count("*").over(W.partitionBy(user))
    return top.select(user, (n - F.col("__k") + 1).cast("int").alias("ord"), page)


def debounce(df: DataFrame, key: str, ts: str, delay_s: float, tie: str) -> DataFrame:
    """Events after which the key was quiet for at least the delay; the last event of a key always counts. 0 keeps all."""
    nxt = F.lead(ts).over(W.partitionBy(key).orderBy(ts, tie))
    gap = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") >= delay_s * 1e6)).drop("__gap")


def windowed_counts(stream: DataFrame, ts: str, key: str, late: str = "1 hour", size: str = "10 minutes") -> DataFrame:
    """Events per window and key; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).count()
