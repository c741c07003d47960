"""Filling fixed-capacity containers: the plan is made on the histogram of sizes, so its cost depends on the capacity only.

1. Sizes are counted (one small group-by). An item above the capacity becomes full containers and one rest.
2. A container is seen as equal bays, of which each holds a few items of usual size; an item takes as many bays as it needs.
   For each number of bays, shallow combinations of sizes that fill a window just below them are listed, and non-negative
   least squares finds how often to repeat each so that the histogram is used up. The repeats are rounded, and the step is
   done again on what is left, until it places little more. Filled bays are put together to containers.
3. What remains is packed greedily, still on the histogram, the largest size first with the best fitting partners.
4. Every item gets an ordinal among the items of its size and looks up the plan's interval that holds the ordinal.

The plan has a bounded number of rows: each step of it uses up a size, and there are no more sizes than tokens in a container.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.session import materialize

#: Combinations of at most this many sizes go into the least squares; the greedy pass takes any number.
DEPTH = 3
#: A combination counts as filling if it leaves at most this share of its bays unused.
WINDOW = 0.01
#: Combinations listed for each size in one step of the fit (candidates, not items: every item is packed in any case).
PER_SIZE = 8
#: Items of mean size that a bay holds; steps of the fit, and the share of the items from which another one is worth it.
IN_A_BAY, STEPS, WORTH = 2.4, 8, 0.01


def nnls(index: np.ndarray, b: np.ndarray, tolerance: float = 1e-5, most: int = 3000) -> np.ndarray:
    """x >= 0 that lessens |a x - b|, by multiplicative steps until a step of 20 lessens it by less than tolerance of |b|.

    index: a row for each column of a, the rows of a that the column holds, once for each time it does; -1 as filler.
    """
    there = index >= 0
    at = np.where(there, index, 0)
    down = lambda y: np.where(there, y[at], 0.0).sum(axis=1)  # noqa: E731 a.T @ y
    across = lambda x: np.bincount(at.ravel(), np.where(there, x[:, None], 0.0).ravel(), len(b))  # noqa: E731 a @ x
    x = np.full(len(index), b.sum() / max(there.sum(), 1))
    atb = down(b)
    before, scale = np.inf, max(float(np.linalg.norm(b)), 1e-12)
    for k in range(most):
        ax = across(x)
        if k % 20 == 0:
            now = float(np.linalg.norm(ax - b)) / scale
            if before - now < tolerance:
                break
            before = now
        x *= atb / np.maximum(down(ax), 1e-12)
    return x


def combinations(sizes: np.ndarray, counts: np.ndarray, room: int, above: int = 0) -> list[tuple[int, ...]]:
    """Combinations of 1 to DEPTH sizes, the largest more than `above`, whose sum lies in the window below the room.

    For each largest size up to PER_SIZE, the fullest first, and of equally full ones those of the most frequent sizes.
    """
    least = room - max(1, int(room * WINDOW))
    have = np.zeros(room + 1, dtype=np.int64)
    ok = sizes <= room
    sizes = sizes[ok]
    have[sizes] = counts[ok]
    out: list[tuple[int, ...]] = []
    for big in sizes[::-1]:
        if big <= above:
            break
        found: list[tuple[int, ...]] = [(int(big),)] if big >= least else []
        second = sizes[(sizes <= big) & (sizes < room - big)][::-1]
        for total in range(room, least - 1, -1):
            if len(found) >= PER_SIZE:
                break
            rest = total - int(big)
            if 0 < rest <= big and have[rest] - (rest == big) > 0:
                found.append((int(big), rest))
            third = rest - second
            fit = second[(third > 0) & (third <= second)]
            fit = fit[have[rest - fit] > 0]
            if len(fit):
                worth = np.minimum(have[fit], have[rest - fit])
                for s in fit[np.argsort(-worth, kind="stable")][: PER_SIZE - len(found)]:
                    found.append((int(big), int(s), rest - int(s)))
        out += found
    return out


def fitted(left: np.ndarray, room: int, above: int = 0, most: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """[(combination, repeats)] by the least squares for one number of bays, at most `most` repeats in all.

    What they use is taken from left, the items of each size.
    """
    out: list[tuple[tuple[int, ...], int]] = []
    free = most if most is not None else int(left.sum())
    for _ in range(STEPS):
        sizes = np.flatnonzero(left)
        whole = left[(np.arange(len(left)) > above) & (np.arange(len(left)) <= room)].sum()
        combos = combinations(sizes, left[sizes], room, above) if whole else []
        if not combos:
            break
        index = {int(s): k for k, s in enumerate(sizes)}
        rows = np.array([[index[s] for s in c] + [-1] * (DEPTH - len(c)) for c in combos])
        x = nnls(rows, left[sizes].astype(np.float64))
        placed = 0
        for j in np.argsort(-x, kind="stable"):
            c = combos[j]
            n = min(int(np.floor(x[j] + 0.5)), free)
            for s in set(c):
                n = min(n, int(left[s]) // c.count(s))
            if n > 0:
                for s in c:
                    left[s] -= n
                out.append((c, n))
                placed += n
                free -= n
        if not free or placed <= WORTH * whole:
            break
    return out


def assembled(bricks: dict[int, deque], bays: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """[(combination, repeats)] of at most `most` containers whose bays are filled; bricks that fill no container stay in their queues."""
    out: list[tuple[tuple[int, ...], int]] = []
    while most > 0:
        have = {k: sum(n for _, n in q) for k, q in bricks.items() if q}
        pattern: dict[int, int] = {}
        room = bays
        for k in sorted(have, reverse=True):
            pattern[k] = min(have[k], room // k)
            room -= k * pattern[k]
        pattern = {k: c for k, c in pattern.items() if c}
        if room or not pattern:
            return out
        times = min([most, *(have[k] // c for k, c in pattern.items())])
        most -= times
        while times:
            # as many containers of the same bricks as the queues begin with, else one of mixed bricks
            same = min([times, *(bricks[k][0][1] // c for k, c in pattern.items())])
            combo: list[int] = []
            for k, c in pattern.items():
                q = bricks[k]
                if same:
                    combo += list(q[0][0]) * c
                    q[0] = (q[0][0], q[0][1] - same * c)
                    if not q[0][1]:
                        q.popleft()
                    continue
                need = c
                while need:
                    some = min(need, q[0][1])
                    combo += list(q[0][0]) * some
                    need -= some
                    q[0] = (q[0][0], q[0][1] - some)
                    if not q[0][1]:
                        q.popleft()
            out.append((tuple(combo), max(same, 1)))
            times -= max(same, 1)
    return out


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(combination, repeats)] that uses every item of the histogram exactly once. sizes: ascending, 1 to capacity."""
    return plan_steps(sizes, counts, capacity)[0]


def plan_steps(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """The plan, and how many items the least squares placed in it.

    All bays of a container but one are filled first. What is then left of it, the last bay and the few tokens that the
    others left unused, is a window of its own: containers with equal room get their last combinations by the fit as well.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[sizes] = counts
    mean = float((sizes * counts).sum() / max(counts.sum(), 1))
    bays = max(1, int(capacity / max(IN_A_BAY * mean, 1.0)))
    bay = capacity // bays
    done = fitted(left, capacity, (bays - 1) * bay)
    bricks = {k: deque(fitted(left, k * bay, (k - 1) * bay)) for k in range(bays - 1, 0, -1)}
    by_room: dict[int, deque] = {}
    # as many containers as all that is left would fill; the bays beyond that are taken apart for the last bays
    tokens = int((left * np.arange(len(left))).sum()) + sum(sum(c) * n for q in bricks.values() for c, n in q)
    for c, n in assembled(bricks, bays - 1, tokens // capacity) if bays > 1 else []:
        by_room.setdefault(capacity - sum(c), deque()).append((c, n))
    for q in bricks.values():
        for c, n in q:
            for s in c:
                left[s] += n
    started: list[tuple[tuple[int, ...], int]] = []
    for room in sorted(by_room):
        q = by_room[room]
        last = deque(fitted(left, room, 0, sum(n for _, n in q)))
        while q and last:
            (c, n), (d, m) = q.popleft(), last.popleft()
            k = min(n, m)
            done.append((c + d, k))
            if n > k:
                q.appendleft((c, n - k))
            if m > k:
                last.appendleft((d, m - k))
        started += q
    placed = sum(len(c) * n for c, n in done + started)
    # the rest, first into the containers that have room: best fit decreasing on the histogram
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return done + started, placed
        if started:
            c, n = started.pop()
            combo, room = list(c), capacity - sum(c)
        else:
            big = int(some[-1])
            combo, room, n = [big], capacity - big, 0
            left[big] -= 1
        begun = len(combo) if n else 0
        while room > 0:
            fit = some[: np.searchsorted(some, room, side="right")]
            fit = fit[left[fit] > 0]
            if not len(fit):
                break
            s = int(fit[-1])
            if len(fit) > 1 and s < room:  # two that fill the room beat one that doesn't
                mate = room - fit
                pair = fit[(mate > 0) & (left[np.maximum(mate, 0)] > 0) & ((mate != fit) | (left[fit] > 1))]
                if len(pair):
                    s = int(pair[-1])
            combo.append(s)
            left[s] -= 1
            room -= s
        added = combo[begun:]
        more = min((int(left[s]) // added.count(s) for s in set(added)), default=n - 1)
        times = 1 + (more if not n else min(more, n - 1))
        for s in added:
            left[s] -= times - 1
        done.append((tuple(combo), times))
        if n > times:
            started.append((c, n - times))


def pack(items: DataFrame, capacities: DataFrame, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """(capacity_id, container_id, id, piece_no, piece_start, piece_size), one row for each piece of each item and capacity.

    An item is one piece unless its size exceeds the capacity; then it is full pieces and a rest. Items of size 0 (null and
    empty texts) share container 0 of each capacity, with one piece of size 0. Null capacities and those below 1 are left
    out. Repeated rows are items of their own. The sizes of all items are used; broadcast are the capacities' plans only.
    """
    spark: SparkSession = items.sparkSession
    caps = [(int(c), int(t)) for c, t in capacities.select("capacity_id", "capacity_tokens").where("capacity_tokens >= 1 AND capacity_id IS NOT NULL").distinct().collect()]
    items = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("int").alias("size"))
    # written once: the sizes are dear, and the part of a row must not change between the steps
    items = materialize(items.withColumn("part", F.spark_partition_id()))
    cap_df = spark.createDataFrame(caps, "capacity_id int, cap int")
    each = (
        items.crossJoin(F.broadcast(cap_df))  # a row for each use, of which there are a handful
        .withColumn("n_full", F.when(F.col("size") > F.col("cap"), F.floor(F.col("size") / F.col("cap"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", (F.col("size") - F.col("n_full") * F.col("cap")).cast("int"))
    )
    # ordinals without a big window: those of a part within the part, then the parts' offsets
    local = each.withColumn("nth", F.row_number().over(W.partitionBy("part", "capacity_id", "rest").orderBy("id", "size")) - 1)
    per_part = each.groupBy("capacity_id", "rest", "part").agg(F.count("*").alias("n"), F.sum("n_full").alias("f"))
    ahead = W.partitionBy("capacity_id", "rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    # for the ids of full containers: all full ones that lie before (rest, part)
    histogram = per_part.groupBy("capacity_id", "rest").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).collect()
    rows, first_full = [], []
    for cid, cap in caps:
        hist = sorted((int(r["rest"]), int(r["n"])) for r in histogram if r["capacity_id"] == cid and r["rest"] > 0)
        used: dict[int, int] = {}
        at = 1
        if hist:
            for combo, n in plan(np.array([s for s, _ in hist]), np.array([k for _, k in hist]), cap):
                start = 0
                for s in combo:
                    lo = used.get(s, 0)
                    rows.append((cid, s, lo, lo + n, at, start))
                    used[s] = lo + n
                    start += s
                at += n
        for r in sorted((r for r in histogram if r["capacity_id"] == cid), key=lambda r: r["rest"]):
            first_full.append((cid, int(r["rest"]), at))
            at += int(r["f"] or 0)
    fulls = spark.createDataFrame(first_full, "capacity_id int, rest int, full_at long")
    before_full = offsets.withColumn("f_before", F.coalesce(F.sum("f").over(ahead), F.lit(0))).join(F.broadcast(fulls), ["capacity_id", "rest"])
    w_full = W.partitionBy("part", "capacity_id", "rest").orderBy("id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        local.withColumn("f_local", F.coalesce(F.sum("n_full").over(w_full), F.lit(0)))
        .join(before_full.select("capacity_id", "rest", "part", "before", "f_before", "full_at"), ["capacity_id", "rest", "part"])
        .withColumn("ordinal", F.col("nth") + F.col("before"))
        .withColumn("full_first", F.col("full_at") + F.col("f_before") + F.col("f_local"))
    )
    # the plan, an interval for each of its steps and sizes, is small by construction: found by binary search, no join
    slots = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(slots)

    @F.pandas_udf("struct<container:bigint,start:int>")
    def slot(cid: pd.Series, rest: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        table = shared.value
        c, r, o = (x.to_numpy(dtype=np.int64) for x in (cid, rest, ordinal))
        # (capacity, rest) as one number, then the interval whose beginning is the last one not after the ordinal
        codes = np.unique(table[:, 0] * (1 << 32) + table[:, 1])
        mine = np.searchsorted(codes, c * (1 << 32) + r)
        key = np.searchsorted(codes, table[:, 0] * (1 << 32) + table[:, 1]) * (1 << 44) + table[:, 2]
        at = np.searchsorted(key, mine * (1 << 44) + o, side="right") - 1
        some = r > 0
        at = np.where(some, at, 0)
        if not len(table):
            return pd.DataFrame({"container": np.zeros(len(c), dtype=np.int64), "start": np.zeros(len(c), dtype=np.int32)})
        return pd.DataFrame({"container": np.where(some, table[at, 4] + o - table[at, 2], 0), "start": np.where(some, table[at, 5], 0).astype(np.int32)})

    placed = placed.withColumn("slot", slot("capacity_id", "rest", "ordinal"))
    rest_piece = F.when(
        (F.col("rest") > 0) | (F.col("size") == 0),
        F.array(
            F.struct(
                F.col("slot.container").alias("container_id"),
                F.col("n_full").alias("piece_no"),
                (F.col("n_full") * F.col("cap")).cast("int").alias("piece_start"),
                F.col("rest").alias("piece_size"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<container_id:bigint,piece_no:int,piece_start:int,piece_size:int>>"))
    full_pieces = F.when(
        F.col("n_full") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("n_full") - 1),
            lambda k: F.struct(
                (F.col("full_first") + k).cast("long").alias("container_id"),
                k.cast("int").alias("piece_no"),
                (k * F.col("cap")).cast("int").alias("piece_start"),
                F.col("cap").alias("piece_size"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<container_id:bigint,piece_no:int,piece_start:int,piece_size:int>>"))
    return placed.select("capacity_id", F.col("id").alias(id_col), F.inline(F.concat(full_pieces, rest_piece))).select(
        "capacity_id", "container_id", id_col, "piece_no", "piece_start", "piece_size"
    )

