"""Graph operators on edge tables (source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

DAMPING, ROUNDS, CUT_EVERY = 0.85, 45, 5


def edges_from_lists(nodes: DataFrame, id_col: str = "id", list_col: str = "xrefs") -> DataFrame:
    """(source, target) of each list element whose target is a node; self-loops stay, elements listed twice too."""
    raw = nodes.select(F.col(id_col).alias("source"), F.explode(list_col).alias("target"))
    return raw.join(nodes.select(F.col(id_col).alias("target")).distinct(), "target", "left_semi").select("source", "target")


def pagerank(nodes: DataFrame, edges: DataFrame, id_col: str = "id", rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, rank) after exactly `rounds` synchronous rounds from 1/N; the mass of nodes without edges is spread over all.

    Edges from or to unknown nodes are ignored; self-loops and repeated edges count. The ranks always sum to 1, so a round
    is x' = M x + b with M the damped shares and b a number that follows from the sum of M x. Hence x after k rounds is a
    combination of w_0 .. w_k, w_0 = 1 and w_(j+1) = M w_j, whose factors follow from the sums of the w_j: the rounds are
    a chain of joins and sums of one number a node, with no number going to the driver and back in each. Every CUT_EVERY
    rounds their w_j are written to the shared folder and only the last goes on, so what a round shuffles doesn't grow.
    Sums are partial before they are shuffled, so a hub's incoming mass doesn't meet in one task. No nodes give no rows.
    """
    ids = nodes.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    known = ids.select(F.col("id").alias("k"))
    e = edges.select("source", "target").join(known, F.col("source") == F.col("k"), "left_semi").join(known, F.col("target") == F.col("k"), "left_semi")
    e = e.groupBy("source", "target").agg(F.count("*").alias("w"))
    out = e.groupBy("source").agg(F.sum("w").alias("deg"))
    e = e.join(out, "source").select("source", "target", (F.col("w") / F.col("deg") * damping).alias("share"))
    # an edge of each node to itself carries the w_j of the block, so that the state is read once a round
    own = ids.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(None).cast("double").alias("share"))
    e = materialize(e.unionByName(own))
    state, last, kept = ids.select("id", F.lit(1.0).alias("w0")), "w0", []
    blocks, done = [], 0
    while done < rounds:
        kept = []
        for k in range(done + 1, min(done + CUT_EVERY, rounds) + 1):
            step = e.join(state, F.col("source") == F.col("id"))
            carried = [F.sum(F.when(F.col("share").isNull(), F.col(c))).alias(c) for c in kept]
            state = step.groupBy(F.col("target").alias("id")).agg(F.coalesce(F.sum(F.col("share") * F.col(last)), F.lit(0.0)).alias(f"w{k}"), *carried)
            last = f"w{k}"
            kept.append(last)
        done += len(kept)
        written = materialize(state)
        blocks.append((written, kept))
        state = written.select("id", last)
    sums = {0: float(ids.count())}
    rows = None
    for table, names in blocks:
        one = table.select(*(F.sum(c).alias(c) for c in names)).select(F.explode(F.array(*(F.struct(F.lit(int(c[1:])).alias("j"), F.col(c).alias("s")) for c in names))).alias("r")).select("r.*")
        rows = one if rows is None else rows.unionByName(one)
    if not sums[0]:
        return ids.select("id", F.lit(0.0).alias("rank"))
    sums |= {r["j"]: r["s"] for r in rows.collect()} if rows is not None else {}  # a number for each round
    factors = [1.0 / sums[0]]
    for _ in range(rounds):
        got = sum(g * sums[j + 1] for j, g in enumerate(factors))
        factors = [(1.0 - got) / sums[0], *factors]
    parts = ids.select("id", F.lit(factors[0]).alias("rank"))
    for table, names in blocks:
        parts = parts.unionByName(table.select("id", sum((F.col(c) * factors[int(c[1:])] for c in names), F.lit(0.0)).alias("rank")))
    return parts.groupBy("id").agg(F.sum("rank").alias("rank"))


def degrees(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """id, in_degree, out_degree and the sorted list of sources; 0 and empty where there is none."""
    ids = nodes.select(F.col(id_col).alias("id")).distinct()
    inn = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"), F.sort_array(F.collect_set("source")).alias("incoming"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))
    none = F.array().cast("array<int>")
    return ids.join(inn, "id", "left").join(out, "id", "left").select(
        "id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("incoming", none).alias("incoming")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, without self-loops, each once."""
    e = edges.where("source <> target")
    return e.select("source", "target").union(e.select(F.col("target"), F.col("source"))).distinct()


def bfs(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of every node within `depth` undirected steps of a root, the roots included at 0."""
    both = undirected(edges)
    seen = roots.select(F.col("id"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(both, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
        if k % 4 == 0:
            seen = materialize(seen)
            frontier = seen.where(F.col("depth") == k)
    return seen


def reachable(links: DataFrame, seeds: DataFrame, limit: int, most_rounds: int | None = None) -> DataFrame:
    """Crawl: every page reached from the seeds over links(source, target); raises if more than `limit` pages are visited or the rounds are used up.

    A round writes and counts its frontier only; every 16 rounds the frontiers are put into one table.
    """
    frontier = materialize(seeds.select("id").where("id IS NOT NULL").distinct())
    seen, visited, rounds = frontier, frontier.count(), 0
    while True:
        frontier = materialize(frontier.join(links, F.col("id") == F.col("source")).select(F.col("target").alias("id")).where("id IS NOT NULL").distinct().join(seen, "id", "left_anti"))
        n = frontier.count()
        if not n:
            return seen
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise ValueError(f"pages are left after {most_rounds} rounds")
        visited += n
        if visited > limit:
            raise ValueError(f"{visited} pages visited; the limit is {limit}")
        seen = seen.unionByName(frontier)
        if rounds % 16 == 0:
            seen = materialize(seen)


def neighbour_flags(edges: DataFrame, root: int) -> DataFrame:
    """(id, incoming, outgoing) of the root's neighbours, itself left out."""
    out = edges.where(F.col("source") == root).select(F.col("target").alias("id"), F.lit(False).alias("incoming"), F.lit(True).alias("outgoing"))
    inn = edges.where(F.col("target") == root).select(F.col("source").alias("id"), F.lit(True).alias("incoming"), F.lit(False).alias("outgoing"))
    return out.unionByName(inn).where(F.col("id") != root).groupBy("id").agg(F.max("incoming").alias("incoming"), F.max("outgoing").alias("outgoing"))


def one_way(edges: DataFrame) -> DataFrame:
    """Distinct edges whose reverse is missing."""
    e = edges.select("source", "target").distinct()
    return e.join(e.select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"], "left_anti")


def active_edges(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """Edges both of whose ends are marked."""
    m = marked.select(F.col("id").alias("m")).distinct()
    return edges.join(m, F.col("source") == F.col("m"), "left_semi").join(m, F.col("target") == F.col("m"), "left_semi")


def layout(nodes: DataFrame, edges: DataFrame, ticks: int = 20, cell: float = 60.0) -> DataFrame:
    """(id, x, y): a force layout whose ticks are joins and aggregations, not one task over the whole graph.

    Nodes (id, group) start on a spiral around their group's anchor. A tick pulls linked nodes towards a distance of 18,
    pulls to the anchor, and pushes from the centre of the node's grid cell (repulsion by cells instead of by pairs).
    Deterministic; positions are rounded to two decimals. It is not bit-equal to other engines' simulations.
    """
    a = F.pmod(F.xxhash64("group"), F.lit(12)) * F.lit(0.5235987755982988)
    spiral = F.sqrt(F.col("id").cast("double")) * 9.0
    turn = F.col("id") * F.lit(2.399963229728653)
    at = nodes.select("id", (F.cos(a) * 260).alias("ax"), (F.sin(a) * 260).alias("ay"), spiral.alias("r"), turn.alias("t"))
    at = materialize(at.select("id", "ax", "ay", (F.col("ax") + F.col("r") * F.cos("t")).alias("x"), (F.col("ay") + F.col("r") * F.sin("t")).alias("y")))
    links = materialize(undirected(edges))
    for k in range(ticks):
        heat = 1.0 - k / ticks
        other = at.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        pull = links.join(at.select(F.col("id").alias("source"), "x", "y"), "source").join(other, "target")
        d = F.greatest(F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")), F.lit(1e-6))
        f = (d - 18) / d * 0.035
        pull = pull.groupBy(F.col("source").alias("id")).agg(F.sum((F.col("tx") - F.col("x")) * f).alias("px"), F.sum((F.col("ty") - F.col("y")) * f).alias("py"))
        grid = at.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
        cells = grid.groupBy("gx", "gy").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
        moved = grid.join(cells, ["gx", "gy"]).join(pull, "id", "left")
        dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
        far = F.greatest(dx * dx + dy * dy, F.lit(25.0))
        push = 18.0 * (F.col("n") - 1) / far
        step = lambda v, p, dv, anchor: (F.col(v) + heat * (F.coalesce(F.col(p), F.lit(0.0)) + dv * push + (F.col(anchor) - F.col(v)) * 0.06)).alias(v)
        at = moved.select("id", "ax", "ay", step("x", "px", dx, "ax"), step("y", "py", dy, "ay"))
        at = materialize(at)  # read three times in the next tick
    return at.select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
