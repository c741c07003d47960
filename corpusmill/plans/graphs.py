"""Graph queries: edges, PageRank, traversal, degrees, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import graph as G
from corpusmill.operators.dedupe import keep_first
from corpusmill.operators.joins import nearest
from corpusmill.session import table

#: SQL of the node table with one row per id, the one ingested first.
N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id) AS rn FROM catechism_nodes) WHERE rn = 1)"
E = f"WITH {N}, e AS (SELECT source, target FROM (SELECT id AS source, unnest(xrefs) AS target FROM n) WHERE target IN (SELECT id FROM n))"
ROOT = 1


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per id of catechism_nodes, the one with the smallest row_id."""
    t = table(spark, d, "catechism_nodes")
    return keep_first(t.select(*dict.fromkeys(("row_id", "id", *columns))), ["id"], ["row_id"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges_from_lists(nodes(spark, d, "xrefs"))


def grf_edges(spark, d):
    """GRF-03, FLT-02: cross-references whose target exists, as edges."""
    return edges(spark, d).groupBy("source", "target").agg(F.count("*").alias("n"))


def grf_pagerank(spark, d):
    """GRF-01, GRF-02, PRJ-01, AGG-13: rank, relative rank, radius and degree of every node."""
    n = nodes(spark, d, "xrefs", "title")
    e = G.edges_from_lists(n)
    ranks = G.pagerank(n, e)
    deg = G.degrees(n, e)
    total = n.select("id", F.size("xrefs").alias("x")).join(deg, "id").select("id", (F.col("x") + F.col("in_degree")).cast("bigint").alias("degree"))
    top = ranks.agg(F.max("rank").alias("top"))
    rel = F.when(F.col("degree") == 0, F.lit(0.0)).otherwise(F.col("rank") / F.col("top") * 100)
    both = ranks.join(total, "id").join(F.broadcast(top))  # one row
    return both.select("id", "degree", F.round("rank", 8).alias("pagerank"), F.round(rel, 1).alias("relative"), F.round(2.1 + rel / 100 * 5.4, 2).alias("radius"))


def grf_degrees(spark, d):
    """AGG-07, AGG-09: in- and out-degree and the sorted list of referring nodes."""
    n = nodes(spark, d, "xrefs")
    g = G.degrees(n, G.edges_from_lists(n))
    return g.select("id", F.col("in_degree").cast("bigint").alias("in_degree"), F.col("out_degree").cast("bigint").alias("out_degree"), F.array_join(F.col("incoming").cast("array<string>"), ",").alias("incoming"))


def grf_bfs_depth2(spark, d):
    """GRF-04: nodes within two undirected steps of the root."""
    root = spark.createDataFrame([(ROOT,)], "id int")
    return G.bfs(edges(spark, d), root, 2).select("id", F.col("depth").cast("bigint").alias("depth"))


def grf_one_hop(spark, d):
    """GRF-05, JOIN-11: neighbours of the root with direction flags."""
    return G.neighbour_flags(edges(spark, d), ROOT)


def grf_one_way(spark, d):
    """JOIN-10: edges without a reverse edge."""
    return G.one_way(edges(spark, d))


def grf_active_edges(spark, d):
    """GRF-07: edges with both ends in the root's neighbourhood."""
    e = edges(spark, d)
    root = spark.createDataFrame([(ROOT,)], "id int")
    return G.active_edges(e, G.bfs(e, root, 1)).distinct()


def grf_stored_edges(spark, d):
    """SRC-17: every node reached from the root over the stored edge table, by a crawl with a visited set."""
    e = table(spark, d, "catechism_edges")
    return G.reachable(e, spark.createDataFrame([(ROOT,)], "id int"), 50_000_000)


def grf_nearest(spark, d):
    """JOIN-12: the nearest other node within 40 units."""
    n = nodes(spark, d, "pos_x", "pos_y")
    return nearest(n, n, 40.0).select("id", "near_id", F.round("dist", 6).alias("dist"))


def grf_cluster_pull(spark, d):
    """PRJ-13: neighbours of the root moved to a fifth of their distance from it."""
    n = nodes(spark, d, "pos_x", "pos_y").select("id", "pos_x", "pos_y")
    root = n.where(F.col("id") == ROOT).select(F.col("pos_x").alias("rx"), F.col("pos_y").alias("ry"))
    near = G.neighbour_flags(edges(spark, d), ROOT).select("id")
    moved = n.join(near, "id").join(F.broadcast(root))  # one row
    at = lambda p, r: F.round(F.col(r) + (F.col(p) - F.col(r)) * 0.2, 6)
    return moved.select("id", at("pos_x", "rx").alias("x"), at("pos_y", "ry").alias("y"))


def grf_layout(spark, d):
    """GRF-06: force layout by joins and aggregations, not bit-equal to other simulations (rows only)."""
    n = nodes(spark, d, "xrefs", "part")
    return G.layout(n.select("id", F.col("part").alias("group")), G.edges_from_lists(n))


def grf_view_geometry(spark, d):
    """PRJ-12, SCL-25: screen radius, rendered position and distance from the centre at a zoom of 1.5."""
    n = nodes(spark, d, "pos_x", "pos_y", "visual_radius")
    zoom = 1.5
    return n.select(
        "id",
        F.round(F.greatest(F.lit(2.0), F.least(F.lit(24.0), F.col("visual_radius") * F.sqrt(F.lit(zoom)))), 4).alias("screen_radius"),
        F.round(F.col("pos_x") * zoom, 4).alias("sx"),
        F.round(F.col("pos_y") * zoom, 4).alias("sy"),
        F.round(F.hypot("pos_x", "pos_y"), 4).alias("distance"),
    )


QUERIES = {f.__name__: f for f in (grf_edges, grf_pagerank, grf_degrees, grf_bfs_depth2, grf_one_hop, grf_one_way, grf_active_edges, grf_stored_edges, grf_nearest, grf_cluster_pull, grf_layout, grf_view_geometry)}

_FLAGS = f"""f AS (SELECT id, max(i) AS incoming, max(o) AS outgoing FROM (SELECT target AS id, false AS i, true AS o FROM e WHERE source = {ROOT} UNION ALL SELECT source, true, false FROM e WHERE target = {ROOT}) WHERE id <> {ROOT} GROUP BY id)"""
SQL = {
    "grf_edges": E + " SELECT source, target, count(*) AS n FROM e GROUP BY source, target",
    "grf_pagerank": E.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, ew AS (SELECT source, target, count(*) AS w FROM e GROUP BY ALL), dg AS (SELECT source, sum(w) AS deg FROM ew GROUP BY source), k AS (SELECT count(*) AS n FROM n),
m AS (SELECT a.id AS u, b.id AS v, 0.15 / k.n + 0.85 * CASE WHEN dg.deg IS NULL THEN 1.0 / k.n ELSE coalesce(ew.w, 0) / dg.deg END AS w FROM n a CROSS JOIN n b CROSS JOIN k LEFT JOIN dg ON dg.source = a.id LEFT JOIN ew ON ew.source = a.id AND ew.target = b.id),
pr AS (SELECT 0 AS it, id, 1.0::double / (SELECT n FROM k) AS rank FROM n UNION ALL SELECT pr.it + 1, m.v, sum(pr.rank * m.w::double) FROM pr JOIN m ON pr.id = m.u WHERE pr.it < 45 GROUP BY pr.it, m.v),
f AS (SELECT id, rank FROM pr WHERE it = 45), ind AS (SELECT target AS id, count(*) AS c FROM e GROUP BY target),
g AS (SELECT f.id, rank, (len(n.xrefs) + coalesce(ind.c, 0))::bigint AS degree, max(rank) OVER () AS top FROM f JOIN n ON n.id = f.id LEFT JOIN ind ON ind.id = f.id)
SELECT id, degree, round(rank, 8) AS pagerank, round(CASE WHEN degree = 0 THEN 0.0 ELSE rank / top * 100 END, 1) AS relative, round(2.1 + (CASE WHEN degree = 0 THEN 0.0 ELSE rank / top * 100 END) / 100 * 5.4, 2) AS radius FROM g""",
    "grf_degrees": E
    + ", i AS (SELECT target AS id, count(*) AS c, string_agg(DISTINCT source::varchar, ',' ORDER BY source::varchar) AS s, list_sort(list(DISTINCT source)) AS l FROM e GROUP BY target), o AS (SELECT source AS id, count(*) AS c FROM e GROUP BY source) SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(array_to_string(i.l, ','), '') AS incoming FROM n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id",
    "grf_bfs_depth2": E
    + f", u AS (SELECT source, target FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target), a AS (SELECT {ROOT} AS id, 0 AS depth UNION ALL SELECT target, 1 FROM u WHERE source = {ROOT} UNION ALL SELECT y.target, 2 FROM u x JOIN u y ON y.source = x.target WHERE x.source = {ROOT}) SELECT id::int AS id, min(depth)::bigint AS depth FROM a GROUP BY id",
    "grf_one_hop": E + f", {_FLAGS} SELECT id, incoming, outgoing FROM f",
    "grf_one_way": E + " SELECT DISTINCT source, target FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.source = e.target AND r.target = e.source)",
    "grf_active_edges": E + f", {_FLAGS}, k AS (SELECT id FROM f UNION SELECT {ROOT}) SELECT DISTINCT source, target FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
    "grf_stored_edges": f"WITH RECURSIVE r AS (SELECT {ROOT} AS id UNION SELECT target FROM r JOIN catechism_edges ON source = r.id) SELECT id::int AS id FROM r",
    "grf_nearest": f"WITH {N}, p AS (SELECT a.id, b.id AS near_id, sqrt((b.pos_x - a.pos_x) * (b.pos_x - a.pos_x) + (b.pos_y - a.pos_y) * (b.pos_y - a.pos_y)) AS dist FROM n a JOIN n b ON a.id <> b.id) SELECT id, near_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near_id) AS k FROM p WHERE dist < 40) WHERE k = 1",
    "grf_cluster_pull": E + f", {_FLAGS}, r AS (SELECT pos_x, pos_y FROM n WHERE id = {ROOT}) SELECT n.id, round(r.pos_x + (n.pos_x - r.pos_x) * 0.2, 6) AS x, round(r.pos_y + (n.pos_y - r.pos_y) * 0.2, 6) AS y FROM n JOIN f ON f.id = n.id CROSS JOIN r",
    "grf_view_geometry": f"WITH {N} SELECT id, round(greatest(2.0, least(24.0, visual_radius * sqrt(1.5))), 4) AS screen_radius, round(pos_x * 1.5, 4) AS sx, round(pos_y * 1.5, 4) AS sy, round(sqrt(pos_x * pos_x + pos_y * pos_y), 4) AS distance FROM n",
}
