"""More registered queries: frontier operators, traversal orders, scheduling, whole-graph numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import frontier as fr
from weftgraph.operators import messages, ranking, ricci, scheduling, structure, transforms, traversal
from weftgraph.operators.fixpoint import Query, run_batch
from weftgraph.plans import fixtures as fx
from weftgraph.plans.catalog import _SOME, BATCH, ONE, SOURCES, P, Q, _feat, _path_sql, _simple, _some, query

# -- frontiers ------------------------------------------------------------------------------------------------------------

LIGHT = "weight < 10"


@query(Q(_SOME + "SELECT src, dst, w AS weight FROM e JOIN k ON k.id = src WHERE w < 10"))
def advance(spark, d):
    return fr.advance(fx.parts(spark, d), _some(spark, d), LIGHT)


@query(Q(_SOME + "SELECT src, dst, w AS weight FROM e JOIN k ON k.id = dst"))
def advance_backward(spark, d):
    return fr.advance(fx.parts(spark, d), _some(spark, d), backward=True)


_simple("filter_predicated", "SELECT id FROM v WHERE id % 3 = 0", lambda g: fr.filtered(g.vertices, F.expr("id % 3 = 0")))
_simple("filter_remove", "SELECT id FROM v WHERE id % 3 <> 0", lambda g: fr.filtered(g.vertices, F.expr("id % 3 = 0"), "remove"))
_simple("filter_bypass", "SELECT CASE WHEN id % 3 = 0 THEN id END AS id FROM v", lambda g: fr.filtered(g.vertices, F.expr("id % 3 = 0"), "bypass"))
_simple("uniquify", "SELECT DISTINCT dst FROM e", lambda g: fr.uniquify(g.edges.select("dst")))
_simple("vertex_map", "SELECT id, id * 2 AS twice FROM v", lambda g: fr.vertex_map(g, twice=F.col("id") * 2))
_simple("pack_edges", "SELECT v.id, count(e.dst) AS n FROM v LEFT JOIN e ON e.src = v.id AND e.w < 10 GROUP BY v.id", lambda g: fr.pack_edges(g, LIGHT)[1])
_simple("neighbor_reduce", "SELECT v.id, max(e.w) AS value FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id", lambda g: fr.neighbor_reduce(g, F.col("weight"), "max"))
_simple("histogram_reduce", "SELECT src, count(*) AS n, sum(w) AS weight FROM e GROUP BY src", lambda g: fr.histogram_reduce(g.edges, "src", "weight"))
_simple("numbered_edges", "SELECT row_number() OVER (ORDER BY src, dst, w) - 1 AS eid, src, dst, w AS weight FROM e", fr.numbered_edges)
_simple("edge_budget_parts", ", k AS (SELECT v.id, count(e.dst) AS g FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT id, CAST(floor((sum(g) OVER (ORDER BY id) - g) / 500) AS BIGINT) AS part FROM k", lambda g: fr.edge_budget_parts(g, 500))
_simple("next_bucket", ", k AS (SELECT *, CAST(floor(w / 8) AS BIGINT) AS bucket FROM e) SELECT src, dst, w AS weight, bucket FROM k WHERE bucket = (SELECT min(bucket) FROM k)", lambda g: fr.next_bucket(g.edges, "weight", 8))
_simple("find_edges", ", k AS (SELECT row_number() OVER (ORDER BY src, dst, w) - 1 AS eid, src, dst, w AS weight FROM e) SELECT * FROM k WHERE eid IN (SELECT id FROM v)", lambda g: fr.find_edges(fr.numbered_edges(g), g.vertices))
_simple("set_union", "SELECT src AS id FROM e WHERE w < 5 UNION SELECT dst FROM e WHERE w >= 45", lambda g: fr.union(g.edges.where("weight < 5").selectExpr("src as id"), g.edges.where("weight >= 45").selectExpr("dst as id")))
_simple("set_difference", "SELECT DISTINCT dst AS id FROM e WHERE w < 5 AND dst NOT IN (SELECT dst FROM e WHERE w >= 45)", lambda g: fr.unvisited(g.edges.where("weight < 5").selectExpr("dst as id"), g.edges.where("weight >= 45").selectExpr("dst as id"), ["id"]).distinct())


@query(Q(_SOME + "SELECT dst AS id, min(w) AS value FROM e WHERE src IN (SELECT id FROM k) GROUP BY dst HAVING min(w) < 5"))
def edge_map_reduce(spark, d):
    return fr.edge_map_reduce(fx.parts(spark, d), _some(spark, d), F.col("weight"), "min", F.col("value") < 5)


@query(Q(_SOME + "SELECT dst AS id, count(*) AS value FROM e WHERE src IN (SELECT id FROM k) GROUP BY dst"))
def edge_map_count(spark, d):
    return fr.edge_map_count(fx.parts(spark, d), _some(spark, d))


@query(Q(_SOME + "SELECT src, dst, w AS weight FROM e WHERE src IN (SELECT id FROM k)"))
def active_subgraph(spark, d):
    return fr.active_subgraph(fx.parts(spark, d), _some(spark, d)).edges


@query(Q(_SOME + "SELECT DISTINCT dst AS id, src AS other FROM e WHERE dst IN (SELECT id FROM k)"))
def predecessors(spark, d):
    return fr.predecessors(fx.parts(spark, d), _some(spark, d))


@query(Q(_SOME + "SELECT DISTINCT src AS id, dst AS other FROM e WHERE src IN (SELECT id FROM k)"))
def successors(spark, d):
    return fr.successors(fx.parts(spark, d), _some(spark, d))


@query(Q(_SOME + "SELECT id, id IN (SELECT id FROM v) AS present FROM k"))
def has_nodes(spark, d):
    return fr.has_nodes(fx.parts(spark, d), _some(spark, d))


@query(P(f"{SOURCES},\n{_path_sql('bfs')},\ng AS (SELECT v.id, count(e.dst) AS n FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id),\n"
         "p AS (SELECT v, count(*) AS k FROM t_bfs WHERE d = 3 GROUP BY v)\n"
         "SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS pairs, count(*) AS n_vertices, CAST(coalesce(sum(k * n), 0) AS BIGINT) AS virtual_edges, CAST(coalesce(sum(n), 0) AS BIGINT) AS actual_edges FROM p JOIN g ON g.id = p.v", True))  # fmt: skip
def edge_work(spark, d):
    g = fx.parts(spark, d)
    found = run_batch(g, [Query(i, "bfs", s) for i, s in enumerate(fx.part_sources(g, BATCH))])
    return fr.edge_work(g, found.state.where("value = 3").select("query_id", "vertex"))


@query(P(f"{ONE},\n{_path_sql('bfs')},\n{_path_sql('sssp')}\nSELECT v AS vertex, a.d AS \"left\", b.d AS \"right\" FROM t_bfs a FULL JOIN t_sssp b USING (v) WHERE a.d IS DISTINCT FROM b.d", True))
def compare_results(spark, d):
    g = fx.parts(spark, d)
    s = fx.part_sources(g, 1)[0]
    state = run_batch(g, [Query(0, "bfs", s), Query(1, "sssp", s)]).state
    return fr.compare(state.where("query_id = 0"), state.where("query_id = 1"), ["vertex"], "value")


# -- scheduling -----------------------------------------------------------------------------------------------------------

BATCH_SQL = P(f"{SOURCES},\n{_path_sql('sssp')}\nSELECT q AS query_id, v AS vertex, d AS value FROM t_sssp", True)


@query(BATCH_SQL)
def shared_frontier_batch(spark, d):
    g = fx.parts(spark, d)
    return run_batch(g, [Query(i, "sssp", s) for i, s in enumerate(fx.part_sources(g, BATCH))], mode="shared").state.select("query_id", "vertex", "value")


@query(BATCH_SQL)
def separate_queries(spark, d):
    g = fx.parts(spark, d)
    return scheduling.run_separately(g, [Query(i, "sssp", s) for i, s in enumerate(fx.part_sources(g, BATCH))]).state.select("query_id", "vertex", "value")


@query()
def neighbour_groups(spark, d):
    g = fx.parts(spark, d)
    groups = scheduling.neighbour_groups(g, [Query(i, "bfs", s) for i, s in enumerate(fx.part_sources(g, 16))], 4, hub_degree=20)
    return spark.createDataFrame([(k, q.query_id, q.source) for k, b in enumerate(groups) for q in b], "batch int, query_id long, source long")


@query()
def sources_by_distance(spark, d):
    return scheduling.sources_by_distance(fx.parts(spark, d), 4)


# -- traversal ------------------------------------------------------------------------------------------------------------


@query(P(f"{SOURCES},\n{_path_sql('bfs')}\nSELECT v AS id, CAST(min(d) AS BIGINT) AS level FROM t_bfs GROUP BY v", True))
def bfs_nodes(spark, d):
    g = fx.parts(spark, d)
    return traversal.bfs_nodes(g, fx.part_sources(g, BATCH))


@query(P(f"{SOURCES},\n{_path_sql('bfs')},\nl AS (SELECT v, CAST(min(d) AS BIGINT) AS g FROM t_bfs GROUP BY v)\nSELECT min(e.src) AS src, e.dst, b.g AS level FROM e JOIN l a ON a.v = e.src JOIN l b ON b.v = e.dst WHERE b.g = a.g + 1 GROUP BY e.dst, b.g", True))
def bfs_edges(spark, d):
    g = fx.parts(spark, d)
    return traversal.bfs_edges(g, fx.part_sources(g, BATCH))


@query(f"WITH {fx.CONV_SQL} SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY src) - 1 AS step, src, dst, 'forward' AS label FROM e")
def dfs_edges(spark, d):
    nodes, edges = fx.conversations(spark, d)
    return traversal.dfs_edges(edges, nodes)


@query(f"WITH {fx.CONV_SQL}, n AS (SELECT graph_id, count(*) AS m FROM e GROUP BY graph_id), r AS (SELECT e.*, row_number() OVER (PARTITION BY graph_id ORDER BY src) - 1 AS k FROM e) "
       "SELECT graph_id, k AS step, src, dst, 'forward' AS label FROM r UNION ALL SELECT graph_id, 2 * m - 1 - k, src, dst, 'reverse' FROM r JOIN n USING (graph_id)")  # fmt: skip
def dfs_labelled_edges(spark, d):
    nodes, edges = fx.conversations(spark, d)
    starts = nodes.groupBy("graph_id").agg(F.min("id").alias("id"))
    return traversal.dfs_edges(edges, starts, labelled=True)


@query(f"WITH {fx.GEO_SQL} SELECT id, CASE WHEN id < 100 THEN 1.0 WHEN id < 1000 THEN (SELECT 1.0 * count(*) FROM e WHERE e.dst = v.id) ELSE (SELECT 1.0 * count(*) FROM e a JOIN e b ON b.dst = a.src WHERE a.dst = v.id) END::DOUBLE AS x FROM v")
def propagate_topological(spark, d):
    g = fx.geo(spark, d)
    layers = structure.topological_layers(g)
    return traversal.propagate(g.edges, g.vertices.withColumn("x", F.lit(1.0)), layers.where("layer > 0"), "x", messages.copy("u", "x"))


@query(Q(", f AS (SELECT p_partkey AS id, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part) SELECT e.dst AS id, round(avg(u.x * e.w), 6) AS h FROM e LEFT JOIN f u ON u.id = e.src JOIN f k ON k.id = e.dst WHERE k.y <= 10 GROUP BY e.dst"))
def send_and_recv(spark, d):
    sent = traversal.send(fx.parts(spark, d).edges, _feat(spark, d), messages.binary("mul", "u", "x", "e", "weight"))
    return traversal.recv(sent, _some(spark, d), "mean").select("id", F.round("h", 6).alias("h"))


# -- whole graphs ---------------------------------------------------------------------------------------------------------


@query(f"WITH {fx.GEO_SQL} SELECT v.id, CASE WHEN v.id BETWEEN 100 AND 999 THEN 0.5 * (SELECT count(*) FROM e WHERE e.src = v.id) * (SELECT count(*) FROM e WHERE e.dst = v.id) ELSE 0 END::DOUBLE AS bc FROM v")
def betweenness_all(spark, d):
    return structure.betweenness_all(fx.geo(spark, d))


@query()
def ppr_batch(spark, d):
    g = fx.parts(spark, d)
    return ranking.personalized_pagerank(g, fx.part_sources(g, BATCH), epsilon=1e-3)


@query()
def ricci_communities(spark, d):
    labels, quality = ricci.ricci_communities(fx.parts(spark, d), 2)
    return labels.select("id", "component", F.round(F.lit(quality), 9).alias("modularity"))


@query()
def laplacian_lambda_max(spark, d):
    value = transforms.laplacian_lambda_max(fx.geo(spark, d))
    return spark.createDataFrame([(round(value, 6),)], "lambda_max double")


@query("SELECT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) + (SELECT max(p_partkey) + 1 FROM part) AS dst FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def homogeneous_graph(spark, d):
    parts = fx.table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    suppliers = fx.table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    out = transforms.to_homogeneous({("part", "from", "supplier"): fx.part_suppliers(spark, d)}, {"part": parts, "supplier": suppliers})
    return out.select("src", "dst")
