"""Registered queries of subgraphs, masks, user functions, cross reductions, readouts, masked products and dense products."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import frontier as fr
from weftgraph.operators import linear, messages, sampling, transforms, traversal
from weftgraph.operators.loop import Reached
from weftgraph.plans import fixtures as fx
from weftgraph.plans.catalog import _SOME, BATCH, FEAT, NODES, SOURCES, P, Q, _draw, _feat, _path_sql, _simple, _some, _turns, query
from weftgraph.sources import generators

NUMBERED = ", k AS (SELECT row_number() OVER (ORDER BY src, dst, w) - 1 AS eid, src, dst, w AS weight FROM e) "

# -- subgraphs and edges --------------------------------------------------------------------------------------------------

_simple("edge_subgraph", NUMBERED + "SELECT src, dst, weight FROM k WHERE eid IN (SELECT id FROM v)", lambda g: g.edge_subgraph(fr.numbered_edges(g), g.vertices).edges)
_simple("filter_edges", NUMBERED + "SELECT eid FROM k WHERE weight < 10", lambda g: fr.filter_edges(fr.numbered_edges(g), "weight < 10"))
_simple("edge_ids", NUMBERED + "SELECT r.dst AS src, r.src AS dst, k.eid FROM (SELECT DISTINCT src, dst FROM e) r LEFT JOIN k ON k.src = r.dst AND k.dst = r.src", lambda g: fr.edge_ids(fr.numbered_edges(g), g.reverse().edges))
_simple("without_self_loops", "SELECT src, dst, w AS weight FROM e", lambda g: g.with_self_loops().without_self_loops().edges)
_simple("common_neighbour_rows", "SELECT a.src, b.src AS dst, a.dst AS common FROM e k JOIN e a ON a.src = k.src JOIN e b ON b.src = k.dst AND b.dst = a.dst", lambda g: g.common_neighbour_rows(g.edges))
_simple("add_weights", f"SELECT src, dst, CAST(1 + floor({_draw(7, 'src', 'dst')} * 32) AS DOUBLE) AS weight FROM e", lambda g: transforms.add_weights(g.edges, 1, 32, 7))


@query(Q("SELECT EXISTS (SELECT 1 FROM e GROUP BY src, dst HAVING count(*) > 1) AS once, EXISTS (SELECT 1 FROM (SELECT src, dst FROM e UNION ALL SELECT src, dst FROM e) GROUP BY src, dst HAVING count(*) > 1) AS twice"))
def is_multigraph(spark, d):
    g = fx.parts(spark, d)
    return spark.createDataFrame([(g.is_multigraph(), g._with(g.edges.unionByName(g.edges)).is_multigraph())], "once boolean, twice boolean")


@query("SELECT 'sells' AS kind, l_suppkey AS src, l_partkey AS dst FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def type_subgraph(spark, d):
    made = fx.part_suppliers(spark, d)
    nation = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"))
    tables = {("supplier", "sells", "part"): made.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ("supplier", "of", "nation"): nation}
    (key, rows), *rest = transforms.type_subgraph(tables, node_types=["supplier", "part"]).items()
    assert not rest
    return rows.select(F.lit(key[1]).alias("kind"), "src", "dst")


@query(Q(_SOME + "SELECT n.src, n.dst, n.w AS weight FROM e a JOIN e n ON n.src = a.dst WHERE a.src IN (SELECT id FROM k)"))
def advance_edges(spark, d):
    g = fx.parts(spark, d)
    return fr.advance_edges(g, fr.advance(g, _some(spark, d)))


@query(Q(_SOME + "SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM k)"))
def advance_vertices(spark, d):
    return fr.advance_vertices(fx.parts(spark, d), _some(spark, d))


@query("SELECT l_partkey AS vertex, CAST(floor(l_suppkey / 32) AS BIGINT) AS word, bit_or(CAST(1 AS BIGINT) << CAST(l_suppkey % 32 AS INTEGER)) AS mask FROM lineitem GROUP BY 1, 2")
def query_masks(spark, d):
    return fr.query_masks(fx.part_suppliers(spark, d).select(F.col("dst").alias("query_id"), F.col("src").alias("vertex")))


@query(Q(_SOME + ", p AS (SELECT id, min(w) AS pr FROM (SELECT src AS id, w FROM e) GROUP BY id) SELECT id, CASE WHEN id IN (SELECT id FROM k) THEN 0.5 ELSE pr END::DOUBLE AS value, CAST(floor(CASE WHEN id IN (SELECT id FROM k) THEN 0.5 ELSE pr END / 8) AS BIGINT) AS bucket FROM p FULL JOIN (SELECT id FROM k) USING (id)"))
def update_buckets(spark, d):
    rows = fx.parts(spark, d).edges.groupBy(F.col("src").alias("id")).agg(F.min("weight").alias("value"))
    return fr.update_buckets(rows, _some(spark, d).withColumn("value", F.lit(0.5)), "id", "value", 8)


# -- messages -------------------------------------------------------------------------------------------------------------


@query(Q(FEAT + "SELECT e.src, e.dst, e.w AS weight, round(CASE WHEN u.y > v.y THEN u.x * e.w ELSE v.x END, 6) AS m FROM e JOIN f u ON u.id = e.src JOIN f v ON v.id = e.dst"))
def user_message(spark, d):
    out = messages.map_edges(fx.parts(spark, d).edges, lambda b: (b["u_x"] * b["weight"]).where(b["u_y"] > b["v_y"], b["v_x"]), _feat(spark, d))
    return out.withColumn("m", F.round("m", 6))


@query(Q(FEAT + "SELECT e.dst AS id, round(max(u.x) - min(u.x), 6) AS h FROM e JOIN f u ON u.id = e.src GROUP BY e.dst"))
def user_reduce(spark, d):
    return messages.mailbox_reduce(fx.parts(spark, d).edges, _feat(spark, d), messages.copy("u", "x"), lambda m: m.max() - m.min()).select("id", F.round("h", 6).alias("h"))


@query(Q(FEAT + "SELECT e.dst AS id, round(sum(u.y * u.y), 6) AS h FROM e JOIN f u ON u.id = e.src GROUP BY e.dst"))
def user_reduce_merged(spark, d):
    # parts of 8 messages, so that many mailboxes are cut
    out = messages.mailbox_reduce(fx.parts(spark, d).edges, _feat(spark, d), messages.copy("u", "y"), lambda m: (m * m).sum(), merge=lambda m: m.sum(), box=8)
    return out.select("id", F.round("h", 6).alias("h"))


@query(Q(FEAT + "SELECT f.id, round(coalesce(k.h, f.y), 6) AS h FROM f LEFT JOIN (SELECT e.dst, sum(u.x) AS h FROM e JOIN f u ON u.id = e.src GROUP BY e.dst) k ON k.dst = f.id"))
def keep_old_feature(spark, d):
    return messages.update_all(fx.parts(spark, d).edges, _feat(spark, d), messages.copy("u", "x"), default=F.col("y")).select("id", F.round("h", 6).alias("h"))


@query(Q(FEAT + "SELECT f.id, round(k.h, 6) AS h FROM f LEFT JOIN (SELECT e.dst, product(u.y / 20) AS h FROM e JOIN f u ON u.id = e.src GROUP BY e.dst) k ON k.dst = f.id"))
def copy_u_prod(spark, d):
    nodes = _feat(spark, d).withColumn("y", F.col("y") / 20)
    return messages.update_all(fx.parts(spark, d).edges, nodes, messages.copy("u", "y"), "prod").select("id", F.round("h", 6).alias("h"))


TWO_TYPES = FEAT + ", h AS (SELECT e.dst AS id, 0 AS k, sum(u.x) AS h FROM e JOIN f u ON u.id = e.src GROUP BY 1 UNION ALL SELECT e.src, 1, max(u.y) FROM e JOIN f u ON u.id = e.dst GROUP BY 1) "


def _cross(spark, d, cross: str):
    g, f = fx.parts(spark, d), _feat(spark, d)
    return messages.multi_update_all([(g.edges, f, messages.copy("u", "x"), "sum"), (g.reverse().edges, f, messages.copy("u", "y"), "max")], cross)


for _r, _a in (("min", "min"), ("max", "max"), ("mean", "avg")):
    query(Q(TWO_TYPES + f"SELECT id, round({_a}(h), 6) AS h FROM h GROUP BY id"), f"multi_update_{_r}")(lambda spark, d, r=_r: _cross(spark, d, r).select("id", F.round("h", 6).alias("h")))


@query(Q(TWO_TYPES + "SELECT id, round(h[1], 6) AS first, CASE WHEN len(h) > 1 THEN round(h[2], 6) END AS second FROM (SELECT id, list(h ORDER BY k) AS h FROM h GROUP BY id)"))
def multi_update_stack(spark, d):
    return _cross(spark, d, "stack").select("id", F.round(F.get("h", F.lit(0)), 6).alias("first"), F.round(F.get("h", F.lit(1)), 6).alias("second"))


@query(f"SELECT graph_id, id, x, round(sum(x) OVER (PARTITION BY graph_id), 6) AS total FROM ({NODES})")
def readout_broadcast(spark, d):
    t = _turns(spark, d)
    return messages.broadcast_readout(t, messages.readout(t, "x").withColumnRenamed("x", "total")).select("graph_id", "id", "x", F.round("total", 6).alias("total"))


@query(f"SELECT graph_id, round(sum(x * (id + 1)) / sum(id + 1), 6) AS x FROM ({NODES}) GROUP BY graph_id")
def readout_weighted_mean(spark, d):
    t = _turns(spark, d).withColumn("w", F.col("id") + 1)
    return messages.readout(t, "x", "mean", weight="w").select("graph_id", F.round("x", 6).alias("x"))


LEVELS = f"{SOURCES},\n{_path_sql('bfs')},\nl AS (SELECT v AS id, CAST(min(d) AS BIGINT) AS level FROM t_bfs GROUP BY v)"


@query(P(f"{LEVELS}\nSELECT id, level FROM l", True))
def fixpoint_class(spark, d):
    g = fx.parts(spark, d)
    return Reached(g, spark.createDataFrame([(s,) for s in fx.part_sources(g, BATCH)], "id long")).run()


# a vertex beyond the sources hears from the level before its own, so its value is its level
@query(P(f"{LEVELS}\nSELECT v.id, coalesce(l.level, 0)::DOUBLE AS x FROM v LEFT JOIN l USING (id)", True))
def propagate_breadth_first(spark, d):
    g = fx.parts(spark, d)
    sources = fx.part_sources(g, BATCH)
    levels = traversal.bfs_nodes(g, sources).select("id", F.col("level").alias("layer"))
    down = traversal.bfs_edges(g, sources).select("src", "dst")
    return traversal.propagate(down, g.vertices.withColumn("x", F.lit(0.0)), levels.where("layer > 0"), "x", messages.copy("u", "x") + 1, "max")


# -- products -------------------------------------------------------------------------------------------------------------


def _entries(g):
    return g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("val"))


@query(Q(_SOME + "SELECT id AS idx, round(sum(val), 6) AS val FROM (SELECT e.dst AS id, e.w * p_retailprice AS val FROM e JOIN part ON p_partkey = e.src WHERE e.dst NOT IN (SELECT id FROM k) UNION ALL SELECT id, 1.0 FROM k) GROUP BY id"))
def mxv_masked_accum(spark, d):
    some = _some(spark, d).select(F.col("id").alias("idx"))
    vector = fx.table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("val"))
    out = linear.spmv(_entries(fx.parts(spark, d)), vector, mask=some, complement=True, transposed=True, accum=some.withColumn("val", F.lit(1.0)))
    return out.select("idx", F.round("val", 6).alias("val"))


@query(Q("SELECT row, col, min(val) AS val FROM (SELECT a.dst AS row, b.dst AS col, a.w + b.w AS val FROM e a JOIN e b ON a.src = b.src WHERE (a.dst, b.dst) NOT IN (SELECT (src, dst) FROM e) UNION ALL SELECT src, dst, w FROM e) GROUP BY 1, 2"))
def mxm_complement_accum(spark, d):
    a = _entries(fx.parts(spark, d))
    return linear.mxm(a, a, "min_plus", mask=a, complement=True, transposed=(True, False), accum=a)


@query("WITH b(i, x, y, z) AS (VALUES (0, 1.0, 0.5, 0.0), (1, -2.0, 0.0, 3.0)) SELECT p_partkey AS row, round(2 * (p_retailprice * 1.0 + p_size * -2.0) + 0.5, 6) AS x, round(2 * (p_retailprice * 0.5) + 0.5, 6) AS y, round(2 * (p_size * 3.0) + 0.5, 6)::DOUBLE AS z FROM part")
def gemm(spark, d):
    a = fx.table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.array("p_retailprice", F.col("p_size").cast("double")).alias("vals"))
    b = spark.createDataFrame([(0, [1.0, 0.5, 0.0]), (1, [-2.0, 0.0, 3.0])], "idx long, vals array<double>")
    out = linear.gemm(a, b, 3, alpha=2.0, beta=0.5, c=a.select("row", F.array_repeat(F.lit(1.0), 3).alias("vals")))
    return out.select("row", *[F.round(F.col("vals")[k], 6).alias(n) for k, n in enumerate("xyz")])


@query("WITH b AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem) SELECT g AS \"group\", count(s_suppkey) AS value FROM b LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = m GROUP BY g")
def hyperedge_counts(spark, d):
    active = fx.table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return transforms.hyperedge_counts(fx.table(spark, d, "lineitem"), active, "l_orderkey", "l_suppkey")


# -- sampling and neighbours ----------------------------------------------------------------------------------------------

SIDES = f"""c AS (SELECT 0 AS side, src, dst, w FROM e UNION ALL SELECT 1, dst, src, w FROM e),
s AS (SELECT *, sum(w) OVER (PARTITION BY side, src ORDER BY dst) AS hi, sum(w) OVER (PARTITION BY side, src) AS total FROM c),
r AS (SELECT side, src, dst, (hi - w) / total AS lo, hi / total AS hi FROM s),
k(walk, step, cur, trace) AS (
  SELECT id, 0, id, [id] FROM v UNION ALL
  SELECT walk, step + 1, coalesce(r.dst, -1), list_append(trace, coalesce(r.dst, -1)) FROM k
  LEFT JOIN r ON r.side = step % 2 AND r.src = k.cur AND {_draw(1, 'walk', 'step')} > r.lo AND {_draw(1, 'walk', 'step')} <= r.hi WHERE step < 4)"""


@query(P(SIDES + "\nSELECT walk, [trace[1], trace[3], trace[5]] AS trace FROM k WHERE step = 4", True))
def one_sided_walk(spark, d):
    g = fx.parts(spark, d)
    return sampling.one_sided_walk(g.edges, g.vertices.selectExpr("id as walk", "id"), 2, weight="weight", seed=1)


def _layer(k: int, at: str, size: int) -> str:
    return f"SELECT src FROM (SELECT src, count(*) AS n FROM e WHERE dst IN ({at}) GROUP BY src) ORDER BY -ln({_draw(1, str(k), 'src')}) / n, src LIMIT {size}"


@query(Q(_SOME + f", a AS ({_layer(0, 'SELECT id FROM k', 200)}), b AS ({_layer(1, 'SELECT src FROM a', 100)}) SELECT 0 AS layer, src, dst FROM e WHERE dst IN (SELECT id FROM k) AND src IN (SELECT src FROM a) "
         "UNION ALL SELECT 1, src, dst FROM e WHERE dst IN (SELECT src FROM a) AND src IN (SELECT src FROM b)"))  # fmt: skip
def layer_flow(spark, d):
    return sampling.layer_flow(fx.parts(spark, d).edges, _some(spark, d), [200, 100], seed=1)


@query(Q(f", t AS (SELECT p_partkey AS id, p_size AS w, sum(p_size) OVER (ORDER BY p_partkey) AS hi FROM part), x AS (SELECT src, {_draw(2, 'src', 'dst', '0')} * (SELECT max(hi) FROM t) AS x FROM e) "
         "SELECT DISTINCT x.src, t.id AS dst FROM x JOIN t ON x.x >= t.hi - t.w AND x.x < t.hi WHERE (x.src, t.id) NOT IN (SELECT (src, dst) FROM e)"))  # fmt: skip
def weighted_negative_edges(spark, d):
    weights = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return sampling.negative_edges(fx.parts(spark, d).edges, weights, 1, seed=2, weight="p_size")


def _distance(n: int) -> str:
    return " + ".join(f"(a.v[{i}] - b.v[{i}])::DOUBLE * (a.v[{i}] - b.v[{i}])::DOUBLE" for i in range(1, n + 1))


@query(f"WITH p AS (SELECT p_partkey AS id, p_size % 10 AS s, [p_retailprice, CAST(p_size AS DOUBLE)] AS v FROM part) SELECT src, dst, round(dist2, 6) AS dist2 FROM "
       f"(SELECT b.id AS src, a.id AS dst, {_distance(2)} AS dist2, row_number() OVER (PARTITION BY a.id ORDER BY {_distance(2)}, b.id) AS r FROM p a JOIN p b USING (s)) WHERE r <= 3")  # fmt: skip
def segmented_knn(spark, d):
    points = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("s"), F.array("p_retailprice", F.col("p_size").cast("double")).alias("vec"))
    return generators.knn_graph(points, 3, segment="s").select("src", "dst", F.round("dist2", 6).alias("dist2"))
