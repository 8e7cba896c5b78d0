"""The registered queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import haversine, midpoint
from weftgraph.graph import Graph, csr_to_coo
from weftgraph.operators import fixpoint, geo, linear, messages, ranking, ricci, sampling, structure, transforms
from weftgraph.operators.fixpoint import Query, run_batch
from weftgraph.plans import fixtures as fx
from weftgraph.plans.prefix import dense_ids
from weftgraph.plans.scratch import drop_dir, materialize, shared_dir
from weftgraph.sources import files, generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return register


def P(rest: str, recursive: bool = False) -> str:  # noqa: N802
    return f"WITH {'RECURSIVE ' if recursive else ''}{fx.PARTS_SQL},\n{rest}"


def Q(rest: str) -> str:  # noqa: N802
    return f"WITH {fx.PARTS_SQL}\n{rest}"


# -- batches of path queries ------------------------------------------------------------------------------------------

BATCH = 4
SOURCES = f"s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS q FROM v ORDER BY id LIMIT {BATCH})"


def _path_sql(kind: str, edges: str = "e", sources: str = SOURCES) -> str:
    """t_<kind>(q, v, d): one recursive table keyed by query and vertex."""
    start, step, agg, better = {
        "bfs": ("0.0", "t.d + 1", "min", "<"), "sssp": ("0.0", "t.d + e.w", "min", "<"), "sswp": ("CAST('inf' AS DOUBLE)", "least(t.d, e.w)", "max", ">"),
        "ssnp": ("0.0", "greatest(t.d, e.w)", "min", "<"), "viterbi": ("1.0", "t.d / e.w", "max", ">"),
    }[kind]
    return f"""t_{kind}(q, v, d) USING KEY (q, v) AS (
  SELECT q, id, CAST({start} AS DOUBLE) FROM s
  UNION (SELECT t.q, e.dst, {agg}({step}) FROM t_{kind} t JOIN {edges} e ON t.v = e.src LEFT JOIN recurring.t_{kind} r ON r.q = t.q AND r.v = e.dst
         WHERE r.d IS NULL OR {step} {better} r.d GROUP BY t.q, e.dst))"""


WCC_SQL = """w(v, d) USING KEY (v) AS (
  SELECT id, id FROM v UNION (SELECT n.dst, min(w.d) FROM w JOIN n ON w.v = n.src LEFT JOIN recurring.w r ON r.v = n.dst WHERE w.d < r.d GROUP BY n.dst))"""


def _batch(spark: SparkSession, d: str, kind: str, **options) -> DataFrame:
    g = fx.parts(spark, d, missing=float("inf") if kind == "sswp" else 1.0)  # least() skips a null in the SQL
    batch = [Query(i, kind, s) for i, s in enumerate(fx.part_sources(g, BATCH))]
    if not batch:  # no edge, so no source
        return spark.createDataFrame([], "query_id long, vertex long, value double")
    found = run_batch(g, batch, **options)
    return found.state.select("query_id", "vertex", "value")


def _register_paths() -> None:
    for kind in ("bfs", "sssp", "sswp", "ssnp", "viterbi"):
        value = "round(d, 12)" if kind == "viterbi" else "d"
        sql = P(f"{SOURCES},\n{_path_sql(kind)}\nSELECT q AS query_id, v AS vertex, {value} AS value FROM t_{kind}", True)
        for mode in ("hybrid", "push", "pull") if kind in ("bfs", "sssp") else ("hybrid",):
            name = f"batch_{kind}" if mode == "hybrid" else f"batch_{kind}_{mode}"

            def run(spark, d, kind=kind, mode=mode):
                out = _batch(spark, d, kind, mode=mode)
                return out.withColumn("value", F.round("value", 12)) if kind == "viterbi" else out

            query(sql, name)(run)


_register_paths()
ONE = "s AS (SELECT min(id) AS id, 0 AS q FROM v)"


@query(P(f"{ONE},\n{_path_sql('bfs')}\nSELECT v AS vertex, CAST(d AS BIGINT) AS level FROM t_bfs", True))
def bfs(spark, d):
    g = fx.parts(spark, d)
    return run_batch(g, [Query(0, "bfs", fx.part_sources(g, 1)[0])]).state.select("vertex", F.col("value").cast("long").alias("level"))


@query(P(f"{ONE},\n{_path_sql('sssp')}\nSELECT v AS vertex, d AS distance FROM t_sssp", True))
def sssp(spark, d):
    g = fx.parts(spark, d)
    return run_batch(g, [Query(0, "sssp", fx.part_sources(g, 1)[0])]).state.select("vertex", F.col("value").alias("distance"))


MIXED = P(
    f"{fx.UNDIRECTED_SQL},\n{SOURCES},\n{_path_sql('bfs')},\n{_path_sql('sssp')},\n{WCC_SQL}\n"
    f"SELECT CASE WHEN q < 2 THEN q END AS query_id, v AS vertex, d AS value FROM t_bfs WHERE q < 2 UNION ALL SELECT q, v, d FROM t_sssp WHERE q >= 2 UNION ALL SELECT 4, v, CAST(d AS DOUBLE) FROM w", True)  # fmt: skip


def _mixed(spark, d, **options):
    g = fx.parts(spark, d)
    s = fx.part_sources(g, BATCH)
    batch = [Query(0, "bfs", s[0]), Query(1, "bfs", s[1]), Query(2, "sssp", s[2]), Query(3, "sssp", s[3]), Query(4, "wcc")]
    return run_batch(g, batch, **options)


@query(MIXED)
def heterogeneous_batch(spark, d):
    return _mixed(spark, d).state.select("query_id", "vertex", "value")


@query(MIXED)
def replenish_queue(spark, d):
    return _mixed(spark, d, slots=2).state.select("query_id", "vertex", "value")


@query(MIXED)
def delayed_start_batch(spark, d):
    return _mixed(spark, d, start_level={0: 2, 1: 0, 2: 1, 3: 3}).state.select("query_id", "vertex", "value")


@query(P(f"{ONE},\n{_path_sql('bfs')}\nSELECT 0 AS query_id, 'bfs' AS kind, (SELECT id FROM s) AS source, CAST(max(d) AS INTEGER) AS completion_level, TRUE AS completed FROM t_bfs", True))
def query_completion(spark, d):
    g = fx.parts(spark, d)
    q = [Query(0, "bfs", fx.part_sources(g, 1)[0])]
    return run_batch(g, q).results(spark, q)


@query(P(f"{ONE},\n{_path_sql('bfs')}\nSELECT CAST(d AS INTEGER) AS iteration, count(*) AS frontier_size, count(*) AS unique_frontier_size, 1 AS active_queries FROM t_bfs GROUP BY d", True))
def iteration_profile(spark, d):
    g = fx.parts(spark, d)
    q = [Query(0, "bfs", fx.part_sources(g, 1)[0])]
    return run_batch(g, q, profile=True).profile_table(spark).select("iteration", "frontier_size", "unique_frontier_size", "active_queries")


@query(P(f"{ONE},\n{_path_sql('bfs')}\nSELECT e.dst AS vertex, min(e.src) AS parent FROM e JOIN t_bfs a ON a.v = e.src JOIN t_bfs b ON b.v = e.dst WHERE b.d = a.d + 1 GROUP BY e.dst", True))
def bfs_parents(spark, d):
    g = fx.parts(spark, d)
    found = run_batch(g, [Query(0, "bfs", fx.part_sources(g, 1)[0])])
    return fixpoint.parents(g, found).select("vertex", "parent")


@query(P(f"{SOURCES},\n{_path_sql('bfs')},\nk AS (SELECT v, count(*) AS n FROM t_bfs GROUP BY v)\nSELECT q AS query_id, count(*) AS n_reached, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_shared FROM t_bfs JOIN k USING (v) GROUP BY q", True))
def query_overlap(spark, d):
    g = fx.parts(spark, d)
    return fixpoint.overlap(run_batch(g, [Query(i, "bfs", s) for i, s in enumerate(fx.part_sources(g, BATCH))]))


HUBS = "s AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) - 1 AS q FROM (SELECT id, count(e.dst) AS n FROM v LEFT JOIN e ON e.src = v.id GROUP BY id) ORDER BY n DESC, id LIMIT 4)"


@query(P(f"{HUBS},\nb AS (SELECT dst AS src, src AS dst, w FROM e),\n{_path_sql('bfs', 'b')}\nSELECT v AS id, CAST(min(d) AS BIGINT) AS hops FROM t_bfs GROUP BY v", True))
def hops_to_hubs(spark, d):
    return fixpoint.hops_to_hubs(fx.parts(spark, d), 4)


@query()
def affinity_batches(spark, d):
    g = fx.parts(spark, d)
    groups = fixpoint.affinity_batches(g, [Query(i, "bfs", s) for i, s in enumerate(fx.part_sources(g, 8))], 4)
    return spark.createDataFrame([(k, q.query_id, q.source) for k, b in enumerate(groups) for q in b], "batch int, query_id long, source long")


@query(P(f"{SOURCES},\n{_path_sql('bfs')}\nSELECT v AS id, CAST(max(d) AS BIGINT) AS radius FROM t_bfs GROUP BY v", True))
def radii(spark, d):
    g = fx.parts(spark, d)
    return structure.radii(g, fx.part_sources(g, BATCH))


@query(P(f"{ONE},\n{_path_sql('sssp')}\nSELECT v AS id, d AS dist FROM t_sssp", True))
def bellman_ford(spark, d):
    g = fx.parts(spark, d)
    return structure.bellman_ford(g, fx.part_sources(g, 1)[0])[0]


@query(P(f"{fx.UNDIRECTED_SQL},\n{WCC_SQL}\nSELECT v AS id, d AS component FROM w", True))
def connected_components(spark, d):
    return structure.components(fx.parts(spark, d))


@query(f"WITH RECURSIVE {fx.GEO_SQL}, {fx.UNDIRECTED_SQL},\n{WCC_SQL}\nSELECT v AS vertex, CAST(d AS DOUBLE) AS value, d AS label FROM w")
def batch_wcc(spark, d):
    return run_batch(fx.geo(spark, d), [Query(0, "wcc")]).state.select("vertex", "value", "label")


@query(P("""l(v, d) USING KEY (v) AS (
  SELECT id, id FROM v UNION (SELECT e.dst, min(l.d) FROM l JOIN e ON l.v = e.src LEFT JOIN recurring.l r ON r.v = e.dst WHERE l.d < r.d GROUP BY e.dst))
SELECT v AS vertex, CAST(d AS DOUBLE) AS value FROM l""", True))
def directed_labels(spark, d):
    return run_batch(fx.parts(spark, d), [Query(0, "labels")]).state.select("vertex", "value")


# -- rankings -----------------------------------------------------------------------------------------------------------


def _pagerank_sql(steps: int, weighted: bool = True) -> str:
    w = "w" if weighted else "1.0"
    parts = [f"o AS (SELECT src, sum({w}) AS o FROM e GROUP BY src), k AS (SELECT count(*) AS n FROM v), p0 AS (SELECT id, 1.0 / (SELECT n FROM k) AS p FROM v)"]
    for i in range(steps):
        parts.append(f"""p{i + 1} AS MATERIALIZED (SELECT v.id, (0.15 + 0.85 * (SELECT coalesce(sum(p), 0) FROM p{i} WHERE id NOT IN (SELECT src FROM o))) / (SELECT n FROM k) + 0.85 * coalesce(g.s, 0) AS p
  FROM v LEFT JOIN (SELECT e.dst, sum(p * {w} / o.o) AS s FROM e JOIN o ON o.src = e.src JOIN p{i} ON p{i}.id = e.src GROUP BY e.dst) g ON g.dst = v.id)""")
    return P(",\n".join(parts) + f"\nSELECT id, round(p, 10) AS rank FROM p{steps}")


@query(_pagerank_sql(8))
def pagerank(spark, d):
    return ranking.pagerank_steps(fx.parts(spark, d), 0.85, 8).select("id", F.round("rank", 10).alias("rank"))


@query()
def pagerank_sweep(spark, d):
    return ranking.pagerank_sweep(fx.parts(spark, d), [(a, t) for a in (0.5, 0.85) for t in (1e-3, 1e-5)], 40)[1]


def _delta_sql(steps: int) -> str:
    parts = ["o AS (SELECT src, count(*) AS o FROM e GROUP BY src), d0 AS (SELECT id, CAST(0 AS DOUBLE) AS p, 1.0 - CAST(0.85 AS DOUBLE) AS r FROM v)"]
    for i in range(steps):
        parts.append(f"""d{i + 1} AS MATERIALIZED (SELECT a.id, CASE WHEN a.r > 0.01 THEN a.p + a.r ELSE a.p END AS p, CASE WHEN a.r > 0.01 THEN 0 ELSE a.r END + coalesce(g.s, 0) AS r
  FROM d{i} a LEFT JOIN (SELECT e.dst, sum(b.r * 0.85 / o.o) AS s FROM e JOIN o ON o.src = e.src JOIN d{i} b ON b.id = e.src WHERE b.r > 0.01 GROUP BY e.dst) g ON g.dst = a.id)""")
    return P(",\n".join(parts) + f"\nSELECT id, round(p, 9) AS rank FROM d{steps}")


@query(_delta_sql(6))
def delta_pagerank(spark, d):
    return ranking.delta_pagerank(fx.parts(spark, d), max_iterations=6, partial=True).select("id", F.round("rank", 9).alias("rank"))


@query()
def personalized_pagerank(spark, d):
    g = fx.parts(spark, d)
    return ranking.personalized_pagerank(g, fx.part_sources(g, 2))


def _hits_sql(steps: int) -> str:
    parts = ["h0 AS (SELECT id, 1.0 AS h, 1.0 AS a FROM v)"]
    for i in range(steps):
        parts.append(f"""a{i + 1} AS MATERIALIZED (SELECT e.dst AS id, sum(h) AS a FROM e JOIN h{i} ON h{i}.id = e.src GROUP BY e.dst),
r{i + 1} AS MATERIALIZED (SELECT v.id, coalesce(x.h, 0) AS h, coalesce(a{i + 1}.a, 0) AS a FROM v LEFT JOIN a{i + 1} ON a{i + 1}.id = v.id LEFT JOIN (SELECT e.src AS id, sum(a) AS h FROM e JOIN a{i + 1} ON a{i + 1}.id = e.dst GROUP BY e.src) x ON x.id = v.id),
h{i + 1} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM r{i + 1}) AS h, a / (SELECT sqrt(sum(a * a)) FROM r{i + 1}) AS a FROM r{i + 1})""")
    return P(",\n".join(parts) + f"\nSELECT id, round(h, 9) AS hub, round(a, 9) AS authority FROM h{steps}")


@query(_hits_sql(4))
def hits(spark, d):
    return ranking.hits(fx.parts(spark, d), 4).select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


@query(_hits_sql(4).rsplit("SELECT id,", 1)[0] + "SELECT id, row_number() OVER (ORDER BY round(h, 9) DESC, id) AS hub_rank, row_number() OVER (ORDER BY round(a, 9) DESC, id) AS authority_rank FROM h4")
def hits_ranking(spark, d):
    scores = ranking.hits(fx.parts(spark, d), 4).select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))
    return ranking.hits_ranking(scores).select("id", "hub_rank", "authority_rank")


# -- structure ----------------------------------------------------------------------------------------------------------


@query(P("u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), k AS (SELECT unnest([a, b, c]) AS id FROM t)\nSELECT v.id, count(k.id) AS triangles FROM v LEFT JOIN k ON k.id = v.id GROUP BY v.id"))
def triangle_count(spark, d):
    return structure.triangles(fx.parts(spark, d))


@query()
def kcore(spark, d):
    return structure.kcore(fx.parts(spark, d))


@query()
def mst_weight(spark, d):
    return structure.spanning_forest(fx.parts(spark, d)).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_edges"))


@query()
def coloring(spark, d):
    return structure.coloring(fx.parts(spark, d))


TWO = "s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS q FROM v ORDER BY id LIMIT 2)"


@query(P(f"""{TWO},\n{_path_sql('bfs')},
g(q, v, l, sigma) AS (SELECT q, id, 0, CAST(1 AS DOUBLE) FROM s UNION ALL
  SELECT g.q, e.dst, g.l + 1, sum(g.sigma) FROM g JOIN e ON e.src = g.v JOIN t_bfs b ON b.q = g.q AND b.v = e.dst AND b.d = g.l + 1 GROUP BY g.q, e.dst, g.l),
z(q, v, l, delta) AS (SELECT g.q, g.v, g.l, CAST(0 AS DOUBLE) FROM g JOIN (SELECT q, max(l) AS m FROM g GROUP BY q) x ON x.q = g.q AND x.m = g.l UNION ALL
  SELECT p.q, p.v, p.l, coalesce(sum(p.sigma / k.sigma * (1 + c.delta)), 0) FROM g p JOIN (SELECT DISTINCT q, l FROM z) y ON y.q = p.q AND p.l = y.l - 1
  LEFT JOIN e ON e.src = p.v LEFT JOIN z c ON c.q = p.q AND c.v = e.dst LEFT JOIN g k ON k.q = c.q AND k.v = c.v GROUP BY p.q, p.v, p.l)
SELECT v.id, round(coalesce(t.bc, 0), 8) AS bc FROM v LEFT JOIN (SELECT v, sum(delta) * 0.5 AS bc FROM z WHERE l > 0 GROUP BY v) t ON t.v = v.id""", True))
def betweenness(spark, d):
    g = fx.parts(spark, d)
    return structure.betweenness(g, fx.part_sources(g, 2)).select("id", F.round("bc", 8).alias("bc"))


def _brands(spark, d) -> DataFrame:
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("component"))


@query(Q(", o AS (SELECT v.id, count(e.dst) AS k, any_value(p_brand) AS c FROM v JOIN part ON p_partkey = v.id LEFT JOIN e ON e.src = v.id GROUP BY v.id), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e)\nSELECT round(sum(CASE WHEN a.c = b.c THEN 1 - a.k * b.k / m ELSE 0 END) / any_value(m), 12) AS q FROM e JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst, m"))
def modularity(spark, d):
    return spark.createDataFrame([(structure.modularity(fx.parts(spark, d), _brands(spark, d)),)], "q double").select(F.round("q", 12).alias("q"))


@query(f"WITH RECURSIVE {fx.GEO_SQL}, r AS (SELECT id, 0 AS l FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.l + 1 FROM r JOIN e ON e.src = r.id)\nSELECT id, CAST(max(l) AS INTEGER) AS layer FROM r GROUP BY id")
def topological_layers(spark, d):
    return structure.topological_layers(fx.geo(spark, d))


@query(P(f"""{fx.UNDIRECTED_SQL}, u AS (SELECT src AS a, dst AS b FROM n WHERE src < dst), dg AS (SELECT src, count(*) AS k FROM n GROUP BY src),
t AS (SELECT u.a, u.b, count(y.src) AS t FROM u JOIN n x ON x.src = u.a LEFT JOIN n y ON y.src = u.b AND y.dst = x.dst GROUP BY u.a, u.b)
SELECT u.a AS u, u.b AS v, round(2 + t.t / sqrt(0.1875) - (p.k - 1 - t.t + q.k - 1 - t.t), 9) AS curvature FROM u JOIN t USING (a, b) JOIN dg p ON p.src = u.a JOIN dg q ON q.src = u.b"""))
def forman_ricci_curvature(spark, d):
    e = structure.undirected(fx.parts(spark, d)).withColumn("w", F.lit(1.0))
    return ricci.curvature(e).select("u", "v", F.round("curvature", 9).alias("curvature"))


@query()
def forman_ricci_flow(spark, d):
    return ricci.ricci_flow(fx.parts(spark, d), 2)


# -- linear algebra -------------------------------------------------------------------------------------------------

BUY = "m AS (SELECT o_custkey AS r, l_suppkey AS c, sum(l_quantity) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def _suppliers(spark, d) -> DataFrame:
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("val"))


@query(f"WITH {BUY} SELECT c_custkey AS idx, round(coalesce(sum(x * s_acctbal), 0), 4) AS val FROM customer LEFT JOIN m ON r = c_custkey LEFT JOIN supplier ON s_suppkey = c GROUP BY c_custkey")
def spmv(spark, d):
    out = linear.spmv(fx.customer_suppliers(spark, d), _suppliers(spark, d), fx.table(spark, d, "customer").select("c_custkey"))
    return out.select("idx", F.round("val", 4).alias("val"))


@query(f"WITH {BUY} SELECT r AS row, round(sum(x * s_acctbal), 4) AS c0, sum(x) AS c1, round(sum(x * s_nationkey), 4) AS c2 FROM m JOIN supplier ON s_suppkey = c GROUP BY r")
def spmm(spark, d):
    dense = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.array(F.col("s_acctbal"), F.lit(1.0), F.col("s_nationkey").cast("double")).alias("vals"))
    return linear.spmm(fx.customer_suppliers(spark, d), dense, 3).select("row", F.round(F.col("vals")[0], 4).alias("c0"), F.col("vals")[1].alias("c1"), F.round(F.col("vals")[2], 4).alias("c2"))


@query(f"WITH {BUY} SELECT a.c AS row, b.c AS col, sum(a.x * b.x) AS val FROM m a JOIN m b ON a.r = b.r GROUP BY 1, 2 HAVING sum(a.x * b.x) <> 0")
def spgemm(spark, d):
    m = fx.customer_suppliers(spark, d)
    return linear.mxm(linear.transpose(m), m)


@query(P("w2 AS (SELECT a.src AS row, b.dst AS col, min(a.w + b.w) AS val FROM e a JOIN e b ON a.dst = b.src GROUP BY 1, 2)\nSELECT w2.* FROM w2 JOIN (SELECT DISTINCT src, dst FROM e) k ON k.src = w2.row AND k.dst = w2.col"))
def mxm_min_plus_masked(spark, d):
    g = fx.parts(spark, d)
    a = g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("val"))
    return linear.mxm(a, a, "min_plus", mask=a)


@query(Q("SELECT a.src AS row, b.dst AS col, CAST(count(*) AS DOUBLE) AS val FROM e a JOIN e b ON a.dst = b.src GROUP BY 1, 2"))
def khop_adj(spark, d):
    return transforms.khop(fx.parts(spark, d), 2)


# -- graph algebra ----------------------------------------------------------------------------------------------------


def _simple(name: str, sql: str, fn: Callable[[Graph], DataFrame]) -> None:
    query(Q(sql), name)(lambda spark, d: fn(fx.parts(spark, d)))


_simple("graph_build", "SELECT src, dst, w AS weight FROM e", lambda g: g.edges)
_simple("graph_counts", "SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges", lambda g: g.degree_stats().select("n_vertices", "n_edges"))
_simple("out_degree", "SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id", lambda g: g.out_degree())
_simple("in_degree", "SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id", lambda g: g.in_degree())
_simple("degree_stats", ", k AS (SELECT v.id, count(e.dst) AS g FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT round(avg(g), 9) AS mean, round(stddev_pop(g), 9) AS deviation FROM k", lambda g: g.degree_stats().select(F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation")))
_simple("degree_histogram", ", k AS (SELECT v.id, count(e.dst) AS g FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT CAST(CASE WHEN g = 0 THEN 0 ELSE length(bin(g)) END AS INTEGER) AS bin, count(*) AS n FROM k GROUP BY 1", lambda g: g.degree_histogram())
_simple("csr_offsets", ", k AS (SELECT v.id, count(e.dst) AS g FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT id, CAST(sum(g) OVER (ORDER BY id) - g AS BIGINT) AS \"offset\", g AS degree FROM k", lambda g: g.csr_offsets())
_simple("csc_offsets", ", k AS (SELECT v.id, count(e.src) AS g FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id) SELECT id, CAST(sum(g) OVER (ORDER BY id) - g AS BIGINT) AS \"offset\", g AS degree FROM k", lambda g: g.csc_offsets())
_simple("csr_to_coo", "SELECT src AS id, row_number() OVER (ORDER BY src, dst) - 1 AS position FROM e", lambda g: csr_to_coo(g.csr_offsets()))
_simple("adjacency", "SELECT v.id, coalesce(list_sort(list(DISTINCT e.dst) FILTER (e.dst IS NOT NULL)), []) AS neighbours FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id", lambda g: g.adjacency())
_simple("reverse", "SELECT dst AS src, src AS dst, w AS weight FROM e", lambda g: g.reverse().edges)
_simple("symmetric", "SELECT src, dst, min(w) AS weight FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2", lambda g: g.symmetric().edges)
_simple("add_self_loop", "SELECT src, dst, w AS weight FROM e UNION ALL SELECT id, id, CAST(1 AS DOUBLE) FROM v", lambda g: g.with_self_loops().edges)
_simple("weight_threshold", "SELECT src, dst, w AS weight FROM e WHERE w < 10", lambda g: g.lighter_than(10).edges)
_simple("degree_reorder", ", k AS (SELECT v.id, count(e.dst) AS g FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) SELECT id AS old, row_number() OVER (ORDER BY g DESC, id) - 1 AS new, g AS degree FROM k", lambda g: g.degree_order())
_simple("compact_graph", ", m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) SELECT a.k AS src, b.k AS dst, w AS weight FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst", lambda g: g.compact()[0].edges)
_simple("line_graph", "SELECT DISTINCT a.src AS u, a.dst AS v, b.dst AS w FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst", lambda g: g.line_graph(backtracking=False))
_simple("incidence", ", k AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS c FROM e) SELECT src AS row, c AS col, CAST(-1 AS DOUBLE) AS val FROM k UNION ALL SELECT dst, c, CAST(1 AS DOUBLE) FROM k", lambda g: g.incidence())


def _some(spark, d) -> DataFrame:
    return fx.table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"))


_SOME = ", k AS (SELECT p_partkey AS id FROM part WHERE p_size <= 10) "


@query(Q(_SOME + "SELECT src, dst, w AS weight FROM e WHERE dst IN (SELECT id FROM k)"))
def in_subgraph(spark, d):
    return fx.parts(spark, d).in_subgraph(_some(spark, d))


@query(Q(_SOME + "SELECT src, dst, w AS weight FROM e WHERE src IN (SELECT id FROM k)"))
def out_subgraph(spark, d):
    return fx.parts(spark, d).out_subgraph(_some(spark, d))


@query(Q(_SOME + "SELECT src, dst, w AS weight FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"))
def node_subgraph(spark, d):
    return fx.parts(spark, d).node_subgraph(_some(spark, d)).edges


@query(Q("SELECT src, dst, w AS weight FROM e WHERE w >= 5"))
def remove_edges(spark, d):
    g = fx.parts(spark, d)
    return g.remove_edges(g.edges.where("weight < 5")).edges


@query(Q("SELECT s.p AS src, s.q AS dst, count(e.src) AS n_edges, min(e.w) AS weight FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS q FROM lineitem) s LEFT JOIN e ON e.src = s.p AND e.dst = s.q GROUP BY 1, 2"))
def edge_lookup(spark, d):
    return fx.parts(spark, d).edge_lookup(fx.part_suppliers(spark, d))


@query(Q("SELECT a.src, a.dst, count(y.dst) AS n_common FROM e a LEFT JOIN e x ON x.src = a.src LEFT JOIN e y ON y.src = a.dst AND y.dst = x.dst GROUP BY 1, 2"))
def neighbor_intersection(spark, d):
    g = fx.parts(spark, d)
    return g.common_neighbours(g.edges.select("src", "dst"))


@query("SELECT user_id AS src, nxt AS dst, count(*) AS n FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt, event_type FROM events) WHERE nxt IS NOT NULL GROUP BY 1, 2")
def to_simple(spark, d):
    from weftgraph.plans.prefix import running_total

    e = running_total(fx.table(spark, d, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], F.lit(1).cast("long"), "k")
    nxt = e.select((F.col("k") - 1).alias("k"), F.col("user_id").alias("dst"))
    return Graph(e.select("k", F.col("user_id").alias("src")).join(nxt, "k").select("src", "dst")).simple()


@query(r"""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u FROM pages) SELECT u AS key, row_number() OVER (ORDER BY u) - 1 AS id FROM l""", "dense_ids")
def dense_ids_of_links(spark, d):
    links = fx.table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("u"))
    return dense_ids(links, "u")


# -- messages and readouts ------------------------------------------------------------------------------------------

FEAT = ", f AS (SELECT p_partkey AS id, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part) "


def _feat(spark, d) -> DataFrame:
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


def _message(name: str, expr: str, reducer: str, build: Callable) -> None:
    agg = {"mean": "avg"}.get(reducer, reducer)
    sql = Q(FEAT + f"SELECT f.id, round(k.h, 6) AS h FROM f LEFT JOIN (SELECT e.dst, {agg}({expr}) AS h FROM e LEFT JOIN f u ON u.id = e.src LEFT JOIN f v ON v.id = e.dst GROUP BY e.dst) k ON k.dst = f.id")
    query(sql, name)(lambda spark, d: messages.update_all(fx.parts(spark, d).edges, _feat(spark, d), build(), reducer).select("id", F.round("h", 6).alias("h")))


_message("copy_u_sum", "u.x", "sum", lambda: messages.copy("u", "x"))
_message("copy_e_max", "e.w", "max", lambda: messages.copy("e", "weight"))
_message("copy_u_mean", "u.y", "mean", lambda: messages.copy("u", "y"))
_message("u_mul_e_sum", "u.x * e.w", "sum", lambda: messages.binary("mul", "u", "x", "e", "weight"))
_message("u_add_v_min", "u.x + v.x", "min", lambda: messages.binary("add", "u", "x", "v", "x"))
_message("e_sub_v_max", "e.w - v.y", "max", lambda: messages.binary("sub", "e", "weight", "v", "y"))
_message("u_div_v_sum", "u.x / v.y", "sum", lambda: messages.binary("div", "u", "x", "v", "y"))


_ENDS = {"u": ("x", "u.x"), "v": ("y", "v.y"), "e": ("weight", "e.w")}
for _op, _sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
    for _a in "uve":
        for _b in "uve":
            if _a != _b and f"{_a}_{_op}_{_b}_sum" not in QUERIES:
                _message(f"{_a}_{_op}_{_b}_sum", f"{_ENDS[_a][1]} {_sign} {_ENDS[_b][1]}", "sum", lambda op=_op, a=_a, b=_b: messages.binary(op, a, _ENDS[a][0], b, _ENDS[b][0]))


@query(Q(FEAT + "SELECT e.src, e.dst, round(u.x * v.x + u.y * v.y, 6) AS m FROM e LEFT JOIN f u ON u.id = e.src LEFT JOIN f v ON v.id = e.dst"))
def u_dot_v(spark, d):
    nodes = _feat(spark, d).select("id", F.array("x", "y").alias("z"))
    return messages.apply_edges(fx.parts(spark, d).edges, messages.binary("dot", "u", "z", "v", "z"), "m", nodes).select("src", "dst", F.round("m", 6).alias("m"))


@query(Q("SELECT src, dst, round(exp((w - max(w) OVER (PARTITION BY dst)) / 10) / sum(exp((w - mx) / 10)) OVER (PARTITION BY dst), 9) AS a FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS mx FROM e)"))
def edge_softmax(spark, d):
    e = fx.parts(spark, d).edges.withColumn("z", F.col("weight") / 10)
    return messages.edge_softmax(e, "z").select("src", "dst", F.round("a", 9).alias("a"))


@query(Q(FEAT + "SELECT k.id, round(sum(u.x), 6) AS h FROM (SELECT id FROM f WHERE y <= 10) k LEFT JOIN e ON e.dst = k.id LEFT JOIN f u ON u.id = e.src GROUP BY k.id"))
def pull_messages(spark, d):
    return messages.pull(fx.parts(spark, d).edges, _feat(spark, d), _some(spark, d), messages.copy("u", "x")).select("id", F.round("h", 6).alias("h"))


@query(Q(FEAT + "SELECT e.dst AS id, round(sum(u.x), 6) AS h FROM e JOIN f u ON u.id = e.src WHERE u.y <= 10 GROUP BY e.dst"))
def push_messages(spark, d):
    return messages.push(fx.parts(spark, d).edges, _feat(spark, d), _some(spark, d), messages.copy("u", "x")).select("id", F.round("h", 6).alias("h"))


@query(Q(FEAT + "SELECT id, round(sum(h), 6) AS h FROM (SELECT e.dst AS id, sum(u.x) AS h FROM e JOIN f u ON u.id = e.src GROUP BY 1 UNION ALL SELECT e.src, max(u.y) FROM e JOIN f u ON u.id = e.dst GROUP BY 1) GROUP BY id"))
def multi_update_all(spark, d):
    g, f = fx.parts(spark, d), _feat(spark, d)
    parts = [(g.edges, f, messages.copy("u", "x"), "sum"), (g.reverse().edges, f, messages.copy("u", "y"), "max")]
    return messages.multi_update_all(parts, "sum").select("id", F.round("h", 6).alias("h"))


@query(Q("SELECT src, dst, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT src, dst, w AS weight, row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) AS rank FROM e) WHERE rank <= 3"))
def select_topk(spark, d):
    return messages.topk(fx.parts(spark, d).edges, 3, "weight", "dst", "src").select("src", "dst", "weight", "rank")


@query(Q("SELECT src, dst, w AS weight, sum(w) OVER (PARTITION BY src) AS total FROM e"))
def group_apply_edges(spark, d):
    return messages.group_apply_edges(fx.parts(spark, d).edges, "src", F.sum("weight"), "total").select("src", "dst", "weight", "total")


NODES = "SELECT conv_id AS graph_id, turn AS id, CAST(length(text) AS DOUBLE) AS x FROM conversations"


def _turns(spark, d) -> DataFrame:
    return fx.table(spark, d, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("id"), F.length("text").cast("double").alias("x"))


for _r, _a in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    query(f"SELECT graph_id, round({_a}(x), 9) AS x FROM ({NODES}) GROUP BY graph_id", f"readout_{_r}")(lambda spark, d, r=_r: messages.readout(_turns(spark, d), "x", r).select("graph_id", F.round("x", 9).alias("x")))


@query(f"SELECT graph_id, id, x, round(exp((x - mx) / 100) / sum(exp((x - mx) / 100)) OVER (PARTITION BY graph_id), 9) AS p FROM (SELECT *, max(x) OVER (PARTITION BY graph_id) AS mx FROM ({NODES}))")
def readout_softmax(spark, d):
    t = _turns(spark, d).withColumn("z", F.col("x") / 100)
    return messages.softmax_readout(t, "z").select("graph_id", "id", "x", F.round("p", 9).alias("p"))


@query(f"SELECT graph_id, id, x, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY x DESC, id) AS rank FROM ({NODES})) WHERE rank <= 2")
def readout_topk(spark, d):
    return messages.topk(_turns(spark, d), 2, "x", "graph_id", "id")


@query(f"WITH {fx.CONV_SQL}, n AS (SELECT graph_id, id, row_number() OVER (ORDER BY graph_id, id) - 1 AS k FROM (SELECT DISTINCT conv_id AS graph_id, turn AS id FROM conversations)) SELECT e.graph_id, a.k AS src, b.k AS dst FROM e JOIN n a ON a.graph_id = e.graph_id AND a.id = e.src JOIN n b ON b.graph_id = e.graph_id AND b.id = e.dst")
def batch_graphs(spark, d):
    return transforms.batch_graphs(*fx.conversations(spark, d))[1]


@query(f"WITH {fx.CONV_SQL} SELECT graph_id, src, dst FROM e")
def unbatch_graphs(spark, d):
    return transforms.unbatch_graphs(*transforms.batch_graphs(*fx.conversations(spark, d)))


@query("WITH b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), c AS (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier) SELECT DISTINCT p AS src, CAST(n AS BIGINT) AS dst FROM b JOIN c USING (s)")
def metapath_reachable(spark, d):
    nations = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return transforms.metapath([fx.part_suppliers(spark, d), nations])


@query("WITH b AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem), u AS (SELECT g, sum(s_acctbal) AS x FROM b JOIN supplier ON s_suppkey = m GROUP BY g) SELECT m AS member, round(sum(x), 4) AS value FROM b JOIN u USING (g) GROUP BY m")
def hyperedge_propagate(spark, d):
    values = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_acctbal").alias("value"))
    out = transforms.hyperedge_propagate(fx.table(spark, d, "lineitem"), values, "l_orderkey", "l_suppkey")
    return out.select("member", F.round("value", 4).alias("value"))


@query("WITH b AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS m FROM lineitem) SELECT x.m AS u, y.m AS v, count(*) AS n FROM b x JOIN b y ON x.g = y.g AND x.m < y.m GROUP BY 1, 2")
def clique_expansion(spark, d):
    return transforms.clique_expansion(fx.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"WITH RECURSIVE {fx.GEO_SQL}, s AS (SELECT 0 AS part, 100 + CAST(n_nationkey AS BIGINT) AS id FROM nation), r AS (SELECT part, id, 0 AS hop FROM s UNION SELECT r.part, e.src, r.hop + 1 FROM r JOIN e ON e.dst = r.id WHERE r.hop < 2) SELECT part, id, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY 1, 2")
def halo(spark, d):
    nations = fx.table(spark, d, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("id"), F.lit(0).alias("part"))
    return transforms.halo(fx.geo(spark, d), nations, 2)


@query(Q(_SOME + ", b AS (SELECT * FROM e WHERE dst IN (SELECT id FROM k)), a AS (SELECT id, 0 AS late FROM k UNION SELECT src, 1 FROM b WHERE src NOT IN (SELECT id FROM k)), m AS (SELECT id, row_number() OVER (ORDER BY late, id) - 1 AS n FROM a) SELECT x.n AS src, y.n AS dst FROM b JOIN m x ON x.id = b.src JOIN m y ON y.id = b.dst"))
def to_block(spark, d):
    return transforms.to_block(fx.parts(spark, d).edges, _some(spark, d))[0]


# -- sampling, generators, geography ------------------------------------------------------------------------------


def _draw(seed: object, *cols: str) -> str:
    """uniform() in SQL."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(cols)})), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE))"


def _picked(edges: str, at: str, fanout: int, seed: int, weight: str = "CAST(1 AS DOUBLE)") -> str:
    return f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY -ln({_draw(seed, 'src', 'dst')}) / {weight}, src) AS r FROM {edges} WHERE dst IN (SELECT id FROM {at})) WHERE r <= {fanout}"


@query(Q(f"SELECT src, dst, w AS weight FROM ({_picked('e', 'v', 5, 1, 'w')})"))
def sample_neighbors(spark, d):
    g = fx.parts(spark, d)
    return sampling.sample_neighbors(g.edges, g.vertices, 5, weight="weight", seed=1)


WALK = f"""c AS (SELECT src, dst, w, sum(w) OVER (PARTITION BY src ORDER BY dst) AS hi, sum(w) OVER (PARTITION BY src) AS total FROM e),
r AS (SELECT src, dst, (hi - w) / total AS lo, hi / total AS hi FROM c),
k(walk, step, cur, trace) AS (
  SELECT id, 0, id, [id] FROM v UNION ALL
  SELECT walk, step + 1, coalesce(r.dst, -1), list_append(trace, coalesce(r.dst, -1)) FROM k LEFT JOIN r ON r.src = k.cur AND {_draw(1, 'walk', 'step')} > r.lo AND {_draw(1, 'walk', 'step')} <= r.hi WHERE step < 4)"""


@query(P(WALK + "\nSELECT walk, trace FROM k WHERE step = 4", True))
def random_walk(spark, d):
    g = fx.parts(spark, d)
    return sampling.random_walk(g.edges, g.vertices.select(F.col("id").alias("walk"), "id"), 4, weight="weight", seed=1)


@query()
def visited_neighbors(spark, d):
    g = fx.parts(spark, d)
    return sampling.visited_neighbors(g.edges, g.vertices, 3, walks=4)


@query(Q(_SOME + f", b AS (SELECT src, dst FROM e), f0 AS ({_picked('b', 'k', 3, 0)}), n AS (SELECT DISTINCT src AS id FROM f0), f1 AS ({_picked('b', 'n', 2, 1)}) SELECT 0 AS layer, src, dst FROM f0 UNION ALL SELECT 1, src, dst FROM f1"))
def node_flow(spark, d):
    return sampling.node_flow(fx.parts(spark, d).edges, _some(spark, d), [3, 2])


@query(Q(f", n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v), a AS (SELECT src, CAST(floor({_draw(0, 'src', 'dst', '0')} * (SELECT count(*) FROM n)) AS BIGINT) AS n FROM e) SELECT DISTINCT a.src, n.id AS dst FROM a JOIN n USING (n) WHERE (a.src, n.id) NOT IN (SELECT (src, dst) FROM e)"))
def negative_edges(spark, d):
    g = fx.parts(spark, d)
    return sampling.negative_edges(g.edges, g.vertices, 1)


def _partition_sql(parts: int, rounds: int) -> str:
    out = [f"{fx.UNDIRECTED_SQL}, p0 AS (SELECT id, CAST(floor({_draw(0, 'id')} * {parts}) AS INTEGER) AS part FROM v)"]
    for r in range(rounds):
        out.append(f"""t{r} AS (SELECT id, part FROM (SELECT n.src AS id, p.part, row_number() OVER (PARTITION BY n.src ORDER BY count(*) DESC, p.part) AS k FROM n JOIN p{r} p ON p.id = n.dst GROUP BY n.src, p.part) WHERE k = 1),
p{r + 1} AS MATERIALIZED (SELECT p.id, CASE WHEN {_draw(r + 1, 'p.id')} < 0.5 THEN coalesce(t.part, p.part) ELSE p.part END AS part FROM p{r} p LEFT JOIN t{r} t ON t.id = p.id)""")
    return P(",\n".join(out) + f"\nSELECT id, part FROM p{rounds}")


@query(_partition_sql(4, 5))
def label_partition(spark, d):
    return transforms.label_partition(fx.parts(spark, d), 4)


@query("WITH p AS (SELECT range AS id FROM range(400)) SELECT id AS src, id + 1 AS dst FROM p WHERE id % 20 < 19 UNION ALL SELECT id + 1, id FROM p WHERE id % 20 < 19 UNION ALL SELECT id, id + 20 FROM p WHERE id < 380 UNION ALL SELECT id + 20, id FROM p WHERE id < 380")
def grid_graph(spark, d):
    return generators.grid(spark, 20)


RMAT = ", ".join(f"CASE WHEN u{k} < 0.5 THEN 0 WHEN u{k} < 0.6 THEN 1 WHEN u{k} < 0.7 THEN 2 ELSE 3 END AS q{k}" for k in range(10))


@query(f"WITH r AS (SELECT {', '.join(f'{_draw(0, 'id', str(k))} AS u{k}' for k in range(10))} FROM (SELECT range AS id FROM range(8000))), q AS (SELECT {RMAT} FROM r) "
       f"SELECT CAST({' + '.join(f'(q{k} // 2) * {2 ** (9 - k)}' for k in range(10))} AS BIGINT) AS src, CAST({' + '.join(f'(q{k} % 2) * {2 ** (9 - k)}' for k in range(10))} AS BIGINT) AS dst FROM q")  # fmt: skip
def rmat_graph(spark, d):
    return generators.rmat(spark, 10, 8000)


@query("""WITH d AS (SELECT a.vec_id AS dst, b.vec_id AS src, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS q
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) SELECT src, dst, round(q, 6) AS dist2 FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY q, src) AS r FROM d) WHERE r <= 5""")
def knn_graph(spark, d):
    p = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return generators.knn_graph(p, 5, queries=p.where("id % 50 = 0")).select("src", "dst", F.round("dist2", 6).alias("dist2"))


PLACE = "SELECT c_custkey AS id, CAST((c_custkey * 37) % 179 AS DOUBLE) - 89 AS lat, CAST((c_custkey * 101) % 359 AS DOUBLE) - 179 AS lon FROM customer"


def _places(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(c.alias("id"), (((c * 37) % 179).cast("double") - 89).alias("lat"), (((c * 101) % 359).cast("double") - 179).alias("lon"))


@query(f"SELECT id, round(2 * 6371 * asin(least(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2)), 1)), 6) AS km FROM ({PLACE})")
def haversine_km(spark, d):
    return _places(spark, d).select("id", F.round(haversine(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 6).alias("km"))


@query(f"""SELECT id, round(degrees(atan2(sin(radians(lat)) + sin(radians(10)), sqrt(pow(cos(radians(lat)) + cos(radians(10)) * cos(radians(20 - lon)), 2) + pow(cos(radians(10)) * sin(radians(20 - lon)), 2)))), 6) AS lat,
  round(degrees(radians(lon) + atan2(cos(radians(10)) * sin(radians(20 - lon)), cos(radians(lat)) + cos(radians(10)) * cos(radians(20 - lon)))), 6) AS lon FROM ({PLACE})""")
def midpoints(spark, d):
    m = _places(spark, d).select("id", midpoint(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)).alias("m"))
    return m.select("id", F.round("m.lat", 6).alias("lat"), F.round("m.lon", 6).alias("lon"))


@query()
def geolocate(spark, d):
    g = fx.geo(spark, d).symmetric()
    return geo.geolocate(g, _places(spark, d).withColumn("id", F.col("id") + 1000), 2, 5)


# -- files written below the shared folder and read again -----------------------------------------------------------------


def _round_trip(name: str, sql: str, write: Callable, read: Callable) -> None:
    def run(spark, d):
        path = shared_dir(spark)
        write(fx.parts(spark, d), path)
        out = materialize(read(spark, path))
        drop_dir(spark, path)
        return out

    query(Q(sql), name)(run)


_E = "SELECT src, dst, w AS weight FROM e"
_round_trip("matrix_market_file", _E, lambda g, p: files.write_matrix_market(g.edges, p, 1 << 40), lambda s, p: files.read_matrix_market(s, p)[0])
_round_trip("adjacency_file", _E, lambda g, p: files.write_adjacency(g, p, weighted=True), files.read_adjacency)
_round_trip("csr_folder", _E, files.write_csr, files.read_csr)
_round_trip("saved_graphs", "SELECT src, dst, w AS weight, CAST(src % 3 AS INTEGER) AS graph_id FROM e WHERE src % 3 <> 1", lambda g, p: files.save_graphs(g.edges.withColumn("graph_id", (F.col("src") % 3).cast("int")), p), lambda s, p: files.load_graphs(s, p, [0, 2]))


FLAGSHIP = heterogeneous_batch
