"""Subgraphs, user functions, softmax without windows, products with masks, the loop class, the API and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import api
from weftgraph.__main__ import main
from weftgraph.graph import Graph
from weftgraph.operators import frontier as fr
from weftgraph.operators import linear, messages, sampling, scheduling, transforms
from weftgraph.operators.loop import Fixpoint, Reached
from weftgraph.sources import generators


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(0, 1, 2.0), (0, 2, 5.0), (1, 3, 1.0), (2, 3, 4.0), (3, 0, 7.0), (3, 4, 1.0)]
    return Graph(spark.createDataFrame(rows, "src long, dst long, weight double"), spark.range(6))


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_softmax_of_far_values_and_nulls(spark):
    rows = [(1, 0, 1000.0), (2, 0, 1001.5), (3, 0, -1e6), (4, 0, None), (5, 1, 0.3), (6, None, 2.0)]
    out = messages.softmax_readout(spark.createDataFrame(rows, "id int, graph_id int, x double"), "x")
    p = {r.id: r.p for r in out.collect()}
    assert out.columns == ["id", "graph_id", "x", "p"]
    assert p[1] == pytest.approx(1 / (1 + np.exp(1.5))) and p[2] == pytest.approx(1 - p[1]) and p[3] == 0 and p[4] is None
    assert p[5] == p[6] == 1
    empty = spark.createDataFrame([], "src long, dst long, z double")
    assert got(messages.edge_softmax(empty, "z")) == []


def test_group_apply_keeps_all_edges(spark, graph):
    out = messages.group_apply_edges(graph.edges, "src", F.max("weight"), "top")
    assert out.columns == ["src", "dst", "weight", "top"]
    assert [r[3] for r in got(out)] == [5.0, 5.0, 1.0, 4.0, 7.0, 7.0]


def test_mailboxes(spark, graph):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(6)], "id long, x double")
    assert got(messages.mailbox_reduce(graph.edges, nodes, messages.copy("u", "x"), np.median)) == [(0, 3.0), (1, 0.0), (2, 0.0), (3, 1.5), (4, 3.0)]
    with pytest.raises(ValueError, match="merge"):
        messages.mailbox_reduce(graph.edges, nodes, messages.copy("u", "x"), np.median, box=1)
    hub = spark.range(1000).select(F.col("id").alias("src"), F.lit(7).cast("long").alias("dst"))
    ids = spark.range(1000).withColumn("x", F.col("id").cast("double"))
    assert got(messages.mailbox_reduce(hub, ids, messages.copy("u", "x"), np.max, merge=np.max, box=10)) == [(7, 999.0)]
    sent = messages.map_edges(graph.edges, lambda b: b["u_x"] * 10 + b["v_x"], nodes)
    assert got(sent.select("src", "dst", "m")) == [(0, 1, 1.0), (0, 2, 2.0), (1, 3, 13.0), (2, 3, 23.0), (3, 0, 30.0), (3, 4, 34.0)]


def test_parts_of_mailboxes_hold_no_more_than_a_box(spark):
    # 1000 messages at 7, 20 at each of 300 others, in parts of 8 over several batches and tasks
    edges = spark.range(7000).selectExpr("id AS src", "CASE WHEN id < 1000 THEN 7 ELSE 1000 + id % 300 END AS dst")
    nodes = spark.range(7000).select("id", F.lit(1.0).alias("x"))
    run = lambda merge, **more: dict(got(messages.mailbox_reduce(edges, nodes, messages.copy("u", "x"), np.sum, merge=merge, box=8, **more)))
    want = {7: 1000.0} | {1000 + i: 20.0 for i in range(300)}
    assert run(np.sum) == want and run(np.sum, hub=100) == want
    assert set(run(np.max).values()) == {8.0} and run(len) == {k: -(-v // 8) for k, v in want.items()}
    assert max(run(np.max, hub=100).values()) <= 8


def test_edges_by_number_and_type(spark, graph):
    numbered = fr.numbered_edges(graph)
    sub = graph.edge_subgraph(numbered, spark.createDataFrame([(1,), (1,), (99,)], "eid long"))
    assert got(sub.edges) == [(0, 2, 5.0)] and got(sub.vertices) == [(0,), (2,)]
    assert graph.edge_subgraph(numbered, spark.createDataFrame([(1,)], "eid long"), keep_vertices=True).vertices.count() == 6
    pairs = spark.createDataFrame([(0, 2), (2, 0)], "src long, dst long")
    assert got(fr.edge_ids(numbered, pairs)) == [(0, 2, 1), (2, 0, None)]
    with pytest.raises(ValueError, match="unknown"):
        transforms.type_subgraph({("a", "x", "b"): pairs}, edge_types=["y"])


def test_buckets_move(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, 9.0), (3, 4.0)], "id int, p double")
    changes = spark.createDataFrame([(1, 12.0), (3, None), (4, 0.0)], "id int, p double")
    assert got(fr.update_buckets(rows, changes, "id", "p", 8)) == [(1, 12.0, 1), (2, 9.0, 1), (4, 0.0, 0)]


def test_query_masks_of_many_queries(spark):
    rows = spark.createDataFrame([(0, 5), (31, 5), (32, 5), (32, 5), (70, 6)], "query_id long, vertex long")
    assert got(fr.query_masks(rows)) == [(5, 0, 1 + (1 << 31)), (5, 1, 1), (6, 2, 1 << 6)]


def test_products_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, 4, (5, 5)).astype(float) for _ in range(3))
    sparse = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(5) if m[i, j]], "row long, col long, val double")
    out = linear.mxm(sparse(a), sparse(b), mask=sparse(c), complement=True, transposed=(True, True), accum=sparse(c))
    want = np.where(c == 0, a.T @ b.T, c)
    assert {(r.row, r.col): r.val for r in out.collect()} == {(i, j): want[i, j] for i in range(5) for j in range(5) if want[i, j]}
    dense = lambda m, n: spark.createDataFrame([(i, m[i].tolist()) for i in range(5)], f"{n} long, vals array<double>")
    found = {r.row: r.vals for r in linear.gemm(dense(a, "row"), dense(b, "idx"), 5, 2.0, -1.0, dense(c, "row")).collect()}
    np.testing.assert_allclose([found[i] for i in range(5)], 2 * a @ b - c)


def test_loop_class(spark, graph):
    start = spark.createDataFrame([(0,), (4,)], "id long")
    loop = Reached(graph, start)
    assert got(loop.run()) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 0)] and loop.iterations == 3
    assert got(Reached(graph, start.where("false")).run()) == []

    class Endless(Fixpoint):
        max_iterations = 2

        def prepare(self):
            return self.graph.vertices.withColumn("active", F.lit(True))

        def step(self, state, iteration):
            return state

    with pytest.raises(RuntimeError, match="not settled in 2"):
        Endless(graph).run()


def test_api_and_command_line(spark, graph, tmp_path):
    assert got(api.bfs(graph, 0)) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)]
    assert got(api.sssp(graph, 0)) == [(0, 0.0), (1, 2.0), (2, 5.0), (3, 3.0), (4, 4.0)]
    assert api.wcc(graph).where("component = 0").count() == 5
    graph.edges.write.parquet(str(tmp_path / "g.parquet"))
    main(["sssp", str(tmp_path / "g.parquet"), "--source", "0,3", "--out", str(tmp_path / "out")])
    out = spark.read.parquet(str(tmp_path / "out"))
    assert got(out.where("query_id = 1")) == [(1, 0, 7.0), (1, 1, 9.0), (1, 2, 12.0), (1, 3, 0.0), (1, 4, 1.0)]
    main(["tc", str(tmp_path / "g.parquet"), "--undirected", "--no-self-loops", "--out", str(tmp_path / "tc")])
    assert spark.read.parquet(str(tmp_path / "tc")).agg(F.sum("triangles")).first()[0] == 6
    with pytest.raises(SystemExit):
        main(["nothing", "g"])


def test_nearest_by_segment_in_many_blocks(spark):
    rng = np.random.default_rng(5)
    at = rng.integers(0, 4, (60, 3)).astype(float)  # many ties
    rows = [(i, i % 3 if i < 57 else None, at[i].tolist() if i != 30 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s int, vec array<double>")
    out = generators.knn_graph(df, 4, segment="s", block=5, chunk=3)
    want = []
    for i in range(57):
        others = sorted((float(((at[i] - at[j]) ** 2).sum()), j) for j in range(57) if j % 3 == i % 3 and 30 not in (i, j))
        want += [(j, i, d) for d, j in others[:4]] if i != 30 else []
    assert got(out) == sorted(want, key=repr)
    assert got(generators.knn_graph(df.where("false"), 4)) == []


def test_negatives_by_weight(spark, graph):
    heavy = spark.createDataFrame([(0, 0.0), (1, None), (4, 1.0), (5, 999.0)], "id long, w double")
    pairs = got(sampling.negative_edges(graph.edges, heavy, 50, seed=1, weight="w"))
    assert {v for _, v in pairs} <= {4, 5} and {(u, 5) for u in range(4)} <= set(pairs) and (3, 4) not in pairs
    assert got(sampling.negative_edges(graph.edges, heavy.where("false"), 2, weight="w")) == []


def test_layers_and_one_sided_walks(spark, graph):
    seeds = spark.createDataFrame([(3,), (3,)], "id long")
    assert got(sampling.layer_flow(graph.edges, seeds, [5, 5])) == [(0, 1, 3), (0, 2, 3), (1, 0, 1), (1, 0, 2)]
    assert len({r.src for r in sampling.layer_flow(graph.edges, seeds, [1]).collect()}) == 1
    buys = spark.createDataFrame([(1, 100), (2, 100), (2, 101), (3, 102)], "src long, dst long")
    walks = sampling.one_sided_walk(buys, spark.createDataFrame([(i, 1 + i % 3) for i in range(60)], "walk long, id long"), 4)
    traces = {r.walk: r.trace for r in walks.collect()}
    assert all(len(t) == 5 and (set(t) <= {1, 2} if t[0] < 3 else set(t) == {3}) for t in traces.values())
    assert any(set(t) == {1, 2} for t in traces.values())


def test_execute(spark):
    found, ms = scheduling.execute(lambda i: spark.range(i).count(), 5, threads=3)
    assert found == [0, 1, 2, 3, 4] and ms > 0
    assert scheduling.execute(str, 0)[0] == []
    with pytest.raises(ZeroDivisionError):
        scheduling.execute(lambda i: 1 // i, 2)
