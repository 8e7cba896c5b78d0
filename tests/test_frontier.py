"""Frontier operators, traversal orders and scheduling on small graphs with hand-made answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import frontier as fr
from weftgraph.operators import messages, scheduling, structure, transforms, traversal
from weftgraph.operators.fixpoint import Query, run_batch
from weftgraph.sources import files


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(0, 1, 2.0), (0, 2, 5.0), (1, 3, 1.0), (2, 3, 4.0), (3, 0, 7.0), (3, 4, 1.0)]
    return Graph(spark.createDataFrame(rows, "src long, dst long, weight double"), spark.range(6))


def got(df):
    return sorted(map(tuple, df.collect()))


def test_advance_repeats_and_filters(spark, graph):
    twice = spark.createDataFrame([(0,), (0,), (9,)], "id long")
    assert len(got(fr.advance(graph, twice))) == 4
    assert got(fr.advance(graph, twice, F.col("weight") > 3, distinct=True)) == [(0, 2, 5.0)]
    assert got(fr.advance(graph, spark.createDataFrame([(3,)], "id long"), backward=True).select("src")) == [(1,), (2,)]


def test_filters_of_nulls(spark):
    f = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    keep = F.col("id") > 1
    assert got(fr.filtered(f, keep)) == [(2,)]
    assert got(fr.filtered(f, keep, "remove").where("id is not null")) == [(1,)]
    assert fr.filtered(f, keep, "bypass").where("id is null").count() == 2
    assert got(fr.uniquify(fr.filtered(f.union(f), keep, "bypass"))) == [(2,)]
    with pytest.raises(ValueError):
        fr.filtered(f, keep, "compact")


def test_reductions_cover_vertices_without_edges(graph):
    assert dict(got(fr.neighbor_reduce(graph, F.col("weight"), "min", F.lit(-1.0)))) == {0: 2.0, 1: 1.0, 2: 4.0, 3: 1.0, 4: -1.0, 5: -1.0}
    assert dict(got(fr.pack_edges(graph, F.col("weight") < 3)[1])) == {0: 1, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def test_edge_work_and_budget(spark, graph):
    pairs = spark.createDataFrame([(0, 0), (1, 0), (0, 3), (1, 5)], "query_id long, vertex long")
    assert got(fr.edge_work(graph, pairs)) == [(4, 3, 6, 4)]
    assert got(fr.edge_work(graph, pairs.where("false"))) == [(0, 0, 0, 0)]
    assert dict(got(fr.edge_budget_parts(graph, 2))) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}


def test_next_bucket(spark):
    rows = spark.createDataFrame([(1, 9.0), (2, 4.0), (3, 3.5), (4, None)], "id long, p double")
    assert got(fr.next_bucket(rows, "p", 2.0)) == [(3, 3.5, 1)]
    assert got(fr.next_bucket(rows, "p", 2.0, descending=True)) == [(1, 9.0, 4)]
    assert fr.next_bucket(rows.where("false"), "p").count() == 0


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "k long, v double")
    b = spark.createDataFrame([(1, 1.05), (2, 3.0), (3, None)], "k long, v double")
    assert [r[0] for r in got(fr.compare(a, b, ["k"], "v", 0.1))] == [2, 4]


def test_dfs_against_recursion(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(g, int(a), int(b)) for g in (0, 1) for a, b in rng.integers(0, 12, (25, 2))})
    e = spark.createDataFrame(edges, "graph_id long, src long, dst long")
    starts = spark.createDataFrame([(g, v) for g in (0, 1) for v in (3, 0)], "graph_id long, id long")
    expected = []
    for g in (0, 1):
        seen, steps = set(), []

        def visit(v, g=g, seen=seen, steps=steps):
            seen.add(v)
            for _, _, w in [x for x in edges if x[0] == g and x[1] == v]:
                if w in seen:
                    steps.append((v, w, "nontree"))
                else:
                    steps.append((v, w, "forward"))
                    visit(w)
                    steps.append((v, w, "reverse"))

        for s in (0, 3):
            if s not in seen:
                visit(s)
        expected += [(g, k, *x) for k, x in enumerate(steps)]
    assert got(traversal.dfs_edges(e, starts, labelled=True)) == sorted(expected)
    with pytest.raises(ValueError):
        traversal.dfs_edges(e, starts, limit=3)


def test_propagation_follows_layers(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    nodes = spark.createDataFrame([(0, 1.0), (1, 10.0), (2, 100.0), (3, 5.0)], "id long, x double")
    layers = structure.topological_layers(Graph(e)).where("layer > 0")
    out = traversal.propagate(e, nodes, layers, "x", messages.copy("u", "x"), "sum", F.col("x") + F.col("h"))
    assert dict(got(out)) == {0: 1.0, 1: 11.0, 2: 112.0, 3: 5.0}


def test_shared_and_separate_equal_the_batch(graph):
    batch = [Query(0, "bfs", 0), Query(1, "sssp", 1), Query(2, "sswp", 2)]
    plain = got(run_batch(graph, batch).state)
    assert got(run_batch(graph, batch, mode="shared").state) == plain
    assert got(scheduling.run_separately(graph, batch, 2).state) == plain


def test_neighbour_groups(spark):
    e = [(s, 100) for s in range(4)] + [(s, 200) for s in range(4, 6)] + [(h, 300 + i) for h in (100, 200) for i in range(5)]
    g = Graph(spark.createDataFrame(e, "src long, dst long"))
    groups = scheduling.neighbour_groups(g, [Query(i, "bfs", s) for i, s in enumerate((0, 4, 1, 5, 2, 3))], 2, hub_degree=3)
    assert [sorted(q.source for q in b) for b in groups] == [[0, 1], [2, 3], [4, 5]]


def test_betweenness_in_batches(graph):
    whole = dict(got(structure.betweenness(graph, list(range(6)))))
    found = dict(got(structure.betweenness_all(graph, batch=2)))
    assert found.keys() == whole.keys() and all(abs(found[k] - whole[k]) < 1e-12 for k in whole)


def test_array_folder(spark, graph, tmp_path):
    for name, x in (("csr_vlist", [0, 2, 3, 4, 6]), ("csr_elist", [1, 2, 3, 3, 0, 4]), ("csr_weightlist", [2, 5, 1, 4, 7, 1])):
        np.array(x, "<i4").tofile(tmp_path / f"{name}.bin")
    assert got(files.read_csr_folder(spark, str(tmp_path))) == got(graph.edges)
    assert got(files.read_named(spark, "toy", {"toy": f"{tmp_path}/"}).edges) == got(graph.edges)
    np.array([0, 2], "<i4").tofile(tmp_path / "csr_vlist.bin")
    with pytest.raises(ValueError):
        files.read_csr_folder(spark, str(tmp_path))
    with pytest.raises(ValueError):
        files.read_named(spark, "other", {})


def test_adjacency_round_trip(spark, graph, tmp_path):
    files.write_adjacency(graph, str(tmp_path / "a.adj"), weighted=True)
    assert got(files.read_adjacency(spark, str(tmp_path / "a.adj"))) == got(graph.edges)


def test_hypergraph(spark, tmp_path):
    # members 0, 1, 2; hyperedges 0 = {0, 2}, 1 = {1, 2}
    numbers = [3, 4, 2, 4, 0, 1, 2, 0, 1, 0, 1, 0, 2, 0, 2, 1, 2]
    (tmp_path / "h").write_text("AdjacencyHypergraph\n" + "\n".join(map(str, numbers)) + "\n")
    assert got(files.read_hypergraph(spark, str(tmp_path / "h"))) == [(0, 0), (0, 2), (1, 1), (1, 2)]


def test_metrics(spark, tmp_path):
    files.write_metrics(spark, [1.0, 3.0], str(tmp_path / "m"), [7], ["t"], engine="x")
    row = json.loads(next((tmp_path / "m").glob("part-*")).read_text())
    assert (row["mean_ms"], row["deviation_ms"], row["sources"], row["system"]["engine"]) == (2.0, 1.0, [7], "x")


def test_laplacian_of_a_triangle(spark):
    g = Graph(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long"))
    assert abs(transforms.laplacian_lambda_max(g, 4) - 1.5) < 1e-9


def test_sources_by_distance(spark):
    # a star into 0, which has the most out-edges, and a tail behind it
    e = [(0, 50 + i) for i in range(9)] + [(i, 0) for i in range(1, 7)] + [(7, 1)]
    found = got(scheduling.sources_by_distance(Graph(spark.createDataFrame(e, "src long, dst long")), 2, n_hubs=1))
    hops = {0: 0, 7: 2} | {i: 1 for i in range(1, 7)}
    assert [h for h, _ in found] == [0, 1, 1, 2] and all(hops[v] == h for h, v in found)
