import random

import pytest

from weftgraph.graph import Graph
from weftgraph.operators import fixpoint
from weftgraph.operators.components import connected_components
from weftgraph.operators.fixpoint import Query, run_batch
from weftgraph.sources.generators import attach_chain


def graph(spark, edges):
    rows = [(*e, 1.0) if len(e) == 2 else (*e[:2], float(e[2])) for e in edges]
    return Graph(spark.createDataFrame(rows, "src long, dst long, weight double"))


TOY = [(0, 1, 2), (0, 2, 5), (1, 3, 3)]


def values(result, q):
    return {r.vertex: r.value for r in result.state.where(f"query_id = {q}").collect()}


def brute(edges, kind, source):
    edges = [(*e, 1.0) if len(e) == 2 else e for e in edges]
    step, start, better = {
        "bfs": (lambda v, w: v + 1, 0.0, lambda a, b: a < b), "sssp": (lambda v, w: v + w, 0.0, lambda a, b: a < b), "sswp": (min, float("inf"), lambda a, b: a > b),
        "ssnp": (max, 0.0, lambda a, b: a < b), "viterbi": (lambda v, w: v / w, 1.0, lambda a, b: a > b)}[kind]
    best, moved = {source: start}, True
    while moved:
        moved = False
        for a, b, w in edges:
            if a in best and (b not in best or better(step(best[a], w), best[b])):
                best[b], moved = step(best[a], w), True
    return best


@pytest.mark.parametrize("mode", ["push", "pull", "hybrid"])
def test_mixed_batch(spark, mode):
    g = graph(spark, [(0, 1, 2), (0, 2, 5), (1, 3, 1)])
    found = run_batch(g, [Query(0, "bfs", 0), Query(1, "sssp", 0), Query(2, "wcc"), Query(3, "labels")], mode=mode)
    assert values(found, 0) == {0: 0, 1: 1, 2: 1, 3: 2}
    assert values(found, 1) == {0: 0, 1: 2, 2: 5, 3: 3}
    assert values(found, 2) == dict.fromkeys(range(4), 0)
    assert all(found.completed.values())


@pytest.mark.parametrize("slots", [1, 2, 4])
def test_refilled_slots_count_from_their_own_start(spark, slots):
    queries = [Query(0, "bfs", 0), Query(1, "sssp", 0), Query(2, "bfs", 1), Query(3, "sssp", 1)]
    found = run_batch(graph(spark, TOY), queries, slots=slots, profile=True)
    assert values(found, 0) == {0: 0, 1: 1, 2: 1, 3: 2} and values(found, 1) == {0: 0, 1: 2, 2: 5, 3: 5}
    assert values(found, 2) == {1: 0, 3: 1} and values(found, 3) == {1: 0, 3: 3}
    assert found.completion == {0: 2, 1: 2, 2: 1, 3: 1} and all(found.completed.values())
    assert max(p["active_queries"] for p in found.profiles) <= slots


@pytest.mark.parametrize("kind", ["bfs", "sssp", "sswp", "ssnp", "viterbi"])
def test_random_directed_graphs(spark, kind):
    rng = random.Random(kind)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 9))) for _ in range(110)]
    best = {}
    for a, b, w in edges:
        best.setdefault((a, b), []).append(w)
    sources = [edges[0][0], edges[1][1], edges[2][0]]
    results = [run_batch(graph(spark, edges), [Query(i, kind, s) for i, s in enumerate(sources)], mode=m) for m in ("push", "pull")]
    for r in results:
        for i, s in enumerate(sources):
            assert values(r, i) == pytest.approx(brute(edges, kind, s))


def test_delayed_and_cut_off(spark):
    g = graph(spark, [(i, i + 1) for i in range(6)])
    late = run_batch(g, [Query(0, "bfs", 0), Query(1, "bfs", 3)], start_level={1: 2})
    assert values(late, 1) == {3: 0, 4: 1, 5: 2, 6: 3} and late.completion == {0: 6, 1: 3}
    cut = run_batch(g, [Query(0, "bfs", 0)], max_iterations=2)
    assert values(cut, 0) == {0: 0, 1: 1, 2: 2} and cut.completed == {0: False}


def test_rejected_batches(spark):
    g = graph(spark, TOY)
    for bad in ([], [Query(0, "bfs", -1)], [Query(0, "bfs", 99)], [Query(0, "dfs", 0)], [Query(0, "bfs", 0), Query(0, "bfs", 1)]):
        with pytest.raises(ValueError):
            run_batch(g, bad)
    with pytest.raises(ValueError):
        run_batch(g, [Query(0, "wcc"), Query(1, "wcc")], slots=1)
    with pytest.raises(ValueError):
        run_batch(g, [Query(0, "bfs", 0)], mode="sideways")


def test_components_on_a_chain(spark):
    e = attach_chain(spark.createDataFrame([(0, 1), (2, 1), (5, 6)], "src long, dst long"), 50)
    found = {r.vertex: r.component for r in connected_components(e).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, **dict.fromkeys(range(7, 57), 7)}
    assert run_batch(Graph(e), [Query(0, "wcc")], mode="push").completion[0] >= 49


@pytest.mark.parametrize("options", [{"mode": "hybrid"}, {"mode": "push"}, {"mode": "pull"}, {"max_iterations": 50}])
def test_labels_beyond_doubles(spark, options):
    b = 2**53
    g = graph(spark, [(b + 1, b), (b + 5, b + 3)])
    found = run_batch(g, [Query(0, "wcc"), Query(1, "bfs", b + 5)], **options)
    assert {r.vertex: r.label for r in found.state.where("query_id = 0").collect()} == {b: b, b + 1: b, b + 3: b + 3, b + 5: b + 3}
    assert values(found, 1) == {b + 5: 0, b + 3: 1}


def test_more_queries_than_columns_and_split_hubs(spark):
    rng = random.Random(4)
    edges = [(0, rng.randrange(60), float(rng.randint(1, 9))) for _ in range(80)] + [(rng.randrange(60), rng.randrange(60), float(rng.randint(1, 9))) for _ in range(120)]
    kinds = ["bfs", "sssp", "sswp", "ssnp", "viterbi"]
    queries = [Query(i, kinds[i % 5], edges[i + 80][0]) for i in range(9)]
    for options in ({"width": 3}, {"width": 2, "slots": 3}, {"hub_edges": 7}, {"mode": "shared", "width": 4, "touch_rows": 0}):
        found = run_batch(graph(spark, edges), queries, **options)
        for q in queries:
            assert values(found, q.query_id) == pytest.approx(brute(edges, q.kind, q.source))


def test_levels_write_their_frontier_only(spark):
    """A long path beside a large finished part: late levels write one row, not the state."""
    star = [(0, i) for i in range(1, 4000)]
    path = [(0, 10_000)] + [(10_000 + i, 10_001 + i) for i in range(12)]
    found = run_batch(graph(spark, star + path), [Query(0, "bfs", 0), Query(1, "sssp", 0)], mode="push", profile=True)
    bytes_by_level = {p["iteration"]: (p["frontier_size"], p["bytes_written"]) for p in found.profiles}
    assert max(b for i, (_, b) in bytes_by_level.items() if i > 1) * 4 < bytes_by_level[0][1]
    assert len(values(found, 0)) == 4013 and found.completion == {0: 13, 1: 13}


def test_options_of_a_batch(spark):
    g = graph(spark, TOY)
    found = run_batch(g, [Query(0, "bfs", 0)], discard_results=True, variant="warp")
    assert found.state.isEmpty() and found.completion == {0: 2} and found.completed == {0: True} and found.variant == "warp"
    with pytest.raises(ValueError):
        run_batch(g, [Query(0, "bfs", 0)], variant="sideways")


def test_dense_levels_by_pairs_and_by_edges(spark):
    g = graph(spark, [(0, 1), (1, 2), *[(2, i) for i in range(3, 30)]])
    modes = lambda **o: [p["mode"] for p in run_batch(g, [Query(0, "bfs", 0)], profile=True, **o).profiles]
    assert modes() == ["push", "push", "pull", "pull"]  # level 2: one vertex holds most edges; level 3: most vertices
    assert modes(pull_edges=2.0) == ["push", "push", "push", "pull"]
    assert modes(pull_edges=2.0, pull_share=2.0) == ["push"] * 4


def test_hub_scheduling(spark):
    g = graph(spark, [(0, 1), (0, 2), (0, 3), (4, 0), (5, 4), (6, 5)])
    assert {r.id: r.hops for r in fixpoint.hops_to_hubs(g, 1).collect()} == {0: 0, 4: 1, 5: 2, 6: 3}
    q = [Query(0, "bfs", 6), Query(1, "bfs", 4), Query(2, "bfs", 0)]
    assert [[x.source for x in b] for b in fixpoint.affinity_batches(g, q, 2, 1)] == [[0, 4], [6]]
    assert fixpoint.delayed_starts(g, q, 1) == {0: 0, 1: 2, 2: 3}
    rows = fixpoint.parents(g, run_batch(g, [Query(0, "bfs", 6)])).collect()
    assert {r.vertex: r.parent for r in rows} == {5: 6, 4: 5, 0: 4, 1: 0, 2: 0, 3: 0}


def test_batch_sswp_equals_its_sql_on_halves_nulls_and_no_rows(spark, tmp_path):
    import duckdb

    from weftgraph.plans import catalog

    kind = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    halves = [(1, 1, 10, 1, 2.5), (1, 2, 11, 1, 3.5), (1, 3, 12, 1, 4.6), (1, 4, 13, 1, 1.0)]
    no_line = [(1, None, 10, 1, 9.0), (1, 1, 11, 1, 5.0), (1, 2, 12, 1, 7.0)]
    no_part = [(1, 1, 10, 1, 5.0), (1, 2, None, 1, 6.0), (1, 2, 12, 1, 7.0), (2, 1, 10, 1, 3.0), (2, 2, 13, 1, 3.0)]
    no_quantity = [(1, 1, 10, 1, 5.0), (1, 2, 11, 1, None), (1, 3, 12, 1, 7.0)]
    for name, rows in {"halves": halves, "line": no_line, "part": no_part, "quantity": no_quantity, "empty": []}.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/{name}/lineitem.parquet/*.parquet'")
            want = set(c.execute(catalog.SQL["batch_sswp"]).fetchall())
        assert {tuple(r) for r in catalog.QUERIES["batch_sswp"](spark, f"{tmp_path}/{name}").collect()} == want, name
