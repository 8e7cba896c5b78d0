import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import forest, geo, linear, messages, ranking, ricci, sampling, structure, transforms
from weftgraph.plans.scratch import materialize


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(8)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(70)) if a != b})
    rows = [(a, b, float(rng.randint(1, 9))) for a, b in pairs]
    return rows, Graph(spark.createDataFrame(rows, "src long, dst long, weight double"))


def neighbours(rows):
    nb = {}
    for a, b, _ in rows:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    return nb


def test_kcore(net):
    rows, g = net
    nb, core, k = neighbours(rows), {}, 0
    left = {v: set(n) for v, n in nb.items()}
    while left:
        low = [v for v in left if len(left[v]) <= k]
        if not low:
            k += 1
        for v in low:
            core[v] = k
            for w in left.pop(v):
                left.get(w, set()).discard(v)
    assert {r.id: r.core for r in structure.kcore(g).collect()} == core


def test_spanning_forest(spark, net):
    rows, g = net
    root = {v: v for v in neighbours(rows)}
    find = lambda v: v if root[v] == v else find(root[v])
    total = 0.0
    for a, b, w in sorted(rows, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    assert structure.spanning_forest(g).agg(F.sum("weight")).first()[0] == total
    apart = Graph(spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src long, dst long, weight double"))
    with pytest.raises(ValueError):
        structure.spanning_forest(apart, allow_forest=False)


def test_triangles_of_two(spark):
    e = [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (0, 0)]
    found = {r.id: r.triangles for r in structure.triangles(Graph(spark.createDataFrame(e, "src long, dst long"))).collect()}
    assert found == {0: 2, 1: 1, 2: 2, 3: 1}


def test_coloring_is_valid(net):
    rows, g = net
    color = {r.id: r.color for r in structure.coloring(g).collect()}
    assert set(color) == set(neighbours(rows)) and all(color[a] != color[b] for a, b, _ in rows)


def test_betweenness(net):
    rows, g = net
    both = g.symmetric()
    nb, want = neighbours(rows), {}
    for s in (0, 1):
        dist, sigma, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in sorted(nb[v]):
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in nb[v]:
                if dist[w] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
        for v in order:
            if v != s:
                want[v] = want.get(v, 0.0) + delta[v] / 2
    got = {r.id: r.bc for r in structure.betweenness(both, [0, 1]).collect()}
    assert got == pytest.approx({v: want.get(v, 0.0) for v in got})


def test_pagerank_sums_to_one_and_settles(net):
    _, g = net
    ranks, info = ranking.pagerank_sweep(g, [(0.85, 1e-7), (0.5, 1e-4)], 100, weighted=True)
    for run in (0, 1):
        assert ranks.where(f"run = {run}").agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    its = {r.run: r.max_iterations for r in info.collect()}
    assert its[1] < its[0] < 100


def test_pagerank_sweep_goes_on_until_l1_settles(net):
    rows, g = net
    ids = sorted({v for a, b, _ in rows for v in (a, b)})
    at, settings, limit = {v: i for i, v in enumerate(ids)}, [(0.85, 1e-4), (0.5, 1e-6), (0.85, 1e-30)], 40
    step = np.zeros((len(ids), len(ids)))
    for a, b, _ in rows:
        step[at[b], at[a]] = 1 / sum(a == x for x, _, _ in rows)
    loose = step.sum(axis=0) == 0
    want = {}
    for run, (alpha, tol) in enumerate(settings):
        rank, l1, top = np.full(len(ids), 1 / len(ids)), limit, limit
        for it in range(1, limit + 1):
            new = (1 - alpha + alpha * rank[loose].sum()) / len(ids) + alpha * step @ rank
            delta, rank = np.abs(new - rank), new
            l1, top = min(l1, it if delta.sum() < tol else limit), min(top, it if delta.max() < tol else limit)
            if max(l1, top) <= it:
                break
        want[run] = (l1, top, rank)
    ranks, info = ranking.pagerank_sweep(g, settings, limit)
    assert {r.run: (r.l1_iterations, r.max_iterations) for r in info.collect()} == {k: v[:2] for k, v in want.items()}
    assert want[0][1] < want[0][0] < limit
    for r in ranks.collect():
        assert r.rank == pytest.approx(want[r.run][2][at[r.id]], abs=1e-12)


def test_personalized_pagerank_bound(net):
    _, g = net
    rows = ranking.personalized_pagerank(g.symmetric(), [0, 3], epsilon=1e-3).collect()
    for q in (0, 1):
        assert sum(r.p + r.r for r in rows if r.query_id == q) == pytest.approx(1.0)


def test_topological_layers_leave_cycles_out(spark):
    g = Graph(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (2, 5)], "src long, dst long"))
    assert {r.id: r.layer for r in structure.topological_layers(g).collect()} == {0: 0, 1: 1, 2: 2, 5: 3}


def test_bellman_ford_finds_negative_cycles(spark):
    mk = lambda rows: Graph(spark.createDataFrame(rows, "src long, dst long, weight double"))
    dist, bad = structure.bellman_ford(mk([(0, 1, 4.0), (0, 2, 5.0), (2, 1, -3.0)]), 0)
    assert {r.id: r.dist for r in dist.collect()} == {0: 0.0, 1: 2.0, 2: 5.0} and not bad
    assert structure.bellman_ford(mk([(0, 1, 1.0), (1, 2, -2.0), (2, 1, 1.0)]), 0)[1]


def test_modularity_forms(spark):
    both = [(0, 1), (1, 0), (2, 3), (3, 2)]
    g = Graph(spark.createDataFrame(both, "src long, dst long"))
    lab = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, component long")
    assert structure.modularity(g, lab, adjacent_only=False) == pytest.approx(0.5)
    assert structure.modularity(g, lab) == pytest.approx(0.75)


def test_ricci_of_a_triangle_and_a_path(spark):
    e = lambda rows: spark.createDataFrame([(a, b, 1.0) for a, b in rows], "u long, v long, w double")
    tri = ricci.curvature(e([(0, 1), (0, 2), (1, 2)])).first().curvature
    assert tri == pytest.approx(2 + 1 / math.sqrt(1.5 * 0.125))
    assert {(r.u, r.v): r.curvature for r in ricci.curvature(e([(0, 1), (1, 2)])).collect()} == {(0, 1): 1.0, (1, 2): 1.0}
    g = Graph(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long"))
    flowed = ricci.ricci_flow(g, 3)
    assert flowed.agg(F.avg("w")).first()[0] == pytest.approx(1.0)
    labels, q = ricci.ricci_communities(g, 1, max_cuts=3)
    assert labels.count() == 4 and q > -1


def test_ricci_cuts_reach_every_weight(spark):
    rng = random.Random(2)
    pairs = [(a, b) for a in range(30) for b in range(a) if rng.random() < (0.4 if a // 10 == b // 10 else 0.03)]
    flowed = spark.createDataFrame([(b, a, 0.5 + rng.random() * 9) for a, b in pairs], "u long, v long, w double")
    w = sorted(r.w for r in flowed.collect())
    cuts = ricci.cut_offs(flowed)
    top = max(c for c in cuts if c not in w)
    assert {x for x in w if x > top} < set(cuts) and min(cuts) - 0.25 < 1.1 * w[0] <= min(cuts) and len(cuts) > 8
    both = Graph(flowed.selectExpr("u as src", "v as dst").unionByName(flowed.selectExpr("v as src", "u as dst")))
    some = cuts[:: len(cuts) // 6]
    want = [structure.modularity(both, structure.components(Graph(flowed.where(F.col("w") < c).selectExpr("u as src", "v as dst"), both.vertices))) for c in some]
    assert ricci.cut_modularity(flowed, some, block=3) == pytest.approx(want)


def test_geolocate(spark):
    g = Graph(spark.createDataFrame([(0, 1), (0, 2), (3, 1), (4, 0)], "src long, dst long"))
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 90.0)], "id long, lat double, lon double")
    got = {r.id: (r.lat, r.lon) for r in geo.geolocate(g, places, 2, 5).collect()}
    assert got[0] == pytest.approx((0.0, 45.0)) and got[3] == pytest.approx((0.0, 0.0)) and got[4] == pytest.approx((0.0, 45.0))


def test_linear_algebra(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, -2.0), (2, 0, 3.0)], "row long, col long, val double")
    got = {(r.row, r.col): r.val for r in linear.mxm(m, m).collect()}
    assert got == {(0, 0): 1.0, (0, 1): -2.0, (1, 1): 4.0, (2, 0): 3.0, (2, 1): 6.0}
    x = spark.createDataFrame([(0, 1.0), (1, 1.0)], "idx long, val double")
    assert {r.idx: r.val for r in linear.spmv(m, x, spark.range(4)).collect()} == {0: 3.0, 1: -2.0, 2: 3.0, 3: 0.0}
    assert {(r.row, r.col): r.val for r in linear.mxm(m, m, "min_plus").collect()}[(0, 1)] == 0.0


def test_khop_equals_repeated_copy_and_sum(net):
    _, g = net
    ones = g.vertices.withColumn("h", F.lit(1.0))
    h = ones
    for _ in range(2):
        h = messages.update_all(g.edges, h, messages.copy("u", "h"), "sum", "h", default=F.lit(0.0))
    walks = transforms.khop(g, 2).groupBy(F.col("col").alias("id")).agg(F.sum("val").alias("h"))
    want = {r.id: r.h for r in walks.collect()}
    assert {r.id: r.h for r in h.collect() if r.h} == want


def test_sampling(spark, net):
    rows, g = net
    nodes = g.vertices
    got = sampling.sample_neighbors(g.edges, nodes, 2, weight="weight", seed=3).collect()
    assert got == sampling.sample_neighbors(g.edges, nodes, 2, weight="weight", seed=3).collect()
    assert all((r.src, r.dst, r.weight) in set(rows) for r in got)
    per = {}
    for a, b, _ in rows:
        per[b] = per.get(b, 0) + 1
    assert len(got) == sum(min(2, n) for n in per.values())
    drawn = sampling.sample_neighbors(g.edges, nodes, 4, weight="weight", replace=True).collect()
    assert len(drawn) == 4 * len(per)
    edges = {(a, b) for a, b, _ in rows}
    for r in sampling.random_walk(g.edges, nodes.select(F.col("id").alias("walk"), "id"), 5).collect():
        assert len(r.trace) == 6
        for a, b in zip(r.trace, r.trace[1:]):
            assert (a, b) in edges or b == -1
    assert not {(r.src, r.dst) for r in sampling.negative_edges(g.edges, nodes, 2).collect()} & edges


def test_hetero_and_parallel_edges(spark):
    follow = spark.createDataFrame([(0, 1), (1, 3), (2, 2), (1, 3), (1, 4), (1, 4)], "src long, dst long")
    assert {(r.src, r.dst): r.n for r in Graph(follow).simple().collect()} == {(0, 1): 1, (1, 3): 2, (2, 2): 1, (1, 4): 2}
    assert Graph(follow).is_multigraph() and not Graph(follow.distinct()).is_multigraph()
    plays = spark.createDataFrame([(3, 0), (2, 1)], "src long, dst long")
    homo = transforms.to_homogeneous({("user", "follow", "user"): follow, ("user", "plays", "game"): plays}, {"user": 5, "game": 2})
    assert {tuple(r) for r in homo.where("etype = 'plays'").collect()} == {(5, 0, "plays"), (4, 1, "plays")}
    assert transforms.laplacian_lambda_max(Graph(spark.createDataFrame([(0, 1)], "src long, dst long"))) == pytest.approx(2.0)


def test_laplacian_with_close_eigenvalues(spark):
    def both(pairs):
        ids = {v: i for i, v in enumerate(sorted({v for p in pairs for v in p}))}
        a = np.zeros((len(ids), len(ids)))
        for u, v in pairs:
            a[ids[u], ids[v]] = a[ids[v], ids[u]] = 1.0
        half = np.diag(a.sum(axis=0) ** -0.5)
        got = transforms.laplacian_lambda_max(Graph(spark.createDataFrame(pairs, "src long, dst long")), 60)
        return got, np.linalg.eigvalsh(np.eye(len(ids)) - half @ a @ half)[-1]

    stars = [(0, i) for i in range(10, 50)] + [(1, i) for i in range(50, 92)] + [(2, 0), (2, 1)]
    assert both(stars)[0] == 2.0
    got, want = both([*stars, (10, 11), (50, 51)])  # an odd cycle at each hub
    assert got == pytest.approx(want, abs=1e-9)
    assert both([(0, 1), (1, 2), (2, 0), (100, 101)])[0] == 2.0


def brute_curvature(weights):
    nb = {}
    for (u, v), w in weights.items():
        nb.setdefault(u, {})[v] = nb.setdefault(v, {})[u] = w
    out = {}
    for (u, v), w in weights.items():
        c = 2 / w
        for x in (nb[u].keys() | nb[v].keys()) - {u, v}:
            a, b = nb[u].get(x), nb[v].get(x)
            if a and b:
                s = (w + a + b) / 2
                c += w / math.sqrt(max(abs(s * (s - w) * (s - a) * (s - b)), 1e-12))
            else:
                c -= 1 / math.sqrt(w * (a or b))
        out[u, v] = min(max(w * c, -1e5), 1e5)
    return out


def test_triangle_rows_in_slices(spark):
    rng = random.Random(5)
    pairs = sorted({(min(p), max(p)) for p in ((rng.randrange(40), int(40 * rng.random() ** 2)) for _ in range(300)) if p[0] != p[1]})
    want = sorted((a, b, c) for a, b in pairs for c in range(b + 1, 40) if (a, c) in pairs and (b, c) in pairs)
    e = spark.createDataFrame(pairs, "u long, v long")
    for share in (4, 1):
        assert sorted(tuple(sorted(r)) for r in structure.triangle_rows(e, share).collect()) == want
    assert len(want) > 20 and structure.triangle_rows(e.where("u < 0")).isEmpty()


def test_ricci_of_a_hub_makes_no_row_for_each_pair_of_its_edges(spark):
    n = 100_000  # 10^10 such rows
    star = spark.range(1, n + 1).selectExpr("0L AS u", "id AS v").unionByName(spark.createDataFrame([(1, 2)], "u long, v long")).withColumn("w", F.lit(1.0))
    got = {(r.u, r.v): r.curvature for r in ricci.curvature(star).where("v <= 3").collect()}
    shared = 1 / math.sqrt(1.5 * 0.125)
    assert got == pytest.approx({(0, 1): 2 + shared - (n - 2), (0, 2): 2 + shared - (n - 2), (0, 3): 2 - (n - 1), (1, 2): 2 + shared})


def test_ricci_flow_of_a_random_graph(spark):
    rng = random.Random(6)
    weights = {p: 1.0 for p in {(min(p), max(p)) for p in ((rng.randrange(16), rng.randrange(16)) for _ in range(60)) if p[0] != p[1]}}
    for _ in range(2):
        c = brute_curvature(weights)
        step = min(1.0, 1 / (1.1 * max(map(abs, c.values())) + 1e-10))
        moved = {p: max(w * (1 - step * c[p]), 1e-6) for p, w in weights.items()}
        weights = {p: w * len(moved) / sum(moved.values()) for p, w in moved.items()}
    c = brute_curvature(weights)
    found = ricci.ricci_flow(Graph(spark.createDataFrame(sorted(weights), "src long, dst long")), 2).collect()
    assert {(r.u, r.v): r.w for r in found} == pytest.approx(weights) and {(r.u, r.v): r.curvature for r in found} == pytest.approx(c)


def test_many_ricci_cuts_take_few_rounds(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(b, a) for a in range(40) for b in range(a) if rng.random() < 0.1]
    weights = [0.5 + rng.random() * 9 for _ in pairs]
    flowed = spark.createDataFrame([(u, v, w) for (u, v), w in zip(pairs, weights)], "u long, v long, w double")
    cuts = [*weights, 0.1, 5.0, 5.0, 11.0]
    rounds, run = [], ricci.connected_components
    monkeypatch.setattr(ricci, "connected_components", lambda e: rounds.append(1) or run(e))
    deg = {x: sum(x in p for p in pairs) for x in range(40)}
    m2, want = 2 * len(pairs), []
    for cut in cuts:
        label = {x: x for x in range(40)}
        for (u, v), w in zip(pairs, weights):
            if w < cut and label[u] != label[v]:
                label = {x: label[v] if c == label[u] else c for x, c in label.items()}
        want.append(sum(2 * (1 - deg[u] * deg[v] / m2) / m2 for u, v in pairs if label[u] == label[v]))
    assert ricci.cut_modularity(flowed, cuts) == pytest.approx(want) and len(cuts) > 64
    assert len(rounds) <= 5


def test_ricci_communities_by_one_forest(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(b, a) for a in range(60) for b in range(a) if rng.random() < (0.15 if a // 20 == b // 20 else 0.0)]
    flowed = spark.createDataFrame([(u, v, rng.randint(1, 12) / 4) for u, v in pairs], "u long, v long, w double").repartition(3).cache()  # equal weights, parts without a link
    graph = Graph(spark.createDataFrame([*pairs, (99, 99)], "src long, dst long"))
    monkeypatch.setattr(ricci, "ricci_flow", lambda g, n: materialize(flowed))
    monkeypatch.setattr(forest, "CHUNK", 20)
    cuts = ricci.cut_offs(flowed)
    assert flowed.agg(F.percentile("w", 0.999)).first()[0] in cuts and len(cuts) > 8
    deg = ricci._weighted(flowed).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    held = spark.sparkContext.broadcast(forest.tree(flowed, deg))
    rising = sorted(cuts)
    gains = forest.cut_gains(flowed, held, rising, len(pairs))
    assert list(np.cumsum(gains)) == pytest.approx(ricci.cut_modularity(flowed, rising))
    for cut in rising[1::4]:
        both = Graph(flowed.where(F.col("w") < cut).selectExpr("u as src", "v as dst"), deg.select("id"))
        assert set(forest.labelled(deg, held, cut).collect()) == set(structure.components(both).collect())
    searched = []
    monkeypatch.setattr(ricci, "connected_components", lambda e, run=ricci.connected_components: searched.append(1) or run(e))
    labels, quality = ricci.ricci_communities(graph, 1)
    assert not searched and (99, 99) in set(labels.collect())
    monkeypatch.setattr(ricci, "FOREST_VERTICES", 0)
    other, same = ricci.ricci_communities(graph, 1)
    assert searched and quality == pytest.approx(same) and set(labels.collect()) == set(other.collect())


def test_ricci_flow_of_a_hub(spark):
    n = 100_000  # 10^10 rows if each edge met each neighbour
    flowed = ricci.ricci_flow(Graph(spark.range(1, n + 1).selectExpr("0L AS src", "id AS dst")), 1)
    assert tuple(flowed.agg(F.count("w"), F.min("w"), F.max("w")).first()) == pytest.approx((n, 1.0, 1.0))
