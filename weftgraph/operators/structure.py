"""Structure of a graph: cores, triangles, spanning forests, colourings, betweenness, modularity, orders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.components import connected_components
from weftgraph.operators.sampling import uniform
from weftgraph.plans.prefix import running_total
from weftgraph.plans.scratch import bucketed, materialize, release, reread


def components(graph: Graph) -> DataFrame:
    """(id, component): weak components, named by their smallest vertex; isolated vertices too."""
    found = connected_components(graph.edges).withColumnRenamed("vertex", "id")
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def undirected(graph: Graph) -> DataFrame:
    """(u, v) with u < v, each pair once."""
    return graph.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("other")))


def kcore(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(id, core) over undirected edges. The h-index of the neighbours' values, repeated to its fixpoint: far fewer rounds than peeling."""
    both = materialize(_both(undirected(graph)))
    value = materialize(both.groupBy("id").agg(F.count(F.lit(1)).alias("core")))
    for _ in range(max_rounds):
        seen = both.join(value.select(F.col("id").alias("other"), F.col("core").alias("c")), "other")
        # the h-index from counts per value: value c is reached by all neighbours of c or more
        per = seen.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"))
        reach = per.withColumn("at_least", F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("c"))))
        h = reach.groupBy("id").agg(F.max(F.least("c", "at_least")).alias("h"))
        fresh = materialize(value.join(h, "id").select("id", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")))
        release(value)
        value = fresh.drop("moved")
        value._weft_path = fresh._weft_path
        if fresh.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"cores did not settle in {max_rounds} rounds")
    release(both)
    return graph.vertices.join(value, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"))


def _oriented(pairs: DataFrame) -> DataFrame:
    """(a, b, u, v, d): each pair from its end of lower degree to that of higher, ties by id; d is the higher degree."""
    deg = _both(pairs).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(deg.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return ranked.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"), "u", "v", F.greatest("du", "dv").alias("d"))


def triangle_rows(pairs: DataFrame, share: int = 4) -> DataFrame:
    """(a, b, c): each triangle of pairs(u, v), u < v, each pair once.

    A vertex's list of later neighbours, by degree and id, holds at most the root of twice the edges. To each of them goes what follows it in the
    list, as one row, to meet its own list. The vertices are dealt out in slices whose rows hold about `share` ids for each edge, so the disk
    stays in proportion to the edges whatever their density.
    """
    late = F.array_sort(F.collect_list(F.struct("d", "b")))
    lists = bucketed(_oriented(pairs.select("u", "v")).groupBy("a").agg(late.alias("late")).select("a", F.col("late.b").alias("late")), "a")
    n = F.size("late").cast("long")
    edges, ids = lists.agg(F.sum(n), F.sum(n * (n - 1) / 2)).first()
    slices = max(1, math.ceil((ids or 0) / (share * (edges or 1))))
    near = lists.select(F.col("a").alias("b"), F.col("late").alias("near")).hint("shuffle_hash")
    found = []
    for k in range(slices):
        some = lists.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == k).select("a", "late", F.posexplode("late").alias("at", "b"))
        rest = some.where(F.col("at") < F.size("late") - 1).select("a", "b", F.slice("late", F.col("at") + 2, F.size("late") - F.col("at") - 1).alias("rest"))
        found.append(materialize(rest.join(near, "b").select("a", "b", F.explode(F.array_intersect("rest", "near")).alias("c"))))
    out = found[0] if slices == 1 else materialize(reread(found[0], [f._weft_path for f in found]))
    release(lists, *(found if slices > 1 else []))
    return out


def triangles(graph: Graph) -> DataFrame:
    """(id, triangles): triangles of undirected edges at each vertex; loops don't count. The sum is three times the triangles.

    Edges point from lower to higher degree, so a hub's pairs of neighbours are never formed.
    """
    out = materialize(_oriented(undirected(graph)).drop("d"))
    wedge = out.select("a", "b").join(out.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = wedge.join(out.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"])
    counts = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return graph.vertices.join(counts, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def spanning_forest(graph: Graph, allow_forest: bool = True, max_rounds: int = 64) -> DataFrame:
    """(u, v, weight) of a minimum spanning forest by Boruvka's rounds; ties go to the smaller pair."""
    pairs = graph.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("weight").alias("weight"))
    pairs = materialize(pairs)
    label = materialize(graph.vertices.select("id", F.col("id").alias("c")))
    chosen = pairs.where("false")
    for _ in range(max_rounds):
        open_ = pairs.join(label.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(label.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu <> cv")
        ends = open_.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("weight", "u", "v", "cu", "cv").alias("e"))
        least = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if least.isEmpty():
            break
        chosen = materialize(chosen.unionByName(least.select("u", "v", "weight")))
        merged = connected_components(least, "cu", "cv").select(F.col("vertex").alias("c"), F.col("component").alias("new"))
        fresh = materialize(label.join(merged, "c", "left").select("id", F.coalesce("new", "c").alias("c")))
        release(label, least)
        label = fresh
    else:
        raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")
    if not allow_forest and label.select("c").distinct().count() > 1:
        raise ValueError("the graph is not connected")
    return chosen


def coloring(graph: Graph, seed: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """(id, color): in round i, uncoloured vertices with the largest hashed priority around get colour 2i, those with the smallest 2i + 1."""
    both = materialize(_both(undirected(graph)))
    left = materialize(graph.vertices.select("id", uniform(seed, "id").alias("p")))
    done = left.where("false").select("id", F.lit(0).alias("color"))
    for i in range(max_rounds):
        if left.isEmpty():
            break
        around = both.join(left.select("id"), "id").join(left.select(F.col("id").alias("other"), F.struct("p", F.col("id").alias("i")).alias("q")), "other").groupBy("id").agg(F.max("q").alias("hi"), F.min("q").alias("lo"))
        own = F.struct("p", F.col("id").alias("i"))
        state = left.join(around, "id", "left").withColumn("color", F.when(F.col("hi").isNull() | (own > F.col("hi")), 2 * i).when(own < F.col("lo"), 2 * i + 1))
        state = materialize(state.select("id", "p", F.col("color").cast("int").alias("color")))
        done = materialize(done.unionByName(state.where("color is not null").select("id", "color")))
        fresh = materialize(state.where("color is null").select("id", "p"))
        release(left, state)
        left = fresh
    else:
        raise RuntimeError(f"vertices are left without a colour after {max_rounds} rounds")
    release(both)
    return done


def betweenness(graph: Graph, sources: list[int], max_levels: int = 10_000) -> DataFrame:
    """(id, bc): summed over the sources, each dependency times 0.5, sources excluded (Brandes, by levels, one batch)."""
    spark = graph.edges.sparkSession
    e = materialize(graph.edges.select("src", "dst").where("src <> dst").distinct())
    level = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "q int, id long").select("q", "id", F.lit(1.0).alias("sigma"), F.lit(0).alias("level"))
    seen = level = materialize(level)
    depth = 0
    while depth < max_levels:
        step = level.join(e, level["id"] == e["src"]).groupBy("q", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        level = materialize(step.join(seen.select("q", "id"), ["q", "id"], "left_anti").select("q", "id", "sigma", F.lit(depth + 1).alias("level")))
        if level.isEmpty():
            break
        depth += 1
        seen = materialize(seen.unionByName(level))
    else:
        raise RuntimeError(f"more than {max_levels} levels")
    delta = seen.where("false").select("q", "id", F.lit(0.0).alias("delta"))
    for d in range(depth - 1, -1, -1):
        below = seen.where(F.col("level") == d + 1).join(delta, ["q", "id"], "left").select("q", F.col("id").alias("dst"), (F.lit(1.0) + F.coalesce("delta", F.lit(0.0))).alias("one"), F.col("sigma").alias("sigma_dst"))
        here = seen.where(F.col("level") == d)
        got = here.join(e, here["id"] == e["src"]).join(below, ["q", "dst"]).groupBy("q", "id").agg(F.sum(F.col("sigma") / F.col("sigma_dst") * F.col("one")).alias("delta"))
        delta = materialize(delta.unionByName(got))
    total = delta.join(seen.where("level = 0").select("q", "id"), ["q", "id"], "left_anti").groupBy("id").agg((0.5 * F.sum("delta")).alias("bc"))
    return graph.vertices.join(total, "id", "left").select("id", F.coalesce("bc", F.lit(0.0)).alias("bc"))


def betweenness_all(graph: Graph, batch: int = 2048) -> DataFrame:
    """(id, bc) over all sources, in batches: a batch shares each level's scan of the edges, and vertices without out-edges add nothing as sources.

    Only ids of sources reach the driver, `batch` at a time; each batch's sums are written and added up.
    """
    e = materialize(graph.edges)
    g = Graph(e, graph.vertices)
    # a source counts only if a path of two edges leaves it
    second = e.where("src <> dst").select(F.col("src").alias("dst")).distinct()
    useful = materialize(running_total(e.join(second, "dst", "left_semi").select(F.col("src").alias("id")).distinct(), ["id"], F.lit(1).cast("long"), "k"))
    total = g.vertices.select("id", F.lit(0.0).alias("bc"))
    for a in range(0, useful.count(), batch):
        chunk = [r.id for r in useful.where((F.col("k") >= a) & (F.col("k") < a + batch)).select("id").collect()]
        got = betweenness(g, chunk).where("bc <> 0").unionByName(total)
        total = materialize(got.groupBy("id").agg(F.sum("bc").alias("bc")))
    return total


def modularity(graph: Graph, labels: DataFrame, adjacent_only: bool = True) -> float:
    """Modularity of labels(id, component) over stored (directed) edges; adjacent_only compares only pairs joined by an edge, the textbook form all pairs."""
    m2 = graph.edges.count()
    if not m2:
        return 0.0
    deg = graph.out_degree()
    lab = labels.select("id", "component").join(deg, "id")
    e = graph.edges.join(lab.selectExpr("id as src", "component as a", "degree as ka"), "src").join(lab.selectExpr("id as dst", "component as b", "degree as kb"), "dst")
    if adjacent_only:
        return e.agg(F.sum(F.when(F.col("a") == F.col("b"), 1 - F.col("ka") * F.col("kb") / m2).otherwise(0.0))).first()[0] / m2
    inside = e.where("a = b").count() / m2
    return inside - (lab.groupBy("component").agg(F.sum("degree").alias("k")).agg(F.sum((F.col("k") / m2) ** 2)).first()[0] or 0.0)


def topological_layers(graph: Graph, max_layers: int = 100_000) -> DataFrame:
    """(id, layer) by Kahn's rounds; vertices on or behind cycles are left out."""
    e = graph.edges.select("src", "dst").distinct()
    left, done, layer = materialize(graph.vertices), None, 0
    while layer < max_layers:
        inner = e.join(left.withColumnRenamed("id", "src"), "src", "left_semi")
        ready = materialize(left.join(inner.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(layer).alias("layer")))
        if ready.isEmpty():
            break
        done = ready if done is None else materialize(done.unionByName(ready))
        left = materialize(left.join(ready, "id", "left_anti"))
        layer += 1
    else:
        raise RuntimeError(f"more than {max_layers} layers")
    return done if done is not None else graph.vertices.where("false").select("id", F.lit(0).alias("layer"))


def radii(graph: Graph, sources: list[int]) -> DataFrame:
    """(id, radius): the largest hop distance from any of the sources that reach the vertex."""
    from weftgraph.operators.fixpoint import Query, run_batch

    found = run_batch(graph, [Query(i, "bfs", s) for i, s in enumerate(sources)], mode="push")
    return found.state.groupBy(F.col("vertex").alias("id")).agg(F.max("value").cast("long").alias("radius"))


def bellman_ford(graph: Graph, source: int) -> tuple[DataFrame, bool]:
    """((id, dist), whether a negative cycle is reachable). Edges may have negative weights."""
    from weftgraph.operators.fixpoint import Query, run_batch

    n = graph.vertices.count()
    found = run_batch(graph, [Query(0, "sssp", source)], mode="push", max_iterations=n + 1)
    return found.state.select(F.col("vertex").alias("id"), F.col("value").alias("dist")), not found.completed[0]
