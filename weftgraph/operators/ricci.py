"""Forman-Ricci curvature flow on undirected edges, and communities cut at weight thresholds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import forest
from weftgraph.operators.components import connected_components
from weftgraph.operators.structure import components, triangle_rows, undirected
from weftgraph.plans.scratch import materialize, release

#: Up to so many vertices, one forest of the flow is held by a task and the driver; beyond, the cuts are searched by distributed components.
FOREST_VERTICES = 2_000_000


def _weighted(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("id"), F.col("v").alias("other"), "w").unionByName(e.select(F.col("v").alias("id"), F.col("u").alias("other"), "w"))


def curvature(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """edges(u, v, w), u < v -> (u, v, w, curvature) with vertex weights 1: w * (2/w + sum over triangles w/s - sum over exclusive neighbour
    edges 1/sqrt(w * w_other)), s from Heron's area of the triangle, clamped to +-100000.

    Exclusive neighbours are all neighbours of both ends less those of triangles, so an edge needs one sum of each end, and only edges in a
    triangle need more: no row is made for an edge and a neighbour. closed: the triangles (a, b, c) of the edges, if they are known already.
    """
    if closed is None:
        edges = materialize(edges)
        closed = triangle_rows(edges)
    pair = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    sides = closed.select("a", "b", "c", F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("e")).select("a", "b", "c", "e.u", "e.v")
    whole = sides.join(edges, ["u", "v"]).groupBy("a", "b", "c").agg(F.collect_list(F.struct("u", "v", "w")).alias("e"))
    w = [F.col("e")[k]["w"] for k in range(3)]
    s = (w[0] + w[1] + w[2]) / 2
    area = F.sqrt(F.greatest(F.abs(s * (s - w[0]) * (s - w[1]) * (s - w[2])), F.lit(1e-12)))
    each = whole.select(F.explode("e").alias("e"), area.alias("area"), sum(1 / F.sqrt(x) for x in w).alias("three")).select("e.*", "area", "three")
    shared = each.groupBy("u", "v").agg(F.sum(F.col("w") / F.col("area")).alias("t"), F.sum(F.col("three") - 1 / F.sqrt("w")).alias("both"), F.count(F.lit(1)).alias("n"))
    ends = _weighted(edges).groupBy("id").agg(F.sum(1 / F.sqrt("w")).alias("s"), F.count(F.lit(1)).alias("k"))
    at = lambda end: ends.select(F.col("id").alias(end), F.col("s").alias(f"s{end}"), F.col("k").alias(f"k{end}")).hint("shuffle_hash")
    all_ = edges.join(shared, ["u", "v"], "left").join(at("u"), "u").join(at("v"), "v")
    none = F.lit(0.0)
    others = F.greatest(F.col("su") + F.col("sv") - 2 / F.sqrt("w") - F.coalesce("both", none), none)
    alone = F.when(F.col("ku") + F.col("kv") - 2 > 2 * F.coalesce("n", F.lit(0)), others).otherwise(none)
    c = F.col("w") * (2 / F.col("w") + F.coalesce("t", none) - alone / F.sqrt("w"))
    return all_.select("u", "v", "w", F.least(F.greatest(c, F.lit(-1e5)), F.lit(1e5)).alias("curvature"))


def ricci_flow(graph: Graph, iterations: int = 10) -> DataFrame:
    """(u, v, w, curvature) after the flow: w <- max(w * (1 - step * c), 1e-6), step = min(1, 1 / (1.1 * max|c| + 1e-10)), mean weight kept at 1."""
    e = materialize(undirected(graph).withColumn("w", F.lit(1.0)))
    n = e.count()
    closed = triangle_rows(e)  # the flow changes weights only
    out = materialize(curvature(e, closed))
    release(e)
    for _ in range(iterations if n else 0):
        top = out.agg(F.max(F.abs("curvature"))).first()[0]
        step = min(1.0, 1.0 / (1.1 * top + 1e-10))
        moved = out.select("u", "v", F.greatest(F.col("w") * (1 - step * F.col("curvature")), F.lit(1e-6)).alias("w"))
        total = moved.agg(F.sum("w")).first()[0]
        fresh = materialize(curvature(moved.withColumn("w", F.col("w") * (n / total)), closed))
        release(out)
        out = fresh
    release(closed)
    return out


def cut_offs(flowed: DataFrame, step: float = 0.25) -> list[float]:
    """Weights to cut (u, v, w) at: every weight above the 99.9th percentile, rising, then from it in steps down to 1.1 times the least weight."""
    low, n = flowed.agg(F.min("w"), F.count("w")).first()
    if not n:
        return []
    at = 0.999 * (n - 1)  # the percentile's place among the rising weights; what lies above is read in any case
    last = [r.w for r in flowed.select("w").orderBy(F.desc("w")).limit(n - math.floor(at)).collect()][::-1]
    one, two = last[0], last[math.ceil(at) - math.floor(at)]
    top = one if one == two else (math.ceil(at) - at) * one + (at - math.floor(at)) * two
    above = sorted({w for w in last if w > top})
    below = [top]
    while below[-1] - step >= 1.1 * low:
        below.append(below[-1] - step)
    return above + below


def cut_modularity(flowed: DataFrame, cuts: list[float], block: int = 3) -> list[float]:
    """For each cut, modularity() of the components of the edges (u, v, w) below it, over all edges.

    Components only merge as the cut rises, so each edge needs but the least cut that connects its ends. All edges search it at once: a round
    tries `block` cuts spread over each span of cuts still open, on the span's own edges between the components of the cut below the span.
    Every edge is in one span, so a round handles each edge once for each cut tried, and log(cuts) / log(block + 1) rounds do.
    """
    spark = flowed.sparkSession
    order = sorted(range(len(cuts)), key=cuts.__getitem__)
    deg = _weighted(flowed).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    ends = flowed.join(deg.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(deg.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
    m2 = 2 * flowed.count()
    left = materialize(ends.select(F.lit(0).alias("span"), "u", "v", "w", (2 * (1 - F.col("ku") * F.col("kv") / m2) / m2).alias("gain")))
    joined = [0.0] * (len(cuts) + 1)  # by place in order: the gain of the edges that this cut connects first; the last are never connected
    spans = {0: (0, len(cuts))}  # places that may be the first, and the one that is if none of them
    while spans:
        tried = {s: sorted({low + (high - low) * (k + 1) // (block + 1) for k in range(block)}) for s, (low, high) in spans.items()}
        grid = F.broadcast(spark.createDataFrame([(s, p, float(cuts[order[p]])) for s, places in tried.items() for p in places], "span int, place int, cut double"))
        key = lambda c: F.struct("span", "place", F.col(c).alias("id"))
        kept = left.join(grid, "span").where("w < cut").select(key("u").alias("src"), key("v").alias("dst"))
        found = connected_components(kept)
        labels = found.select("vertex.span", "vertex.place", "vertex.id", F.col("component.id").alias("label"))

        def labelled(rows: DataFrame, labels: DataFrame = labels) -> DataFrame:
            for c in ("u", "v"):
                rows = rows.join(labels.select("span", "place", F.col("id").alias(c), F.col("label").alias(f"l{c}")), ["span", "place", c], "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
            return rows

        # an edge's first place that connects it ends its new span; the components of the place tried before begin it
        tests = labelled(left.join(grid, "span")).groupBy("span", "u", "v").agg(
            F.first("w").alias("w"), F.first("gain").alias("gain"), F.min(F.when(F.col("lu") == F.col("lv"), F.col("place"))).alias("first"),
            F.max(F.when(F.col("lu") != F.col("lv"), F.struct("place", "lu", "lv"))).alias("last"),
        )
        moved = tests.select("span", F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last.lu", "u").alias("a"), F.coalesce("last.lv", "v").alias("b"), "w", "gain")
        merged = materialize(moved.groupBy("span", "first", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("w").alias("w"), F.sum("gain").alias("gain")))
        release(left, found)
        inside, after = {}, []
        for s, (low, high) in spans.items():
            for at, end in zip([low, *[p + 1 for p in tried[s]]], [*tried[s], high]):
                inside[s, end if end < high else -1] = (at, end)
        for r in merged.groupBy("span", "first").agg(F.sum("gain").alias("gain")).collect():
            at, end = inside[r.span, r.first]
            if at == end:
                joined[end] += r.gain
            else:
                after.append((r.span, r.first, len(after), at, end))
        spans = {s: (at, end) for _, _, s, at, end in after}
        again = F.broadcast(spark.createDataFrame([x[:3] for x in after], "span int, first int, next int"))
        left = materialize(merged.join(again, ["span", "first"]).select(F.col("next").alias("span"), "u", "v", "w", "gain")) if spans else merged
        if spans:
            release(merged)
    release(left)
    found, total = [0.0] * len(cuts), 0.0
    for place, c in enumerate(order):
        total += joined[place]
        found[c] = total
    return found


def _forest_communities(flowed: DataFrame, cuts: list[float], deg: DataFrame) -> tuple[DataFrame, float]:
    """((id, component), modularity) of the first best cut, by one forest for all cuts."""
    held = flowed.sparkSession.sparkContext.broadcast(forest.tree(flowed, deg))
    order = sorted(range(len(cuts)), key=cuts.__getitem__)
    found, total = [0.0] * len(cuts), 0.0
    for k, gain in zip(order, forest.cut_gains(flowed, held, [float(cuts[k]) for k in order], flowed.count()), strict=True):
        total += gain
        found[k] = total
    best = max(range(len(cuts)), key=found.__getitem__)
    labels = materialize(forest.labelled(deg, held, float(cuts[best])))
    held.destroy()
    return labels, found[best]


def ricci_communities(graph: Graph, iterations: int = 10, step: float = 0.25, max_cuts: int | None = None) -> tuple[DataFrame, float]:
    """((id, component), modularity) of the best of the cut_offs() of the flowed weights; max_cuts: the first so many only."""
    base = materialize(graph.edges.select("src", "dst").distinct())  # the graph's own plan runs once
    graph = Graph(base, None if graph.implicit else graph.vertices)
    flowed = ricci_flow(graph, iterations)
    cuts = cut_offs(flowed, step)[:max_cuts]
    if not cuts:
        return components(graph), float("-inf")
    deg = materialize(_weighted(flowed).groupBy("id").agg(F.count(F.lit(1)).alias("k")))
    if deg.count() <= FOREST_VERTICES:
        labels, best = _forest_communities(flowed, cuts, deg)
        whole = graph.vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    else:
        found = cut_modularity(flowed, cuts)
        best = max(found)
        kept = flowed.where(F.col("w") < cuts[found.index(best)]).select(F.col("u").alias("src"), F.col("v").alias("dst"))
        labels, whole = None, components(Graph(kept, graph.vertices))
    out = materialize(whole)
    release(base, flowed, deg, labels)
    return out, best
