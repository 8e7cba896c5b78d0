"""Sampling: neighbours, walks, negatives. A hash of seed and ids gives every draw, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.prefix import dense_ids, running_total
from weftgraph.plans.scratch import materialize, release


def uniform(seed: int, *cols: Column | str) -> Column:
    """A draw in (0, 1) that depends on seed and cols only: 13 hexadecimal digits of their md5, which any engine can repeat."""
    key = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def sample_neighbors(edges: DataFrame, nodes: DataFrame, fanout: int, *, weight: str | None = None, replace: bool = False, seed: int = 0, inward: bool = True) -> DataFrame:
    """Up to `fanout` edges of each node: without replacement by hashed (weighted: exponential) keys; with it, by cumulative weights."""
    own, other = ("dst", "src") if inward else ("src", "dst")
    e = edges.join(nodes.select(F.col(nodes.columns[0]).alias(own)).distinct(), own, "left_semi")
    w = F.col(weight) if weight else F.lit(1.0)
    if not replace:
        key = -F.log(uniform(seed, "src", "dst")) / w
        ranked = e.where(w > 0).withColumn("__r", F.row_number().over(Window.partitionBy(own).orderBy(key, other)))
        return ranked.where(F.col("__r") <= fanout).drop("__r")
    by = Window.partitionBy(own).orderBy(other)
    cum = e.where(w > 0).withColumn("__hi", F.sum(w).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(w).over(Window.partitionBy(own)))
    draws = nodes.select(F.col(nodes.columns[0]).alias(own)).distinct().withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
    hit = draws.join(cum, own).withColumn("__u", uniform(seed, own, "__k") * F.col("__all")).where((F.col("__u") <= F.col("__hi")) & (F.col("__u") > F.col("__hi") - w))
    return hit.drop("__hi", "__all", "__u").withColumnRenamed("__k", "draw")


def random_walk(edges: DataFrame | list[DataFrame], seeds: DataFrame, length: int, *, weight: str | None = None, restart: float = 0.0, seed: int = 0) -> DataFrame:
    """seeds(walk, id) -> (walk, trace): length + 1 ids, -1 after a walk ends. A list of edge tables is a metapath, repeated in turn.

    A vertex's out-edges become cumulative weights once, so a step is a join on the vertex and the range its draw falls in.
    """
    tables = edges if isinstance(edges, list) else [edges]
    w = F.col(weight) if weight else F.lit(1.0)
    by = Window.partitionBy("src").orderBy("dst")
    steps = []
    for t in tables:
        cum = t.groupBy("src", "dst").agg(F.sum(w).alias("w")).where("w > 0").withColumn("hi", F.sum("w").over(by)).withColumn("all", F.sum("w").over(Window.partitionBy("src")))
        steps.append(materialize(cum.selectExpr("src", "dst", "(hi - w) / all as lo", "hi / all as hi")))
    state = materialize(seeds.select("walk", F.col("id").alias("at"), F.array("id").alias("trace")))
    for k in range(length):
        going = state.where("at >= 0").withColumn("u", uniform(seed, "walk", F.lit(k))).withColumn("stop", uniform(seed + 1, "walk", F.lit(k)) < restart)
        nxt = going.where("not stop").join(steps[k % len(steps)], going["at"] == F.col("src")).where("u > lo and u <= hi").select("walk", F.col("dst").alias("to"))
        state = materialize(state.join(nxt, "walk", "left").select("walk", F.coalesce("to", F.lit(-1)).alias("at"), F.concat("trace", F.array(F.coalesce("to", F.lit(-1)))).alias("trace")))
    return state.select("walk", "trace")


def one_sided_walk(edges: DataFrame, seeds: DataFrame, length: int, *, weight: str | None = None, seed: int = 0) -> DataFrame:
    """(walk, trace) over a bipartite graph: length + 1 ids of the seeds' side; each step goes over to the other side and back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    both = random_walk([edges, back], seeds, 2 * length, weight=weight, seed=seed)
    return both.select("walk", F.filter("trace", lambda _, i: i % 2 == 0).alias("trace"))


def layer_flow(edges: DataFrame, seeds: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """(layer, src, dst): for each layer at most so many sources in all, drawn out of those that point at the layer before by the number of their edges
    into it, with all their edges into it."""
    at, out = seeds.select(F.col(seeds.columns[0]).alias("dst")).distinct(), None
    for k, size in enumerate(sizes):
        into = materialize(edges.select("src", "dst").join(at, "dst", "left_semi"))
        drawn = into.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(-F.log(uniform(seed, F.lit(k), "src")) / F.col("n"), "src").limit(size).select("src")
        got = materialize(into.join(drawn, "src", "left_semi").select(F.lit(k).alias("layer"), "src", "dst"))
        release(into)
        out = got if out is None else out.unionByName(got)
        at = got.select(F.col("src").alias("dst")).distinct()
    return out


def pack_traces(walks: DataFrame) -> DataFrame:
    """(walk, step, id) of the visited ids only."""
    return walks.select("walk", F.posexplode("trace").alias("step", "id")).where("id >= 0")


def visited_neighbors(edges: DataFrame, nodes: DataFrame, k: int, *, walks: int = 10, length: int = 3, restart: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, neighbour, visits): the k vertices that random walks from each node visit most."""
    seeds = nodes.select(F.col(nodes.columns[0]).alias("id")).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))
    seeds = materialize(seeds.select(F.concat_ws(":", "id", "n").alias("walk"), "id"))
    seen = pack_traces(random_walk(edges, seeds, length, restart=restart, seed=seed)).where("step > 0")
    counts = seen.groupBy(F.substring_index("walk", ":", 1).cast("long").alias("id"), F.col("id").alias("neighbour")).agg(F.count(F.lit(1)).alias("visits")).where("id <> neighbour")
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("visits"), "neighbour"))).where(F.col("r") <= k).drop("r")


def node_flow(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """(layer, src, dst): layered neighbour samples outwards from the seeds, layer 0 next to them."""
    at, out = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct(), None
    for k, f in enumerate(fanouts):
        got = materialize(sample_neighbors(edges.select("src", "dst"), at, f, seed=seed + k).select(F.lit(k).alias("layer"), "src", "dst"))
        out = got if out is None else out.unionByName(got)
        at = got.select(F.col("src").alias("id")).distinct()
    return out


def negative_edges(edges: DataFrame, vertices: DataFrame, per_edge: int, seed: int = 0, weight: str | None = None) -> DataFrame:
    """(src, dst) pairs that aren't edges: each edge's source with hashed targets, collisions with edges dropped.

    weight, a column of vertices, draws targets by it: the weights are laid end to end by id over as many bins as there are vertices, a draw
    reads the vertices of its bin only. Vertices of null or no positive weight are not drawn.
    """
    draws = edges.select("src", "dst").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1)))).select("src", uniform(seed, "src", "dst", "k").alias("u"))
    key = vertices.columns[0]
    if weight is None:
        numbered = materialize(dense_ids(vertices, key, "n"))
        n = numbered.count()
        targets = draws.select("src", F.floor(F.col("u") * n).alias("n")).join(numbered.select("n", F.col("key").alias("dst")), "n")
    else:
        rows = vertices.where(F.col(weight) > 0).select(F.col(key).alias("dst"), F.col(weight).cast("double").alias("w"))
        placed = materialize(running_total(rows, ["dst"], F.col("w"), "lo"))
        n, total = placed.agg(F.count(F.lit(1)), F.max(F.col("lo") + F.col("w"))).first()
        bin_of = lambda c: F.least(F.floor(c / F.lit(total or 1.0) * n), F.lit(n - 1))
        held = placed.select("dst", "lo", (F.col("lo") + F.col("w")).alias("hi")).withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
        points = draws.withColumn("x", F.col("u") * F.lit(total or 1.0)).withColumn("bin", bin_of(F.col("x")))
        targets = points.join(held, "bin").where("x >= lo and x < hi")
    return targets.select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
