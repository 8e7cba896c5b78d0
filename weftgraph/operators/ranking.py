"""Iterated rankings: PageRank in several forms, personalised PageRank by push, HITS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.prefix import running_total
from weftgraph.plans.scratch import materialize, release


def pagerank(graph: Graph, alpha: float = 0.85, tol: float = 1e-6, max_iterations: int = 100) -> DataFrame:
    """(id, rank), weighted: dangling mass is spread evenly; stops when no rank moves by tol or more."""
    ranks, _ = _sweep(graph, [(alpha, tol)], max_iterations, weighted=True, l1=False)
    return ranks.select("id", "rank")


def pagerank_sweep(graph: Graph, settings: list[tuple[float, float]], max_iterations: int = 100, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """One loop for a grid of (damping, tolerance): ranks (run, id, rank) and (run, alpha, tol, l1_iterations, max_iterations).

    A run is frozen once both the L1 and the largest change have been below its tolerance; the iterations at which each first
    fell below it are recorded, max_iterations where it never did.
    """
    return _sweep(graph, settings, max_iterations, weighted, l1=True)


def _sweep(graph: Graph, settings: list[tuple[float, float]], max_iterations: int, weighted: bool, l1: bool) -> tuple[DataFrame, DataFrame]:
    """pagerank_sweep(); without l1 a run is frozen by its largest change alone."""
    spark = graph.edges.sparkSession
    grid = spark.createDataFrame([(i, float(a), float(t)) for i, (a, t) in enumerate(settings)], "run int, alpha double, tol double")
    n = graph.vertices.count()
    if not n:
        return spark.createDataFrame([], "run int, id long, rank double"), spark.createDataFrame([], "run int, alpha double, tol double, l1_iterations int, max_iterations int")
    w = "weight" if weighted else "1.0"
    e = graph.edges.selectExpr("src", "dst", f"double({w}) as w")
    out = e.groupBy("src").agg(F.sum("w").alias("out_w"))
    shares = materialize(e.join(out, "src").selectExpr("src", "dst", "w / out_w as share"))
    vertices = materialize(graph.vertices.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    ranks = materialize(vertices.crossJoin(F.broadcast(grid)).select("run", "id", "dangling", "alpha", F.lit(1.0 / n).alias("rank")))  # the grid has one row per setting
    l1_at: dict[int, int] = {}
    max_at: dict[int, int] = {}
    frozen: list[DataFrame] = []
    for it in range(1, max_iterations + 1):
        loose = {r.run: r.mass or 0.0 for r in ranks.groupBy("run").agg(F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("mass")).collect()}
        lost = spark.createDataFrame([(k, float(v)) for k, v in loose.items()], "run int, mass double")
        got = ranks.join(shares, ranks["id"] == shares["src"]).groupBy("run", F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        nxt = ranks.join(got, ["run", "id"], "left").join(F.broadcast(lost), "run")
        value = (F.lit(1.0) - F.col("alpha") + F.col("alpha") * F.col("mass")) / n + F.col("alpha") * F.coalesce("got", F.lit(0.0))
        fresh = materialize(nxt.select("run", "id", "dangling", "alpha", value.alias("rank"), F.abs(value - F.col("rank")).alias("delta")))
        moved = {r.run: r for r in fresh.groupBy("run").agg(F.sum("delta").alias("l1"), F.max("delta").alias("top")).collect()}
        stop = []
        for run, row in moved.items():
            if row.l1 < settings[run][1] or it == max_iterations:
                l1_at.setdefault(run, it)
            if row.top < settings[run][1] or it == max_iterations:
                max_at.setdefault(run, it)
            if run in max_at and (run in l1_at or not l1):
                stop.append(run)
        release(ranks)
        if stop:
            frozen.append(fresh.where(F.col("run").isin(stop)).select("run", "id", "rank"))
        if len(stop) == len(moved):
            break
        ranks = materialize(fresh.where(~F.col("run").isin(stop)).drop("delta")) if stop else fresh.drop("delta")
        if not stop:
            ranks._weft_path = fresh._weft_path
    result = frozen[0]
    for f in frozen[1:]:
        result = result.unionByName(f)
    info = [(i, float(a), float(t), l1_at.get(i), max_at.get(i)) for i, (a, t) in enumerate(settings)]
    return result, spark.createDataFrame(info, "run int, alpha double, tol double, l1_iterations int, max_iterations int")


def pagerank_steps(graph: Graph, alpha: float, steps: int) -> DataFrame:
    """(id, rank) after exactly `steps` iterations."""
    return pagerank(graph, alpha, 0.0, steps)


def delta_pagerank(graph: Graph, damping: float = 0.85, threshold: float = 0.01, max_iterations: int = 1000, partial: bool = False) -> DataFrame:
    """(id, rank): residual form. Every vertex starts with a residual of 1 - damping; residuals above the threshold move into the
    rank and are passed on, damped, over the out-degree. Ranks are not divided by the number of vertices. Without `partial`, ranks that have not
    settled in max_iterations are an error."""
    e = graph.edges.select("src", "dst")
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    shares = materialize(e.join(out, "src"))
    state = materialize(graph.vertices.select("id", F.lit(0.0).alias("rank"), F.lit(1.0 - damping).alias("residual")))
    for _ in range(max_iterations):
        active = state.where(F.col("residual") > threshold)
        got = active.join(shares, active["id"] == shares["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("residual") * damping / F.col("deg")).alias("got"))
        moves = F.col("residual") > threshold
        nxt = state.join(got, "id", "left").select(
            "id", F.when(moves, F.col("rank") + F.col("residual")).otherwise(F.col("rank")).alias("rank"),
            (F.when(moves, F.lit(0.0)).otherwise(F.col("residual")) + F.coalesce("got", F.lit(0.0))).alias("residual"))
        fresh = materialize(nxt)
        release(state)
        state = fresh
        if state.where(F.col("residual") > threshold).isEmpty():
            break
    else:
        if not partial:
            raise RuntimeError(f"ranks did not settle in {max_iterations} iterations")
    release(shares)
    return state.select("id", "rank")


def personalized_pagerank(graph: Graph, seeds: list[int], alpha: float = 0.85, epsilon: float = 1e-4, max_iterations: int = 2000) -> DataFrame:
    """(query_id, id, p, r) by parallel push, one run for each seed.

    A frontier vertex adds 2a/(1+a) of its residual to p and spreads (1-a)/(1+a) of it over its out-edges; a vertex enters the
    frontier when its residual crosses degree * epsilon from below.
    """
    spark = graph.edges.sparkSession
    e = graph.edges.select("src", "dst")
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    pairs = materialize(e.join(out, "src"))
    start = spark.createDataFrame([(i, s) for i, s in enumerate(seeds)], "query_id int, id long")
    state = materialize(start.select("query_id", "id", F.lit(0.0).alias("p"), F.lit(1.0).alias("r"), F.lit(True).alias("active")))
    keep, spread = 2 * alpha / (1 + alpha), (1 - alpha) / (1 + alpha)
    for _ in range(max_iterations):
        front = state.where("active and r > 0")
        got = front.join(pairs, front["id"] == pairs["src"]).groupBy("query_id", F.col("dst").alias("id")).agg(F.sum(F.col("r") * spread / F.col("deg")).alias("got"))
        joined = state.join(got, ["query_id", "id"], "full_outer").join(out.withColumnRenamed("src", "id"), "id", "left")
        moves = F.coalesce(F.col("active"), F.lit(False))
        r0 = F.when(moves, F.lit(0.0)).otherwise(F.coalesce("r", F.lit(0.0)))
        r1 = r0 + F.coalesce("got", F.lit(0.0))
        limit = F.coalesce("deg", F.lit(0)) * epsilon
        nxt = joined.select("query_id", "id", (F.coalesce("p", F.lit(0.0)) + F.when(moves, F.col("r") * keep).otherwise(0.0)).alias("p"), r1.alias("r"), ((r0 <= limit) & (r1 > limit) & (F.coalesce("deg", F.lit(0)) > 0)).alias("active"))
        fresh = materialize(nxt)
        release(state)
        state = fresh
        if state.where("active").isEmpty():
            break
    else:
        raise RuntimeError(f"ranks did not settle in {max_iterations} iterations")
    release(pairs)
    return state.select("query_id", "id", "p", "r")


def hits(graph: Graph, max_iterations: int = 50, tol: float = 0.0) -> DataFrame:
    """(id, hub, authority), both of Euclidean length 1, started from ones."""
    e = materialize(graph.edges.select("src", "dst"))
    scores = materialize(graph.vertices.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")))
    for _ in range(max_iterations):
        hub = scores.select(F.col("id").alias("src"), "hub")
        auth = e.join(hub, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        hubs = e.join(auth.select(F.col("id").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        raw = materialize(scores.select("id", F.col("hub").alias("old")).join(auth, "id", "left").join(hubs, "id", "left").select("id", "old", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a")))
        norm = raw.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("h"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("a")).first()
        fresh = materialize(raw.select("id", "old", (F.col("h") / F.lit(norm.h or 1.0)).alias("hub"), (F.col("a") / F.lit(norm.a or 1.0)).alias("authority")))
        moved = fresh.agg(F.max(F.abs(F.col("hub") - F.col("old")))).first()[0] or 0.0
        release(scores, raw)
        scores = fresh.drop("old")
        scores._weft_path = fresh._weft_path
        if moved <= tol:
            break
    release(e)
    return scores


def hits_ranking(scores: DataFrame) -> DataFrame:
    """hits() scores with hub_rank and authority_rank: 1, 2, ... from the largest score down, ties by id."""
    out = scores
    for name in ("hub", "authority"):
        down = scores.select("id", (-F.col(name)).alias("down"))
        ranks = running_total(down, ["down", "id"], F.lit(1).cast("long"), "before").select("id", (F.col("before") + 1).alias(f"{name}_rank"))
        out = out.join(ranks, "id")
    return out
