"""Graphs from graphs: metapaths, k hops, halos, batches, blocks, hypergraphs, cliques."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.components import connected_components
from weftgraph.operators.linear import power
from weftgraph.operators.sampling import uniform
from weftgraph.plans.prefix import running_total
from weftgraph.plans.scratch import materialize, release


def metapath(steps: list[DataFrame]) -> DataFrame:
    """Distinct (src, dst) reached by following one edge of each step's table in turn."""
    out = steps[0].select("src", "dst").distinct()
    for s in steps[1:]:
        out = out.join(s.select(F.col("src").alias("dst"), F.col("dst").alias("nxt")).distinct(), "dst").select("src", F.col("nxt").alias("dst")).distinct()
    return out


def khop(graph: Graph, k: int) -> DataFrame:
    """(row, col, val): the number of walks of k edges from row to col."""
    ones = graph.edges.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return power(ones, k)


def halo(graph: Graph, parts: DataFrame, hops: int) -> DataFrame:
    """parts(id, part) -> (part, id, hop): each part with the vertices that reach it within `hops` in-edges; hop 0 is the part itself."""
    seen = level = materialize(parts.select("part", "id", F.lit(0).alias("hop")))
    for h in range(1, hops + 1):
        step = level.join(graph.edges, level["id"] == graph.edges["dst"]).select("part", F.col("src").alias("id")).distinct()
        level = materialize(step.join(seen.select("part", "id"), ["part", "id"], "left_anti").withColumn("hop", F.lit(h)))
        seen = materialize(seen.unionByName(level))
    return seen


def label_partition(graph: Graph, parts: int, rounds: int = 5) -> DataFrame:
    """(id, part): hashed parts, then rounds in which a vertex takes the part most common around it (ties: smallest). Stands for a multilevel partitioner."""
    state = graph.vertices.select("id", F.floor(uniform(0, "id") * parts).cast("int").alias("part"))
    both = graph.edges.select("src", "dst").unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    for r in range(rounds):
        votes = both.join(state.select(F.col("id").alias("dst"), "part"), "dst").groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
        top = votes.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("n", (-F.col("part")).alias("neg"))).alias("t")).select("id", (-F.col("t.neg")).alias("new"))
        # half of the vertices move in a round, so neighbours don't swap for ever
        moves = uniform(r + 1, "id") < 0.5
        state = materialize(state.join(top, "id", "left").select("id", F.when(moves, F.coalesce("new", "part")).otherwise(F.col("part")).cast("int").alias("part")))
    return state


def batch_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many graphs (graph_id, id) and (graph_id, src, dst) as one disjoint graph: nodes gain `node`, edges refer to it."""
    numbered = materialize(running_total(nodes.select("graph_id", "id").distinct(), ["graph_id", "id"], F.lit(1).cast("long"), "node"))
    e = edges.join(numbered.select("graph_id", F.col("id").alias("src"), F.col("node").alias("a")), ["graph_id", "src"]).join(numbered.select("graph_id", F.col("id").alias("dst"), F.col("node").alias("b")), ["graph_id", "dst"])
    return numbered, e.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))


def unbatch_graphs(numbered: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst) with the ids inside each graph."""
    a = numbered.select(F.col("node").alias("src"), "graph_id", F.col("id").alias("a"))
    b = numbered.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))


def to_block(edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """In-edges of the targets between two numbered layers: (edges on new ids, mapping (id, new) with targets first)."""
    ids = targets.select(F.col(targets.columns[0]).alias("id")).distinct()
    e = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    others = e.select(F.col("src").alias("id")).distinct().join(ids, "id", "left_anti")
    every = ids.withColumn("late", F.lit(0)).unionByName(others.withColumn("late", F.lit(1)))
    mapping = materialize(running_total(every, ["late", "id"], F.lit(1).cast("long"), "new").select("id", "new"))
    a, b = mapping.select(F.col("id").alias("src"), F.col("new").alias("a")), mapping.select(F.col("id").alias("dst"), F.col("new").alias("b"))
    return e.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")), mapping


def to_homogeneous(tables: dict[tuple[str, str, str], DataFrame], counts: dict[str, int]) -> DataFrame:
    """Typed edges {(source type, edge type, target type): (src, dst)} as one table on shifted ids, types in name order."""
    start, at = {}, 0
    for t in sorted(counts):
        start[t], at = at, at + counts[t]
    out: DataFrame | None = None
    for (a, e, b), df in sorted(tables.items()):
        part = df.select((F.col("src") + start[a]).alias("src"), (F.col("dst") + start[b]).alias("dst"), F.lit(e).alias("etype"))
        out = part if out is None else out.unionByName(part)
    return out


def metagraph(tables: dict[tuple[str, str, str], DataFrame]) -> list[tuple[str, str, str]]:
    return sorted(tables)


def clique_expansion(members: DataFrame, group: str, member: str) -> DataFrame:
    """(u, v, n), u < v: how many groups two members share. Rows grow with the square of a group; hyperedge_propagate() does without."""
    m = members.select(F.col(group).alias("g"), F.col(member).alias("u")).distinct()
    return m.join(m.withColumnRenamed("u", "v"), "g").where("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def hyperedge_propagate(members: DataFrame, values: DataFrame, group: str, member: str, agg: Callable[[Column], Column] = F.sum) -> DataFrame:
    """values(member, value) to hyperedges and back: (member, value), two joins through the membership table."""
    m = members.select(F.col(group).alias("g"), F.col(member).alias("member")).distinct()
    up = m.join(values, "member").groupBy("g").agg(agg(F.col("value")).alias("value"))
    return m.join(up, "g").groupBy("member").agg(agg(F.col("value")).alias("value"))


def hyperedge_counts(members: DataFrame, active: DataFrame, group: str, member: str) -> DataFrame:
    """(group, value): how many active members each hyperedge has, 0 included."""
    m = members.select(F.col(group).alias("group"), F.col(member).alias("member")).distinct()
    on = active.select(F.col(active.columns[0]).alias("member")).distinct().withColumn("on", F.lit(1))
    return m.join(on, "member", "left").groupBy("group").agg(F.count("on").alias("value"))


def type_subgraph(tables: dict[tuple[str, str, str], DataFrame], edge_types: list[str] | None = None, node_types: list[str] | None = None) -> dict[tuple[str, str, str], DataFrame]:
    """The tables of the asked edge types, and of those whose two ends are of the asked node types."""
    known = {t[1] for t in tables} | {n for t in tables for n in (t[0], t[2])}
    if unknown := set((edge_types or []) + (node_types or [])) - known:
        raise ValueError(f"unknown types {sorted(unknown)}")
    return {t: df for t, df in tables.items() if (edge_types is None or t[1] in edge_types) and (node_types is None or {t[0], t[2]} <= set(node_types))}


def add_weights(edges: DataFrame, low: int, high: int, seed: int = 0) -> DataFrame:
    """(src, dst, weight): whole weights from low to high, both included, drawn by seed and ends; parallel edges weigh the same."""
    return edges.select("src", "dst", (low + F.floor(uniform(seed, "src", "dst") * (high - low + 1))).cast("double").alias("weight"))


def laplacian_lambda_max(graph: Graph, rounds: int = 500, tol: float = 1e-9) -> float:
    """The largest eigenvalue of the symmetric normalised Laplacian (0 without edges); an error if it has not settled after `rounds` steps.

    It is 2 exactly if some component is bipartite. Else by Lanczos steps, one product each, until the residual of the largest Ritz value, which
    bounds its distance from an eigenvalue, is below tol: a power iteration needs the square of as many steps where eigenvalues lie close.
    """
    both = materialize(graph.symmetric().edges.where("src <> dst").select("src", "dst").distinct())
    if both.isEmpty() or _bipartite_part(both):
        value = 0.0 if both.isEmpty() else 2.0
        release(both)
        return value
    deg = both.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = materialize(both.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst").selectExpr("src", "dst", "1 / sqrt(d * dd) as w"))
    first = materialize(deg.select("src", (uniform(7, "src") - 0.5).alias("x")))
    norm = first.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    x, held = first.select("src", (F.col("x") / norm).alias("x"), F.lit(0.0).alias("before")), first
    diagonal, beside = [], []
    try:
        for _ in range(rounds):
            ax = e.join(x.select(F.col("src").alias("dst"), "x"), "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("x")).alias("ax"))
            y = materialize(x.join(ax, "src").select("src", "x", "before", (F.col("x") - F.col("ax")).alias("y")))
            release(held)
            held = y
            diagonal.append(y.agg(F.sum(F.col("x") * F.col("y"))).first()[0])
            rest = F.col("y") - diagonal[-1] * F.col("x") - (beside[-1] if beside else 0.0) * F.col("before")
            left = y.agg(F.sqrt(F.sum(rest * rest))).first()[0]
            values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
            if left * abs(vectors[-1, -1]) < tol:
                return float(values[-1])
            beside.append(left)
            x = y.select("src", (rest / left).alias("x"), F.col("x").alias("before"))
    finally:
        release(both, e, held)
    raise RuntimeError(f"the eigenvalue did not settle in {rounds} rounds")


def _bipartite_part(both: DataFrame) -> bool:
    """Whether a component of the edges (both directions) has no odd cycle: its vertices' two copies in the double cover stay apart."""
    cover = both.select(F.struct(F.col("src").alias("id"), F.lit(0).alias("side")).alias("src"), F.struct(F.col("dst").alias("id"), F.lit(1).alias("side")).alias("dst"))
    found = connected_components(cover)
    apart = found.groupBy("vertex.id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    out = not apart.isEmpty()
    release(found)
    return out
