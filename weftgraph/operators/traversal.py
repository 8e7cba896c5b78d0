"""Orders of traversal, and messages that follow them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import messages
from weftgraph.operators.fixpoint import Query, run_batch
from weftgraph.plans.scratch import materialize, release

DFS_EDGES = 5_000_000


def bfs_nodes(graph: Graph, sources: list[int]) -> DataFrame:
    """(id, level): hops from the nearest source."""
    found = run_batch(graph, [Query(i, "bfs", s) for i, s in enumerate(sources)])
    return found.state.groupBy(F.col("vertex").alias("id")).agg(F.min("value").cast("long").alias("level"))


def bfs_edges(graph: Graph, sources: list[int]) -> DataFrame:
    """(src, dst, level): the tree edge into each vertex reached, from its smallest predecessor one level before."""
    at = materialize(bfs_nodes(graph, sources))
    e = graph.edges.join(at.withColumnRenamed("id", "src"), "src").join(at.select(F.col("id").alias("dst"), (F.col("level") - 1).alias("level")), ["dst", "level"])
    return e.groupBy("dst").agg(F.min("src").alias("src"), (F.first("level") + 1).alias("level")).select("src", "dst", "level")


def dfs_edges(edges: DataFrame, starts: DataFrame, labelled: bool = False, limit: int = DFS_EDGES) -> DataFrame:
    """(graph_id, step, src, dst, label) in depth-first order from starts(graph_id, id), neighbours in id order.

    label is forward; with `labelled`, reverse and nontree edges are given too. A depth-first order is sequential within a
    graph, so each graph of the batch is walked by one task, and many graphs run side by side. A graph of more than `limit`
    edges raises an error before any walk starts, nothing is cut off. Starts reached before are skipped; they go in id order.
    """
    large = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("graph_id").head(1)
    if large:
        raise ValueError(f"graph {large[0].graph_id} has more than {limit} edges: depth-first orders are for batches of smaller graphs")
    e = edges.select("graph_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null").distinct()
    schema = f"graph_id {edges.schema['graph_id'].dataType.simpleString()}, step long, src long, dst long, label string"

    def walk(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        after = {v: g.sort_values().tolist() for v, g in left.groupby("src")["dst"]}
        seen: set[int] = set()
        found: list[tuple[int, int, str]] = []
        for start in sorted(right["id"].dropna().astype("int64")):
            if start in seen:
                continue
            seen.add(start)
            stack = [(start, iter(after.get(start, ())))]
            while stack:
                v, rest = stack[-1]
                w = next(rest, None)
                if w is None:
                    stack.pop()
                    if stack:
                        found.append((stack[-1][0], v, "reverse"))
                elif w in seen:
                    found.append((v, w, "nontree"))
                else:
                    seen.add(w)
                    found.append((v, w, "forward"))
                    stack.append((w, iter(after.get(w, ()))))
        kept = [f for f in found if labelled or f[2] == "forward"]
        out = pd.DataFrame(kept, columns=["src", "dst", "label"])
        out.insert(0, "step", range(len(out)))
        out.insert(0, "graph_id", key[0])
        return out

    return e.groupBy("graph_id").cogroup(starts.select("graph_id", "id").groupBy("graph_id")).applyInPandas(walk, schema)


def propagate(edges: DataFrame, nodes: DataFrame, layers: DataFrame, field: str, message: Column, reducer: str = "sum", combine: Column | None = None) -> DataFrame:
    """nodes after their layers (id, layer) have received, one layer after the other: the new value of `field` feeds the next.

    message reads u_<field> and the edge; combine reads `field` and `h`, the reduced messages (null without any); by default h where
    there is one. Vertices in no layer keep their value.
    """
    state = materialize(nodes.select("id", field))
    last = layers.agg(F.max("layer")).first()[0]
    combine = F.coalesce(F.col("h"), F.col(field)) if combine is None else combine
    for k in range(0 if last is None else last + 1):
        now = layers.where(F.col("layer") == k).select(F.col("id").alias("dst"))
        got = messages.apply_edges(edges.join(now, "dst", "left_semi"), message, "__m", state).groupBy(F.col("dst").alias("id")).agg(messages.REDUCERS[reducer](F.col("__m")).alias("h"))
        nxt = materialize(state.join(got, "id", "left").join(now.select(F.col("dst").alias("id"), F.lit(True).alias("__now")), "id", "left")
                          .select("id", F.when(F.col("__now"), combine).otherwise(F.col(field)).alias(field)))
        release(state)
        state = nxt
    return state


def send(edges: DataFrame, nodes: DataFrame, message: Column, out: str = "m") -> DataFrame:
    """Messages kept for a later recv(), written once."""
    return materialize(messages.apply_edges(edges, message, out, nodes))


def recv(sent: DataFrame, at: DataFrame | None = None, reducer: str = "sum", message: str = "m", out: str = "h") -> DataFrame:
    """(id, out): the kept messages reduced at the given targets, at all without any."""
    rows = sent if at is None else sent.join(at.select(F.col(at.columns[0]).alias("dst")).distinct(), "dst", "left_semi")
    return rows.groupBy(F.col("dst").alias("id")).agg(messages.REDUCERS[reducer](F.col(message)).alias(out))
