"""Operators on frontiers and on the edges that leave them: advance, filters, uniquify, maps and keyed reductions.

A frontier is a DataFrame whose first column holds vertex ids; it may repeat them. Each operator is one declarative plan, so that
filters and columns reach the scans of the edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.prefix import running_total

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "or": F.bit_or, "and": F.bit_and}


def _ids(frontier: DataFrame, name: str) -> DataFrame:
    return frontier.select(F.col(frontier.columns[0]).cast("long").alias(name))


def advance(graph: Graph, frontier: DataFrame, keep: Column | str | None = None, *, backward: bool = False, distinct: bool = False) -> DataFrame:
    """(src, dst, weight) of each edge that leaves (backward: enters) a frontier vertex, as often as the frontier repeats it, where `keep` holds."""
    near = "dst" if backward else "src"
    ids = _ids(frontier, near)
    out = graph.edges.join(ids.distinct() if distinct else ids, near, "left_semi" if distinct else "inner")
    return (out if keep is None else out.where(keep)).select("src", "dst", "weight")


def advance_edges(graph: Graph, edges: DataFrame, keep: Column | str | None = None) -> DataFrame:
    """As advance() from a frontier of edges(src, dst): the edges that leave their targets, once for each edge that arrives."""
    return advance(graph, edges.select("dst"), keep)


def advance_vertices(graph: Graph, frontier: DataFrame, keep: Column | str | None = None, *, backward: bool = False) -> DataFrame:
    """(id): the far ends of advance(), each once."""
    return advance(graph, frontier, keep, backward=backward, distinct=True).select(F.col("src" if backward else "dst").alias("id")).distinct()


def filtered(frontier: DataFrame, keep: Column, kind: str = "predicated") -> DataFrame:
    """predicated: rows where `keep` holds; remove: rows where it does not (null counts as not); bypass: all rows, the id null where it does not."""
    if kind == "predicated":
        return frontier.where(keep)
    if kind == "remove":
        return frontier.where(~F.coalesce(keep, F.lit(False)))
    if kind == "bypass":
        first = frontier.columns[0]
        return frontier.withColumn(first, F.when(keep, F.col(first)))
    raise ValueError(f"unknown kind of filter {kind!r}")


def uniquify(frontier: DataFrame) -> DataFrame:
    """Distinct valid ids: exact, and the null ids that a bypass filter leaves are dropped."""
    first = frontier.columns[0]
    return frontier.where(F.col(first).isNotNull()).dropDuplicates([first])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def unvisited(frontier: DataFrame, visited: DataFrame, on: list[str]) -> DataFrame:
    return frontier.join(visited.select(*on), on, "left_anti")


def vertex_map(graph: Graph, frontier: DataFrame | None = None, **columns: Column) -> DataFrame:
    """(id, <columns>) of the frontier's vertices, of all without one."""
    rows = graph.vertices if frontier is None else graph.vertices.join(_ids(frontier, "id").distinct(), "id", "left_semi")
    return rows.select("id", *[c.alias(k) for k, c in columns.items()])


def edge_map_reduce(graph: Graph, frontier: DataFrame, value: Column, reducer: str = "sum", having: Column | None = None, out: str = "value") -> DataFrame:
    """(id, out): `value` over the edges that leave the frontier, reduced at each target; `having` reads the result."""
    step = advance(graph, frontier, distinct=True)
    got = step.groupBy(F.col("dst").alias("id")).agg(AGGREGATES[reducer](value).alias(out))
    return got if having is None else got.where(having)


def edge_map_count(graph: Graph, frontier: DataFrame) -> DataFrame:
    """(id, value): how many frontier vertices point at each target."""
    return edge_map_reduce(graph, frontier, F.lit(1), "count")


def pack_edges(graph: Graph, keep: Column | str) -> tuple[Graph, DataFrame]:
    """The graph with only the edges where `keep` holds, and (id, n): how many each vertex kept, 0 included."""
    packed = Graph(graph.edges.where(keep), graph.vertices)
    return packed, packed.out_degree().withColumnRenamed("degree", "n")


def neighbor_reduce(graph: Graph, value: Column, reducer: str = "sum", default: Column | None = None, out: str = "value") -> DataFrame:
    """(id, out) for every vertex: `value` (of src, dst, weight) over its out-edges; without any, `default` (null if not given)."""
    got = graph.edges.groupBy(F.col("src").alias("id")).agg(AGGREGATES[reducer](value).alias(out))
    rows = graph.vertices.join(got, "id", "left")
    return rows if default is None else rows.select("id", F.coalesce(out, default).alias(out))


def histogram_reduce(rows: DataFrame, key: str, value: str | None = None, reducer: str = "sum") -> DataFrame:
    """(key, n[, value]): rows of each key, and their values reduced."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *([AGGREGATES[reducer](value).alias(value)] if value else []))


def active_subgraph(graph: Graph, active: DataFrame) -> Graph:
    """Edges whose source is active, over all vertices."""
    return Graph(graph.out_subgraph(active), graph.vertices)


def edge_work(graph: Graph, frontier: DataFrame) -> DataFrame:
    """One row for frontier(query_id, vertex): pairs, distinct vertices, edges that queries would scan alone, edges that a shared scan reads."""
    by = frontier.groupBy("vertex").agg(F.count(F.lit(1)).alias("k"))
    deg = graph.out_degree().withColumnRenamed("id", "vertex")
    each = by.join(deg, "vertex", "left").select("k", F.coalesce("degree", F.lit(0)).alias("degree"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(zero(F.col("k")).alias("pairs"), F.count(F.lit(1)).alias("n_vertices"), zero(F.col("k") * F.col("degree")).alias("virtual_edges"), zero(F.col("degree")).alias("actual_edges"))


def query_masks(frontier: DataFrame) -> DataFrame:
    """(vertex, word, mask) of frontier(query_id, vertex): bit q % 32 of word q / 32 says that query q holds the vertex."""
    word = F.floor(F.col("query_id") / 32).cast("long")
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(query_id % 32 AS INT))")
    return frontier.groupBy("vertex", word.alias("word")).agg(F.bit_or(bit).alias("mask"))


def update_buckets(rows: DataFrame, changes: DataFrame, key: str, priority: str, width: float = 1.0) -> DataFrame:
    """(key, priority, bucket) after changes(key, priority): a changed row moves, a new one enters, a null priority takes a row out."""
    new = changes.select(key, F.col(priority).alias("__new"), F.lit(True).alias("__changed"))
    both = rows.select(key, priority).join(new, key, "full_outer").select(key, F.when(F.col("__changed"), F.col("__new")).otherwise(F.col(priority)).alias(priority))
    return both.where(F.col(priority).isNotNull()).withColumn("bucket", F.floor(F.col(priority) / width))


def next_bucket(rows: DataFrame, priority: str, width: float = 1.0, descending: bool = False) -> DataFrame:
    """The rows of the first bucket that is not empty (the last if descending), with its number; null priorities are in none."""
    numbered = rows.where(F.col(priority).isNotNull()).withColumn("bucket", F.floor(F.col(priority) / width))
    pick = numbered.agg((F.max if descending else F.min)("bucket").alias("bucket"))  # one row
    return numbered.join(F.broadcast(pick), "bucket").select(*rows.columns, "bucket")


def edge_budget_parts(graph: Graph, budget: int) -> DataFrame:
    """(id, part): vertices in id order, cut so that a part starts within each `budget` edges; a larger vertex is a part's last."""
    placed = running_total(graph.out_degree(), ["id"], F.col("degree"), "before")
    return placed.select("id", F.floor(F.col("before") / budget).cast("long").alias("part"))


def numbered_edges(graph: Graph) -> DataFrame:
    """(eid, src, dst, weight): edges numbered by source, target and weight."""
    e = running_total(graph.edges, ["src", "dst", "weight"], F.lit(1).cast("long"), "eid")
    return e.select("eid", "src", "dst", "weight")


def find_edges(numbered: DataFrame, eids: DataFrame) -> DataFrame:
    """The edges with the asked numbers; unknown numbers give no row."""
    return numbered.join(eids.select(F.col(eids.columns[0]).alias("eid")).distinct(), "eid", "left_semi")


def filter_edges(numbered: DataFrame, keep: Column | str) -> DataFrame:
    """(eid) of the numbered edges where `keep` holds."""
    return numbered.where(keep).select("eid")


def edge_ids(numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, eid) for every edge between the asked pairs; a null eid where there is none."""
    return pairs.select("src", "dst").distinct().join(numbered.select("src", "dst", "eid"), ["src", "dst"], "left")


def predecessors(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(id, other) for each distinct edge other -> id into the asked nodes."""
    return graph.in_subgraph(nodes).select(F.col("dst").alias("id"), F.col("src").alias("other")).distinct()


def successors(graph: Graph, nodes: DataFrame) -> DataFrame:
    return graph.out_subgraph(nodes).select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()


def has_nodes(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(id, present) of the asked ids."""
    known = graph.vertices.withColumn("present", F.lit(True))
    return _ids(nodes, "id").distinct().join(known, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))


def compare(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float = 0.0, equal: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The keys on which two results differ: both values, null where a side has no row."""
    both = a.select(*key, F.col(value).alias("left")).join(b.select(*key, F.col(value).alias("right")), key, "full_outer")
    same = equal(F.col("left"), F.col("right")) if equal else F.col("left").eqNullSafe(F.col("right")) | (F.abs(F.col("left") - F.col("right")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))
