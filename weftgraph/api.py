"""One function for each algorithm: a graph and parameters in, a DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import geo, linear, ranking, ricci, structure
from weftgraph.operators.fixpoint import Query, run_batch
from weftgraph.sources.files import read_graph

__all__ = [
    "bc", "bfs", "color", "communities", "geolocate", "hits", "kcore", "mst", "pagerank", "paths", "ppr", "read_graph", "spgemm", "spmv", "sssp", "tc", "wcc",
]


def _matrix(graph: Graph) -> DataFrame:
    return graph.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("val"))


def paths(graph: Graph, kind: str, sources: list[int], **options) -> DataFrame:
    """(query_id, vertex, value) of one kind of path query from each source; query_id is the place of the source in the list."""
    found = run_batch(graph, [Query(i, kind, s) for i, s in enumerate(sources)], **options)
    return found.state.select("query_id", "vertex", "value")


def bfs(graph: Graph, source: int, **options) -> DataFrame:
    """(vertex, level) of the vertices that the source reaches."""
    return paths(graph, "bfs", [source], **options).select("vertex", F.col("value").cast("long").alias("level"))


def sssp(graph: Graph, source: int, **options) -> DataFrame:
    """(vertex, distance) of the vertices that the source reaches."""
    return paths(graph, "sssp", [source], **options).select("vertex", F.col("value").alias("distance"))


def wcc(graph: Graph) -> DataFrame:
    """(id, component): the least id of each weakly connected component."""
    return structure.components(graph)


def pagerank(graph: Graph, alpha: float = 0.85, tol: float = 1e-6, max_iterations: int = 100) -> DataFrame:
    return ranking.pagerank(graph, alpha, tol, max_iterations)


def ppr(graph: Graph, seeds: list[int], alpha: float = 0.85, epsilon: float = 1e-4) -> DataFrame:
    """(query_id, id, p, r) for each seed."""
    return ranking.personalized_pagerank(graph, seeds, alpha, epsilon)


def hits(graph: Graph, max_iterations: int = 50, tol: float = 0.0) -> DataFrame:
    """(id, hub, authority, hub_rank, authority_rank)."""
    return ranking.hits_ranking(ranking.hits(graph, max_iterations, tol))


def bc(graph: Graph, sources: list[int] | None = None) -> DataFrame:
    """(id, bc): betweenness from the given sources, from all vertices without any."""
    return structure.betweenness_all(graph) if sources is None else structure.betweenness(graph, sources)


def kcore(graph: Graph) -> DataFrame:
    """(id, core)."""
    return structure.kcore(graph)


def mst(graph: Graph, allow_forest: bool = True) -> DataFrame:
    """The edges of a least spanning forest."""
    return structure.spanning_forest(graph, allow_forest)


def tc(graph: Graph) -> DataFrame:
    """(id, triangles)."""
    return structure.triangles(graph)


def color(graph: Graph, seed: int = 0) -> DataFrame:
    return structure.coloring(graph, seed)


def geolocate(graph: Graph, places: DataFrame, iterations: int = 3, spatial_iterations: int = 10) -> DataFrame:
    """(id, lat, lon)."""
    return geo.geolocate(graph, places, iterations, spatial_iterations)


def communities(graph: Graph, iterations: int = 10) -> DataFrame:
    """(id, component, modularity) by curvature flow."""
    labels, quality = ricci.ricci_communities(graph, iterations)
    return labels.withColumn("modularity", F.lit(quality))


def spmv(graph: Graph, vector: DataFrame, **options) -> DataFrame:
    """(idx, val) of the weighted adjacency times vector(idx, val)."""
    return linear.spmv(_matrix(graph), vector, **options)


def spgemm(a: Graph, b: Graph, **options) -> DataFrame:
    """(row, col, val) of the product of two weighted adjacencies."""
    return linear.mxm(_matrix(a), _matrix(b), **options)
