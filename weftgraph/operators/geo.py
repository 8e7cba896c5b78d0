"""Locating vertices from their neighbours' places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import haversine, midpoint
from weftgraph.graph import Graph
from weftgraph.plans.scratch import materialize, release


def spatial_median(points: DataFrame, rounds: int = 50, eps: float = 1e-3) -> DataFrame:
    """points(id, lat, lon) -> (id, lat, lon): Weiszfeld's iteration with great-circle distances, all ids at once as joins."""
    at = points.groupBy("id").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    for k in range(rounds):
        d = points.join(at, "id").withColumn("w", 1 / F.greatest(haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), F.lit(eps)))
        at = d.groupBy("id").agg((F.sum(F.col("w") * F.col("lat")) / F.sum("w")).alias("clat"), (F.sum(F.col("w") * F.col("lon")) / F.sum("w")).alias("clon"))
        if k % 5 == 4:
            at = materialize(at)
    return at.select("id", F.col("clat").alias("lat"), F.col("clon").alias("lon"))


def geolocate(graph: Graph, places: DataFrame, iterations: int = 3, spatial_iterations: int = 10) -> DataFrame:
    """(id, lat, lon), null where nothing is known: in each synchronous round an unknown vertex takes its one known neighbour's place,
    the midpoint of two, or the spatial median of more."""
    state = materialize(graph.vertices.join(places.select("id", "lat", "lon"), "id", "left"))
    e = materialize(graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).distinct())
    for _ in range(iterations):
        known = state.where("lat is not null and lon is not null")
        near = materialize(e.join(state.where("lat is null or lon is null").select("id"), "id").join(known.select(F.col("id").alias("nbr"), "lat", "lon"), "nbr"))
        n = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("nbr", "lat", "lon")).alias("a"), F.max(F.struct("nbr", "lat", "lon")).alias("b"))
        few = n.where("n <= 2").select("id", F.when(F.col("n") == 1, F.struct("a.lat", "a.lon")).otherwise(midpoint(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))).alias("p")).select("id", "p.lat", "p.lon")
        many = spatial_median(near.join(n.where("n > 2").select("id"), "id", "left_semi").select("id", "lat", "lon"), spatial_iterations)
        found = materialize(few.unionByName(many))
        if found.isEmpty():
            break
        new = found.select("id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
        fresh = materialize(state.join(new, "id", "left").select("id", F.coalesce("lat", "nlat").alias("lat"), F.coalesce("lon", "nlon").alias("lon")))
        release(state)
        state = fresh
    return state
