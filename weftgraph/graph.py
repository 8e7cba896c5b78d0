"""A graph: edges(src, dst, weight) and vertices(id), with the relational algebra of its structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.prefix import dense_ids, running_total


class Graph:
    """Edges are directed; a missing weight is 1. vertices may hold more ids than the edges do."""

    def __init__(self, edges: DataFrame, vertices: DataFrame | None = None, *, src: str = "src", dst: str = "dst", weight: str | None = "weight"):
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight and weight in edges.columns else F.lit(1.0)
        self.edges = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("weight")).where("src is not null and dst is not null")
        self.implicit = vertices is None  # the vertices are the ends of the edges
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        self.vertices = ends if vertices is None else vertices.select(F.col(vertices.columns[0]).cast("long").alias("id")).where("id is not null").distinct()

    def _with(self, edges: DataFrame) -> Graph:
        return Graph(edges, self.vertices)

    # -- transforms ---------------------------------------------------------------------------------------------------

    def reverse(self) -> Graph:
        return self._with(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def symmetric(self) -> Graph:
        """Both directions of every edge; of parallel edges the lightest stays."""
        both = self.edges.unionByName(self.reverse().edges)
        return self._with(both.groupBy("src", "dst").agg(F.min("weight").alias("weight")))

    def simple(self) -> DataFrame:
        """(src, dst, n): parallel edges merged and counted."""
        return self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))

    def without_self_loops(self) -> Graph:
        return self._with(self.edges.where("src <> dst"))

    def with_self_loops(self, weight: float = 1.0) -> Graph:
        loops = self.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).alias("weight"))
        return self._with(self.edges.unionByName(loops))

    def lighter_than(self, limit: float) -> Graph:
        return self._with(self.edges.where(F.col("weight") < limit))

    def in_subgraph(self, nodes: DataFrame) -> DataFrame:
        return self.edges.join(nodes.select(F.col(nodes.columns[0]).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "weight")

    def out_subgraph(self, nodes: DataFrame) -> DataFrame:
        return self.edges.join(nodes.select(F.col(nodes.columns[0]).alias("src")).distinct(), "src", "left_semi").select("src", "dst", "weight")

    def node_subgraph(self, nodes: DataFrame) -> Graph:
        ids = nodes.select(F.col(nodes.columns[0]).alias("id")).distinct()
        kept = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(kept, ids)

    def edge_subgraph(self, numbered: DataFrame, eids: DataFrame, keep_vertices: bool = False) -> Graph:
        """The edges of the asked numbers out of numbered(eid, src, dst, weight), over their own ends or all vertices."""
        kept = numbered.join(eids.select(F.col(eids.columns[0]).alias("eid")).distinct(), "eid", "left_semi").select("src", "dst", "weight")
        return Graph(kept, self.vertices if keep_vertices else None)

    def remove_edges(self, pairs: DataFrame) -> Graph:
        return self._with(self.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))

    def relabel(self, mapping: DataFrame) -> Graph:
        """mapping: (old, new)."""
        a = mapping.select(F.col("old").alias("src"), F.col("new").alias("a"))
        b = mapping.select(F.col("old").alias("dst"), F.col("new").alias("b"))
        return Graph(self.edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), mapping.select("new"))

    def compact(self) -> tuple[Graph, DataFrame]:
        """The graph without isolated vertices on ids 0, 1, ..., and the mapping (old, new)."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        mapping = dense_ids(ends, "id", "new").withColumnRenamed("key", "old")
        return self.relabel(mapping), mapping

    def degree_order(self) -> DataFrame:
        """(old, new, degree): vertices renumbered by out-degree, largest first, ties by id."""
        ranked = self.out_degree().select("id", "degree", (-F.col("degree")).alias("neg"))
        return running_total(ranked, ["neg", "id"], F.lit(1).cast("long"), "new").select(F.col("id").alias("old"), "new", "degree")

    def line_graph(self, backtracking: bool = True) -> DataFrame:
        """(src, dst) over edge pairs named by their ends: u->v is followed by v->w."""
        first = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
        second = self.edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).distinct()
        both = first.join(second, "v")
        both = both if backtracking else both.where("u <> w")
        return both.select("u", "v", "w")

    # -- accessors ----------------------------------------------------------------------------------------------------

    def out_degree(self) -> DataFrame:
        return self._degree("src")

    def in_degree(self) -> DataFrame:
        return self._degree("dst")

    def _degree(self, end: str) -> DataFrame:
        counts = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def degree_stats(self) -> DataFrame:
        """One row: mean and population deviation of the out-degree (exact, where an integer mean would lose its fraction)."""
        return self.out_degree().agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("degree").alias("n_edges"), F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("deviation"))

    def degree_histogram(self) -> DataFrame:
        """(bin, n): bin 0 holds degree 0, bin b the degrees below 2^b from 2^(b-1)."""
        b = F.when(F.col("degree") == 0, 0).otherwise(F.length(F.bin("degree"))).cast("int")
        return self.out_degree().groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def csr_offsets(self) -> DataFrame:
        """(id, offset, degree) of compressed rows, by id."""
        return running_total(self.out_degree(), ["id"], F.col("degree"), "offset").select("id", F.col("offset").cast("long").alias("offset"), "degree")

    def csc_offsets(self) -> DataFrame:
        return self.reverse().csr_offsets()

    def adjacency(self) -> DataFrame:
        """(id, neighbours): sorted distinct out-neighbours, an empty array for none."""
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
        return self.vertices.join(lists, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))

    def edge_lookup(self, pairs: DataFrame) -> DataFrame:
        """pairs(src, dst) with the number and the least weight of their edges; 0 and null if there is none."""
        found = self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_edges"), F.min("weight").alias("weight"))
        return pairs.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "weight")

    def common_neighbours(self, pairs: DataFrame) -> DataFrame:
        """pairs(src, dst) with the number of out-neighbours that both have."""
        one = self.edges.select("src", F.col("dst").alias("c")).distinct()
        two = one.select(F.col("src").alias("dst"), "c")
        common = pairs.select("src", "dst").distinct().join(one, "src").join(two, ["dst", "c"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_common"))
        return pairs.join(common, ["src", "dst"], "left").select("src", "dst", F.coalesce("n_common", F.lit(0)).alias("n_common"))

    def common_neighbour_rows(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, common): one row for each out-neighbour that both ends of a pair have, for any further expression."""
        one = self.edges.select("src", F.col("dst").alias("common")).distinct()
        two = one.select(F.col("src").alias("dst"), "common")
        return pairs.select("src", "dst").distinct().join(one, "src").join(two, ["dst", "common"]).select("src", "dst", "common")

    def is_multigraph(self) -> bool:
        return not self.simple().where("n > 1").isEmpty()

    def incidence(self) -> DataFrame:
        """(row, col, val): -1 at the source and +1 at the target of each distinct edge, numbered by its ends; loops have none."""
        e = running_total(self.edges.where("src <> dst").select("src", "dst").distinct(), ["src", "dst"], F.lit(1).cast("long"), "col")
        return e.select(F.col("src").alias("row"), "col", F.lit(-1.0).alias("val")).unionByName(e.select(F.col("dst").alias("row"), "col", F.lit(1.0).alias("val")))


def csr_to_coo(offsets: DataFrame) -> DataFrame:
    """(id, position) of each edge slot from (id, offset, degree)."""
    slots = F.sequence(F.col("offset"), F.col("offset") + F.col("degree") - 1)
    return offsets.where("degree > 0").select("id", F.explode(slots).alias("position"))
