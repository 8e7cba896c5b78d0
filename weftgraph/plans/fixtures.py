"""Graphs over the relational tables, and the SQL that builds the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph

#: e(src, dst, w) and v(id): each part to the next part of its order, weighing the least quantity.
PARTS_SQL = """
lines AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
e AS (SELECT src, dst, CAST(min(q) AS DOUBLE) AS w FROM lines WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
#: n(src, dst) is undirected, both ways.
UNDIRECTED_SQL = "n AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
CONV_SQL = "c AS (SELECT conv_id AS graph_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM (SELECT DISTINCT conv_id, turn FROM conversations)), e AS (SELECT * FROM c WHERE dst IS NOT NULL)"
GEO_SQL = """
e AS (SELECT CAST(n_regionkey AS BIGINT) AS src, 100 + CAST(n_nationkey AS BIGINT) AS dst FROM nation
      UNION SELECT 100 + CAST(c_nationkey AS BIGINT), 1000 + c_custkey FROM customer
      UNION SELECT 100 + CAST(s_nationkey AS BIGINT), 100000000 + s_suppkey FROM supplier),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, missing: float = 1.0) -> Graph:
    """As PARTS_SQL gives them: nulls come last in an order, halves are rounded as its CAST does (doubles to even, decimals up). missing weighs edges without a quantity."""
    by = Window.partitionBy("l_orderkey").orderBy(*[F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    lines = table(spark, sf_dir, "lineitem")
    whole = F.rint if dict(lines.dtypes)["l_quantity"] in ("double", "float") else F.round
    lines = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(by).alias("dst"), whole("l_quantity").cast("long").alias("q"))
    e = lines.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.coalesce(F.min("q").cast("double"), F.lit(missing)).alias("weight"))
    return Graph(e)


def part_sources(graph: Graph, n: int) -> list[int]:
    return [r.id for r in graph.vertices.orderBy("id").limit(n).collect()]


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    a = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey").cast("long") + 100).alias("dst"))
    b = table(spark, sf_dir, "customer").select((F.col("c_nationkey").cast("long") + 100).alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    c = table(spark, sf_dir, "supplier").select((F.col("s_nationkey").cast("long") + 100).alias("src"), (F.col("s_suppkey") + 100000000).alias("dst"))
    return Graph(a.unionByName(b).unionByName(c).distinct())


def conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("id")).distinct()
    e = turns.select("graph_id", F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("graph_id").orderBy("id")).alias("dst")).where("dst is not null")
    return turns, e


def part_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def customer_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, val): quantity that a customer bought from a supplier."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity")
    return line.join(o, "o_orderkey").groupBy(F.col("o_custkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
