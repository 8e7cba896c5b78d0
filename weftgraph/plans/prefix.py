"""Running totals and dense numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.scratch import materialize


def running_total(df: DataFrame, order: list[str], value: Column | str = "1", out: str = "total") -> DataFrame:
    """df plus `out`: the sum of value over all rows before, in the order of `order` (unique keys give one answer).

    Rows are range-partitioned and written once, so that their partition numbers can't move; sums of whole partitions, one row
    for each task, are added up in a window of that size and joined back, and the rest runs inside the partitions.
    """
    value = F.expr(value) if isinstance(value, str) else value
    placed = df.withColumn("__value", value).repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    placed = materialize(placed.withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out_df = placed.join(starts, "__part").withColumn(out, F.col("__start") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return out_df.drop("__part", "__value", "__start")


def dense_ids(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """(key, out): the distinct non-null keys numbered 0, 1, ... in their order."""
    keys = df.select(F.col(key).alias("key")).where("key is not null").distinct()
    return running_total(keys, ["key"], F.lit(1).cast("long"), out)
