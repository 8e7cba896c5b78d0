"""Cutting lineage in iterative plans through files that every executor can read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A machine's own temporary folder stands in for it only where all executors run on that machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + os.path.join(tempfile.gettempdir(), "weftgraph-checkpoints")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new, unused folder below the shared root."""
    return f"{shared_root(spark)}/weft-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df below the shared root and read it back: the plan restarts from files that survive lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return reread(df, [path])


def reread(like: DataFrame, paths: list[str]) -> DataFrame:
    """One scan over folders that materialize() wrote with the columns of `like`."""
    out = like.sparkSession.read.schema(like.schema).parquet(*paths)
    out._weft_path = paths[0] if len(paths) == 1 else None
    return out


def bucketed(df: DataFrame, *keys: str, distinct: bool = False) -> DataFrame:
    """As materialize(), in buckets by the keys: joins and aggregates on them read the files without a shuffle of this side."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"weft_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(n, *keys)  # equal rows meet here as well, so distinct rows cost no further shuffle
    (placed.distinct() if distinct else placed).write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._weft_path, out._weft_table = path, name
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what materialize() or bucketed() wrote, once nothing reads it any more."""
    for df in frames:
        if name := getattr(df, "_weft_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_weft_path", None):
            drop_dir(df.sparkSession, path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
