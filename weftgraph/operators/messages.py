"""Message passing: a message is a Column over an edge and its two ends, a reduction one aggregate per target.

All of it is one join per end that is read and one map-side combined aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce as fold

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from weftgraph.plans.scratch import materialize, release

OPS: dict[str, Callable[[Column, Column], Column]] = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b)}
REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "prod": F.product}


def copy(end: str, field: str) -> Column:
    """Message that copies a field of u (source), v (target) or e (edge)."""
    return F.col(f"{end}_{field}") if end in "uv" else F.col(field)


def binary(op: str, left: str, left_field: str, right: str, right_field: str) -> Column:
    """Message of two different ends; `dot` takes array fields, a scalar is broadcast over an array."""
    if left == right:
        raise ValueError("the two sides must differ")
    a, b = copy(left, left_field), copy(right, right_field)
    if op == "dot":
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return OPS[op](a, b)


def binary_arrays(op: str, left: str, left_field: str, right: str, right_field: str) -> Column:
    """As binary(), element by element over array fields."""
    return F.zip_with(copy(left, left_field), copy(right, right_field), OPS[op])


def apply_edges(edges: DataFrame, message: Column, out: str = "m", nodes: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """edges plus `out`. Fields of nodes(id, ...) are read as u_<field>, those of targets (nodes if not given) as v_<field>."""
    e = edges
    used = message._jc.toString()
    for end, key, table in (("u", "src", nodes), ("v", "dst", targets if targets is not None else nodes)):
        if table is not None and f"{end}_" in used:
            e = e.join(table.select(F.col("id").alias(key), *[F.col(c).alias(f"{end}_{c}") for c in table.columns if c != "id"]), key, "left")
    return e.withColumn(out, message).select(*edges.columns, out)


def update_all(edges: DataFrame, nodes: DataFrame, message: Column, reducer: str = "sum", out: str = "h", *, targets: DataFrame | None = None, default: Column | None = None) -> DataFrame:
    """(id, out) for every target: the reduced messages; without in-edges `default`, which may read the target's old fields (null if not given)."""
    m = apply_edges(edges, message, "__m", nodes, targets)
    got = m.groupBy(F.col("dst").alias("id")).agg(REDUCERS[reducer](F.col("__m")).alias(out))
    ends = targets if targets is not None else nodes
    if default is None:
        return ends.select("id").join(got, "id", "left")
    return ends.join(got.withColumnRenamed(out, "__h"), "id", "left").select("id", F.coalesce(F.col("__h"), default).alias(out))


def pull(edges: DataFrame, nodes: DataFrame, at: DataFrame, message: Column, reducer: str = "sum", out: str = "h") -> DataFrame:
    """update_all() for the target ids `at` only: other edges are dropped before any join."""
    ids = at.select(F.col(at.columns[0]).alias("dst")).distinct()
    return update_all(edges.join(ids, "dst", "left_semi"), nodes, message, reducer, out, targets=nodes.join(ids.withColumnRenamed("dst", "id"), "id", "left_semi"))


def push(edges: DataFrame, nodes: DataFrame, sources: DataFrame, message: Column, reducer: str = "sum", out: str = "h") -> DataFrame:
    """Messages from the given sources only; (id, out) of the targets they reach."""
    ids = sources.select(F.col(sources.columns[0]).alias("src")).distinct()
    return update_all(edges.join(ids, "src", "left_semi"), nodes, message, reducer, out).where(F.col(out).isNotNull())


def multi_update_all(parts: list[tuple[DataFrame, DataFrame, Column, str]], cross: str = "sum", out: str = "h") -> DataFrame:
    """Per edge type (edges, nodes, message, reducer), then one cross reduction over the types that reached a target; `stack` gives an array by type."""
    each = []
    for k, (edges, nodes, message, reducer) in enumerate(parts):
        each.append(update_all(edges, nodes, message, reducer, out).where(F.col(out).isNotNull()).withColumn("__k", F.lit(k)))
    both = fold(DataFrame.unionByName, each)
    if cross == "stack":
        return both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__k", out))).alias("s")).select("id", F.transform("s", lambda x: x[out]).alias(out))
    return both.groupBy("id").agg(REDUCERS[cross](F.col(out)).alias(out))


def edge_softmax(edges: DataFrame, score: str, out: str = "a") -> DataFrame:
    """Softmax of an edge column over the in-edges of each target."""
    return _softmax(edges, score, "dst", out)


def _softmax(rows: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """exp(value) over the sum of its group, null where the value is null.

    The sum is of bins: a group's values are added up map-side by their rounded value, so only (group, bin, sum) rows are shuffled. A row
    then meets its group's largest bin and sum in one join, which AQE may split for a large group; a window could not be split.
    """
    bins = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by"), F.rint(value).alias("__bin")).agg(F.sum(F.exp(F.col(value) - F.rint(value))).alias("__s"))
    top = bins.withColumn("__top", F.max("__bin").over(Window.partitionBy("__by")))
    norm = top.groupBy("__by", "__top").agg(F.sum(F.col("__s") * F.exp(F.col("__bin") - F.col("__top"))).alias("__all"))
    joined = rows.join(norm, F.col(by).eqNullSafe(F.col("__by")), "left")
    return joined.withColumn(out, F.exp(F.col(value) - F.col("__top")) / F.col("__all")).drop("__by", "__top", "__all")


def group_apply_edges(edges: DataFrame, by: str, value: Column, out: str) -> DataFrame:
    """Every edge with an aggregate over all edges of one end: a map-side combined aggregate and a join instead of a window."""
    got = edges.groupBy(F.col(by).alias("__by")).agg(value.alias(out))
    return edges.join(got, F.col(by).eqNullSafe(F.col("__by"))).select(*[edges[c] for c in edges.columns if c != out], out)


def readout(rows: DataFrame, value: str, reducer: str = "sum", by: str = "graph_id", weight: str | None = None) -> DataFrame:
    """(graph, value): one reduced value for each graph of a batch; a weight scales values (and divides a mean)."""
    v = F.col(value) * F.col(weight) if weight else F.col(value)
    agg = F.sum(v) / F.sum(weight) if weight and reducer == "mean" else REDUCERS[reducer](v)
    return rows.groupBy(by).agg(agg.alias(value))


def softmax_readout(rows: DataFrame, value: str, by: str = "graph_id", out: str = "p") -> DataFrame:
    """Softmax of a column over the rows of each graph."""
    return _softmax(rows, value, by, out)


def broadcast_readout(rows: DataFrame, graphs: DataFrame, by: str = "graph_id") -> DataFrame:
    """Every row with its graph's values."""
    return rows.join(graphs, by, "left")


def topk(rows: DataFrame, k: int, value: str, by: str, tie: str, ascending: bool = False) -> DataFrame:
    """The k rows of each group with the largest (or smallest) value, and their rank."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(tie)))).where(F.col("rank") <= k)


def map_edges(edges: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], nodes: DataFrame, out: str = "m", kind: str = "double") -> DataFrame:
    """As apply_edges() with a user's function of an edge batch: it gets a frame of the edge's columns, u_<field> and v_<field>, and returns a column."""
    e = edges
    for end, key in (("u", "src"), ("v", "dst")):
        e = e.join(nodes.select(F.col("id").alias(key), *[F.col(c).alias(f"{end}_{c}") for c in nodes.columns if c != "id"]), key, "left")

    kept = edges.columns

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[kept].assign(**{out: fn(f)})

    return e.mapInPandas(batches, StructType([*edges.schema.fields, StructField(out, DataType.fromDDL(kind))]))


def mailbox_reduce(
    edges: DataFrame, nodes: DataFrame, message: Column, fn: Callable[[np.ndarray], float], out: str = "h", *, merge: Callable[[np.ndarray], float] | None = None,
    box: int = 100_000, hub: int = 1_000_000,
) -> DataFrame:
    """(id, out) for targets that got messages: a user's function of the array of a target's messages, in no particular order; null messages are left out.

    With `merge`, a function of partial results, a mailbox is cut in parts of up to `box` messages, fn reduces each part and merge the results of
    a mailbox. One of more than `hub` messages is dealt to several tasks, so that none costs more than its share. Without merge fn needs the whole
    mailbox at once, and one beyond `box` messages is an error.
    """
    m = apply_edges(edges, message, "__m", nodes).select(F.col("dst").alias("id"), "src", F.col("__m").cast("double").alias("m")).where("m is not null and id is not null")
    if merge is None:
        if not m.groupBy("id").count().where(F.col("count") > box).isEmpty():
            raise ValueError(f"mailboxes of over {box} messages need a merge function")
        return _reduced(m.repartition("id"), fn, out)
    m = materialize(m)
    hubs = m.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts")).where("parts > 1")  # at most one row for each hub messages
    part = F.pmod(F.xxhash64("src", "m"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = m.join(F.broadcast(hubs), "id", "left").select("id", part.alias("part"), "m").repartition("id", "part")
    some = materialize(_reduced(dealt, fn, "m", box))
    release(m)
    return _reduced(some.repartition("id"), merge, out)


def _reduced(dealt: DataFrame, fn: Callable[[np.ndarray], float], out: str, box: int | None = None) -> DataFrame:
    """(id, out): fn of the messages m of each id in a partition, in parts of up to `box`. One sort and one Python call for each part, no frame for it."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # the last id of the batch before, which may go on, and its messages not yet reduced
        for b in batches:
            ids, m = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            keys, values = [], []
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                if held and ids[at] != key:
                    keys.append(key)
                    values.append(float(fn(np.concatenate(held))))
                    held = []
                key, rows = int(ids[at]), m[at:end]
                if box is not None:
                    rows = np.concatenate([*held, rows]) if held else rows
                    held = []
                    while len(rows) > box:
                        keys.append(key)
                        values.append(float(fn(rows[:box])))
                        rows = rows[box:]
                held.append(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], ["id", out])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([float(fn(np.concatenate(held)))], pa.float64())], ["id", out])

    return dealt.select("id", "m").sortWithinPartitions("id").mapInArrow(runs, f"id long, {out} double")
