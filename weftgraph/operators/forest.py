"""Which edges each cut of their weights connects, by one minimum spanning forest: for integer ids that fit one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.scratch import materialize, release

#: Rows that a task takes at once beside its forest.
CHUNK = 500_000


def spanning(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, by rounds in which each component takes its lightest edge out (Boruvka)."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.argsort(w, kind="stable")  # a place in it is the edge's weight from here on, so that no two are equal
    a, b, at, chosen = ends[: len(u)][order], ends[len(u) :][order], np.arange(len(u)), []
    n = len(ids)
    while True:
        out = a != b
        a, b, at = a[out], b[out], at[out]
        if not len(a):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        best = np.full(n, len(a))
        np.minimum.at(best, a, np.arange(len(a)))
        np.minimum.at(best, b, np.arange(len(a)))
        roots = np.flatnonzero(best < len(a))
        taken = best[roots]
        to = np.arange(n)
        to[roots] = a[taken] + b[taken] - roots  # the other end
        both = roots[(to[to[roots]] == roots) & (roots < to[roots])]  # two that took the same edge
        to[both] = both
        while not np.array_equal(far := to[to], to):
            to = far
        chosen.append(at[np.unique(taken)])
        a, b = to[a], to[b]


def _links(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, parent, at) of a forest's edges: the smaller tree's root goes below the larger's at the weight that joins them, so no vertex is deep."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, order = len(ids), np.argsort(w, kind="stable")
    parent, size, near = np.arange(n), np.ones(n, np.int64), memoryview(np.arange(n))  # near: as parent, but shortened
    at = np.full(n, np.inf)
    up, sizes, when = memoryview(parent), memoryview(size), memoryview(at)
    for x, y, cut in zip(memoryview(ends[: len(u)][order]), memoryview(ends[len(u) :][order]), memoryview(np.ascontiguousarray(w[order], np.float64))):
        while near[x] != x:
            near[x] = x = near[near[x]]
        while near[y] != y:
            near[y] = y = near[near[y]]
        if sizes[x] > sizes[y]:
            x, y = y, x
        up[x] = near[x] = y
        when[x] = cut
        sizes[y] += sizes[x]
    return ids, parent, at


def _reduced(finish: Callable[..., tuple], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's edges (u, v, w) the forest alone is kept, and finish() makes the rows of it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, kept = [], 0, 0

        def forest() -> list[np.ndarray]:
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            some = spanning(u, v, w)
            return [u[some], v[some], w[some]]

        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows > kept + max(CHUNK, kept):
                held = [forest()]
                rows = kept = len(held[0][0])
        if rows:
            out = finish(*forest())
            for k in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in out], names)

    return go


@dataclass(frozen=True)
class Tree:
    """ids, rising; of each the place of the vertex above and the weight of the link to it (infinite at a root); degree in all edges."""

    ids: np.ndarray
    parent: np.ndarray
    at: np.ndarray
    degree: np.ndarray

    def joined(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The least w for each pair such that edges of at most w connect it; u and v are places in one tree."""
        u, v, top = u.copy(), v.copy(), np.full(len(u), -np.inf)
        live = np.flatnonzero(u != v)
        while len(live):
            a, b = u[live], v[live]
            first = self.at[a] <= self.at[b]  # links get heavier upwards, so the lighter one is on the path
            top[live] = np.maximum(top[live], np.where(first, self.at[a], self.at[b]))
            u[live], v[live] = np.where(first, self.parent[a], a), np.where(first, b, self.parent[b])
            live = live[u[live] != v[live]]
        return top

    def labels(self, cut: float) -> np.ndarray:
        """For each vertex the least id of its component of the edges below cut."""
        root = np.where(self.at < cut, self.parent, np.arange(len(self.ids)))
        while not np.array_equal(far := root[root], root):
            root = far
        least = np.full(len(self.ids), len(self.ids))
        np.minimum.at(least, root, np.arange(len(self.ids)))
        return self.ids[least[root]]


def tree(edges: DataFrame, degree: DataFrame) -> Tree:
    """The Tree of edges(u, v, w), u < v. degree (id, k) has every vertex. Each task keeps the forest of its edges, one task the forest of those."""
    spark = edges.sparkSession
    rows = edges.select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("w").cast("double"))
    rows = rows.repartition(max(2, spark.sparkContext.defaultParallelism))
    some = materialize(rows.mapInArrow(_reduced(lambda *e: e, ["u", "v", "w"]), "u long, v long, w double"))
    found = some.repartition(1).mapInArrow(_reduced(_links, ["id", "parent", "at"]), "id long, parent long, at double").toArrow()
    release(some)
    k = degree.select(F.col("id").cast("long").alias("id"), F.col("k").cast("long").alias("k")).toArrow()
    id_, parent, at = (c.to_numpy() for c in found.columns)
    of, n = (c.to_numpy() for c in k.columns)
    return Tree(id_, parent, at, n[np.argsort(of)])


def cut_gains(edges: DataFrame, held, cuts: list[float], n_edges: int) -> list[float]:
    """For each of the rising cuts, the sum of 2 * (1 - ku * kv / m2) / m2 over the edges (u, v, w) that it connects and no lower one does. held: a broadcast Tree."""
    m2, n = 2 * n_edges, len(cuts)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, total = held.value, np.zeros(n + 1)
        limits = np.array(cuts)
        for b in batches:
            u, v = (np.searchsorted(t.ids, c.to_numpy(zero_copy_only=False)) for c in b.columns)
            first = np.searchsorted(limits, t.joined(u, v), side="right")  # the first cut above it
            total += np.bincount(first, 2 * (1 - t.degree[u] * t.degree[v] / m2) / m2, n + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "gain"])

    rows = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(gains, "place long, gain double")
    out = [0.0] * n
    for r in rows.where(F.col("place") < n).groupBy("place").agg(F.sum("gain").alias("gain")).collect():
        out[r.place] = r.gain
    return out


def labelled(vertices: DataFrame, held, cut: float) -> DataFrame:
    """(id, component) of vertices(id) that the broadcast Tree holds, component as of Tree.labels()."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        of = t.labels(cut)
        for b in batches:
            id_ = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(of[np.searchsorted(t.ids, id_)])], ["id", "component"])

    return vertices.select(F.col("id").cast("long").alias("id")).mapInArrow(go, "id long, component long")
