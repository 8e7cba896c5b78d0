"""Batches of path queries over one graph as one semi-naive fixpoint.

All queries of a batch share each level's scan of the edges, and share rows as well: a state row holds one vertex and the values of up to
WIDTH queries (a block), so a level is one join and one aggregate of WIDTH minima per edge and block, whatever the mix of kinds.

The state is a log. A level writes only what improved (its frontier), and the log is compacted every COMPACT levels. Candidates and state meet
in one aggregate: in dense levels the whole state takes part, in sparse ones (of a state beyond TOUCH_ROWS) only the vertices that have a
candidate. Edges are written once, bucketed by source, and are never shuffled again; vertices of more than HUB_EDGES edges are split over
several buckets.

push extends the frontier, pull the whole state; both are right on directed graphs. hybrid extends the frontier and decides by its size which part of the
state a level reads. All modes give equal results.

Every kind is a Semiring of Column expressions, so Catalyst sees the whole step. Values are doubles; components are found on dense ranks or by
contraction and come back in the long column `label`, exact for any id.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.components import connected_components
from weftgraph.plans.prefix import dense_ids
from weftgraph.plans.scratch import bucketed, materialize, release, reread


@dataclass(frozen=True)
class Semiring:
    """extend(value, weight) along an edge; the smaller of sign * value wins; sources start from start."""

    kind: str
    extend: Callable[[Column, Column], Column]
    start: float
    sign: int = 1
    both_ways: bool = False
    all_vertices: bool = False


SEMIRINGS = {
    s.kind: s
    for s in (
        Semiring("bfs", lambda v, w: v + 1, 0.0),
        Semiring("sssp", lambda v, w: v + w, 0.0),
        Semiring("wcc", lambda v, w: v, 0.0, both_ways=True, all_vertices=True),
        Semiring("labels", lambda v, w: v, 0.0, all_vertices=True),  # as wcc, along stored directions only
        Semiring("sswp", F.least, float("inf"), sign=-1),
        Semiring("ssnp", F.greatest, 0.0),
        Semiring("viterbi", lambda v, w: v / w, 1.0, sign=-1),
    )
}
#: Shares of pairs (or distinct vertices) and of edges from which a hybrid level counts as dense.
PULL_SHARE, PULL_EDGES = 0.15, 0.20
WIDTH, COMPACT, HUB_EDGES = 16, 8, 1_000_000
#: A state of more rows takes part in a sparse level with the touched vertices only.
TOUCH_ROWS = 2_000_000
#: Names of push strategies. They differ in how threads share a level's edges, which AQE decides here; the name is checked and recorded.
VARIANTS = ("edge_balanced", "shared_node", "query_parallel", "warp", "degree_bucketed")


@dataclass(frozen=True)
class Query:
    query_id: int
    kind: str
    source: int | None = None
    source_value: float | None = None


@dataclass
class BatchResult:
    state: DataFrame  # query_id, kind, vertex, value, label: reached rows only; label (long) is set for wcc and labels
    completion: dict[int, int]  # levels after which each query had settled, counted from its own start
    profiles: list[dict] = field(default_factory=list)
    completed: dict[int, bool] = field(default_factory=dict)
    variant: str = VARIANTS[0]

    def results(self, spark: SparkSession, queries: list[Query]) -> DataFrame:
        rows = [(q.query_id, q.kind, q.source, self.completion.get(q.query_id), self.completed.get(q.query_id, False)) for q in queries]
        return spark.createDataFrame(rows, "query_id long, kind string, source long, completion_level int, completed boolean")

    def profile_table(self, spark: SparkSession) -> DataFrame:
        cols = "iteration int, mode string, frontier_size long, unique_frontier_size long, virtual_edges long, actual_edges long, active_queries int, bytes_written long, wall_ms double"
        return spark.createDataFrame([tuple(p[c.split()[0]] for c in cols.split(", ")) for p in self.profiles], cols)


def check(queries: list[Query], graph: Graph, slots: int | None) -> None:
    if not queries:
        raise ValueError("a batch needs at least one query")
    if len({q.query_id for q in queries}) < len(queries):
        raise ValueError("query ids must differ")
    for q in queries:
        if q.kind not in SEMIRINGS:
            raise ValueError(f"unknown kind {q.kind!r}")
        if not SEMIRINGS[q.kind].all_vertices and (q.source is None or q.source < 0):
            raise ValueError(f"query {q.query_id} needs a source of at least 0")
    if slots is not None and (slots < 1 or sum(SEMIRINGS[q.kind].all_vertices for q in queries) > slots):
        raise ValueError("slots must be at least 1 and hold all whole-graph queries, which can't wait")
    wanted = sorted({q.source for q in queries if not SEMIRINGS[q.kind].all_vertices})
    if wanted:
        known = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")) if graph.implicit else graph.vertices
        found = {r.id for r in known.where(F.col("id").isin(wanted)).distinct().collect()}
        missing = [s for s in wanted if s not in found]
        if missing:
            raise ValueError(f"sources {missing[:5]} are not vertices")


class _Lanes:
    """Which query each (block, column) of the state belongs to, and the Column expressions that follow from it."""

    def __init__(self, width: int):
        self.width, self.queries = width, []
        self.names = [f"v{k}" for k in range(width)]
        # expressions are made once for all levels: a level has hundreds of them
        self.minima = [F.min(n).alias(n) for n in self.names]
        self.both = [*self.minima, *[F.min(f"o{n}").alias(f"o{n}") for n in self.names]]
        nothing = F.lit(None).cast("double")
        self.as_new = [F.col("block"), F.col("vertex"), *[F.col(n) for n in self.names], *[nothing.alias(f"o{n}") for n in self.names]]
        self.as_old = [F.col("block"), F.col("vertex"), *[nothing.alias(n) for n in self.names], *[F.col(n).alias(f"o{n}") for n in self.names]]
        self.better = [F.col("block"), F.col("vertex"), *[F.expr(f"CASE WHEN o{n} IS NULL OR {n} < o{n} THEN {n} END").alias(n) for n in self.names]]
        self.any = F.expr(f"coalesce({', '.join(self.names)}) IS NOT NULL")
        self.made: tuple = (0, [], [])

    def add(self, q: Query) -> int:
        self.queries.append(q)
        return len(self.queries) - 1

    def level(self, two_ways: bool) -> tuple[list[Column], list[Column]]:
        """(the columns that a frontier row offers along an edge, the counts of improved rows by lane) for the queries so far."""
        if self.made[0] != len(self.queries):
            step = [F.col("block"), F.col("dst").alias("vertex"), *[self.extended(k, two_ways).alias(n) for k, n in enumerate(self.names)]]
            counts = [F.expr(f"count(CASE WHEN block = {i // self.width} THEN v{i % self.width} END)").alias(f"{i}") for i in range(len(self.queries))]
            self.made = (len(self.queries), step, [F.count(F.lit(1)).alias("rows"), *counts])
        return self.made[1:]

    def seed_rows(self, lanes: list[int]) -> list[tuple]:
        rows = []
        for lane in lanes:
            q, s = self.queries[lane], SEMIRINGS[self.queries[lane].kind]
            value = s.sign * (s.start if q.source_value is None else float(q.source_value))
            rows.append((lane // self.width, q.source, *[value if k == lane % self.width else None for k in range(self.width)]))
        return rows

    def extended(self, k: int, two_ways: bool) -> Column:
        """The candidate that column k offers along an edge; the kind depends on the block."""
        kinds = {b: q.kind for b, q in enumerate(self.queries[k :: self.width])}
        out: Column | None = None
        for kind in sorted(set(kinds.values())):
            s = SEMIRINGS[kind]
            c = F.lit(s.sign) * s.extend(F.lit(s.sign) * F.col(f"v{k}"), F.col("weight")) if s.sign < 0 else s.extend(F.col(f"v{k}"), F.col("weight"))
            c = F.when(F.col(f"v{k}").isNotNull() & (F.lit(True) if s.both_ways or not two_ways else ~F.col("back")), c)
            if out is None:
                out = c
            else:
                out = F.when(F.expr(f"block IN ({', '.join(str(b) for b, x in kinds.items() if x == kind)})"), c).otherwise(out)
        return F.lit(None).cast("double") if out is None else out

    def least(self, df: DataFrame) -> DataFrame:
        return df.groupBy("block", "vertex").agg(*self.minima)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, q.query_id, q.kind, SEMIRINGS[q.kind].sign) for i, q in enumerate(self.queries)]
        return spark.createDataFrame(rows, "lane int, query_id long, kind string, sign int")


class _Log:
    """The state: one written frame for each level since the last compaction, and the seed rows."""

    def __init__(self, lanes: _Lanes, spark: SparkSession):
        self.lanes, self.spark = lanes, spark
        self.written: list[DataFrame] = []
        self.seeds: list[tuple] = []
        self.n_rows = 0  # at most so many rows, repeats included

    def frame(self, rows: list[tuple]) -> DataFrame:
        """A few rows as a local relation, whose size the planner knows."""
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(2 + self.lanes.width)]
        types = [pa.int32(), pa.int64(), *[pa.float64()] * self.lanes.width]
        return self.spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(["block", "vertex", *self.lanes.names], columns, types, strict=True)}))

    def rows(self) -> DataFrame:
        """All rows, several for a vertex."""
        parts = [reread(self.written[0], [w._weft_path for w in self.written])] if self.written else []
        if self.seeds or not parts:
            parts.append(self.frame(self.seeds))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def add(self, frame: DataFrame, n_rows: int) -> None:
        self.written.append(frame)
        self.n_rows += n_rows

    def compact(self) -> None:
        seen = Observation()
        fresh = materialize(self.lanes.least(self.rows()).observe(seen, F.count(F.lit(1)).alias("rows")))
        release(*self.written)
        self.written, self.seeds, self.n_rows = [fresh], [], seen.get["rows"]

    def improved(self, step: DataFrame, touched_only: bool) -> DataFrame:
        """The least candidates of each vertex that beat the state, null where they don't.

        Candidates and state rows meet in one aggregate, without a join. touched_only keeps the state of other vertices out of its shuffle:
        the candidates are written first, and their vertices pick rows from the log.
        """
        lanes = self.lanes
        best = materialize(lanes.least(step)) if touched_only else None
        old = self.rows() if best is None else self.rows().join(best.select("block", "vertex"), ["block", "vertex"], "left_semi")
        both = (step if best is None else best).select(*lanes.as_new).union(old.select(*lanes.as_old))
        out = both.groupBy("block", "vertex").agg(*lanes.both).select(*lanes.better).where(lanes.any)
        out._weft_path = best._weft_path if best is not None else None  # what to release once the rows are written
        return out


def _edges(base: DataFrame, two_ways: bool, hub_edges: int) -> tuple[DataFrame, DataFrame | None, Row]:
    """(edges bucketed by source, the split vertices (src, parts) or None, counts m and n and largest out-degree top).

    base is bucketed already and is returned as it is where that is enough.
    """
    out = base
    if two_ways:
        back = base.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(True).alias("back"))
        out = bucketed(base.withColumn("back", F.lit(False)).unionByName(back), "src")
    stats = out.groupBy("src").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("m"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("k"), F.lit(0)).alias("top")).first()
    if stats.top <= hub_edges:
        return out, None, stats
    hubs = out.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / hub_edges).cast("int").alias("parts")).where("parts > 1")
    hubs = materialize(hubs)  # at most one row for each hub_edges edges
    split = out.join(F.broadcast(hubs), "src", "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    again = bucketed(split, "src", "part")
    if out is not base:
        release(out)
    return again, hubs, stats


def _ranked(graph: Graph) -> DataFrame:
    return materialize(dense_ids(graph.vertices, "id", "rank"))


def run_batch(
    graph: Graph, queries: list[Query], *, mode: str = "hybrid", max_iterations: int = 0, slots: int | None = None, profile: bool = False,
    start_level: dict[int, int] | None = None, pull_share: float = PULL_SHARE, pull_edges: float = PULL_EDGES, discard_results: bool = False,
    variant: str = VARIANTS[0], width: int = WIDTH, hub_edges: int = HUB_EDGES, touch_rows: int = TOUCH_ROWS,
) -> BatchResult:
    """Answer all queries. slots: at most so many run at once, the next one starts when one has settled (None: all at once).

    start_level delays queries by that many levels. max_iterations > 0 stops early; queries that had not settled keep
    their partial values and count as not completed. discard_results keeps completion and profiles only.

    A hybrid level is dense if the frontier's pairs reach pull_share of queries times vertices, or their edges pull_edges of queries times edges;
    batches of several kinds or with slots go by distinct frontier vertices alone. A wcc query of a hybrid batch without limit or profile is
    answered by contraction, which takes a few rounds on any diameter; its completion counts those rounds.
    """
    if mode not in ("push", "pull", "hybrid", "shared"):
        raise ValueError(f"unknown mode {mode!r}")
    if variant not in VARIANTS:
        raise ValueError(f"unknown push variant {variant!r}")
    spark = graph.edges.sparkSession
    # the graph's own plan runs once: checks, counts and levels read what it gave
    base = bucketed(graph.edges, "src", distinct=True)
    graph = Graph(base, None if graph.implicit else graph.vertices)
    edges = hubs = ranks = None
    pool = ThreadPoolExecutor(1)
    try:
        check(queries, graph, slots)
        contracted = [q for q in queries if q.kind == "wcc"] if mode == "hybrid" and not (max_iterations or profile) else []
        side = pool.submit(_contract, graph) if contracted else None
        queries = [q for q in queries if q not in contracted]
        kinds = {q.kind for q in queries}
        two_ways = any(SEMIRINGS[k].both_ways for k in kinds)
        result = BatchResult(_empty(spark), {}, variant=variant)
        if queries:
            edges, hubs, stats = _edges(base, two_ways, hub_edges)
            if any(SEMIRINGS[k].all_vertices for k in kinds):
                ranks = materialize(dense_ids(graph.vertices, "id", "rank"))
            options = {"mode": mode, "max_iterations": max_iterations, "slots": slots, "profile": profile, "delays": start_level or {}, "pull_share": pull_share, "pull_edges": pull_edges}
            result = _levels(graph, edges, hubs, ranks, stats, queries, two_ways, width=min(width, len(queries)), touch_rows=touch_rows, **options)
            result.variant = variant
            if discard_results:
                result.state = _empty(spark)
        if side:
            found, rounds = side.result()
            for q in contracted:
                result.completion[q.query_id], result.completed[q.query_id] = rounds, True
                if not discard_results:
                    rows = found.select(F.lit(q.query_id).cast("long").alias("query_id"), F.lit(q.kind).alias("kind"), F.col("id").alias("vertex"), F.col("label").cast("double").alias("value"), "label")
                    result.state = result.state.unionByName(rows) if queries or q is not contracted[0] else rows
        return result
    finally:
        pool.shutdown(wait=True)
        release(*{id(f): f for f in (edges, hubs, base)}.values())


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, kind string, vertex long, value double, label long")


def _contract(graph: Graph) -> tuple[DataFrame, int]:
    """(id, label) by star contraction, and its rounds."""
    found = connected_components(graph.edges)
    labels = graph.vertices.join(found.withColumnRenamed("vertex", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    out = materialize(labels)
    rounds = found._weft_rounds
    release(found)
    return out, rounds


def _levels(
    graph: Graph, edges: DataFrame, hubs: DataFrame | None, ranks: DataFrame | None, stats: Row, queries: list[Query], two_ways: bool, *, mode: str, max_iterations: int,
    slots: int | None, profile: bool, delays: dict[int, int], pull_share: float, pull_edges: float, width: int, touch_rows: int,
) -> BatchResult:
    spark = graph.edges.sparkSession
    lanes = _Lanes(width)
    log = _Log(lanes, spark)
    whole = lambda q: SEMIRINGS[q.kind].all_vertices
    # like kinds share blocks, so that a column's expression seldom depends on the block
    pending = sorted(queries, key=lambda q: not whole(q)) if slots else sorted(queries, key=lambda q: q.kind)
    one_kind = len({q.kind for q in queries}) == 1 and not slots
    running: dict[int, int] = {}  # lane -> level at which its query started
    done: dict[int, int] = {}
    # whole-graph kinds run on dense ranks, so labels are exact as doubles; every vertex of the state is then a rank
    if ranks is not None:
        number = lambda c: ranks.select(F.col("key").alias(c), F.col("rank").alias(f"__{c}"))
        kept = [c for c in edges.columns if c not in ("src", "dst")]
        moved = edges.join(number("src"), "src").join(number("dst"), "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"), *kept)
        edges = bucketed(moved, "src", *(["part"] if hubs is not None else []))
        asked = sorted({q.source for q in queries if not whole(q)})
        at = {r.key: r.rank for r in ranks.where(F.col("key").isin(asked)).collect()} if asked else {}
        pending = [q if whole(q) else Query(q.query_id, q.kind, at[q.source], q.source_value) for q in pending]
        if hubs is not None:
            hubs = hubs.join(number("src"), "src").select(F.col("__src").alias("src"), "parts")
    degree = edges.where("not back") if two_ways else edges
    degree = degree.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))
    size: list[int] = []  # the number of vertices, once it is needed

    def n_vertices() -> int:
        if not size:
            size.append(graph.vertices.count() if ranks is None else ranks.count())
        return size[0]

    def admit(level: int) -> list[int]:
        chosen = []
        for q in list(pending):
            if slots is not None and len(running) >= slots:
                break
            if delays.get(q.query_id, 0) <= level:
                pending.remove(q)
                lane = lanes.add(q)
                running[lane] = level
                chosen.append(lane)
        return chosen

    def seeded(chosen: list[int]) -> list[DataFrame]:
        """Frontier rows of queries that start now; they join the log."""
        out = []
        single = lanes.seed_rows([i for i in chosen if not whole(lanes.queries[i])])
        if single:
            log.seeds += single
            out.append(log.frame(single))
        for i in [i for i in chosen if whole(lanes.queries[i])]:
            cells = [(F.col("rank").cast("double") if k == i % width else F.lit(None).cast("double")).alias(n) for k, n in enumerate(lanes.names)]
            log.add(materialize(ranks.select(F.lit(i // width).alias("block"), F.col("rank").cast("long").alias("vertex"), *cells)), n_vertices())
            out.append(log.written[-1])
        return out

    held = F.expr(" + ".join(f"CAST({n} IS NOT NULL AS BIGINT)" for n in lanes.names))
    level, profiles = 0, []
    delta: DataFrame | None = None
    live: dict[int, int] = {}  # lane -> rows of its frontier
    n_rows = 0
    while running or pending:
        started = time.perf_counter()
        for lane in [i for i in running if i not in live]:
            done[lanes.queries[lane].query_id] = max(0, level - running.pop(lane) - 1)
        new = admit(level)
        fronts = ([delta] if live else []) + seeded(new)
        for i in new:
            live[i] = n_vertices() if whole(lanes.queries[i]) else 1
            n_rows += live[i]
        if not live and not pending:
            break
        if max_iterations and level >= max_iterations:
            break
        if not live:  # only delayed queries are left
            level += 1
            continue
        frontier = fronts[0]
        for f in fronts[1:]:
            frontier = frontier.unionByName(f)
        pairs, unique = sum(live.values()), -1
        if profile:
            unique = frontier.select("vertex").distinct().count()
        work = lambda f=frontier: f.select("vertex", held.alias("k")).groupBy("vertex").agg(F.sum("k").alias("k")).join(degree, "vertex")
        now = mode
        if mode == "hybrid":
            # vertices with out-edges (stats.n) are no more than all, rows and pairs no fewer than distinct vertices: most levels need no count
            dense = False
            if one_kind:
                rows_needed, edges_needed = pull_share * len(queries), pull_edges * len(queries) * stats.m
                dense = pairs >= rows_needed * stats.n and pairs >= rows_needed * n_vertices()
                if not dense and pairs * stats.top >= edges_needed:  # else the edges can't reach their share
                    dense = (work().agg(F.sum(F.col("k") * F.col("degree"))).first()[0] or 0) >= edges_needed
            elif n_rows >= pull_share * stats.n and n_rows >= pull_share * n_vertices():
                unique = frontier.select("vertex").distinct().count() if unique < 0 else unique
                dense = unique >= pull_share * n_vertices()
            now = "pull" if dense else "push"
        source = frontier
        if mode == "pull":
            source = lanes.least(log.rows())
        elif mode == "shared":  # one frontier for all queries: a vertex that improved for one is extended for each that reached it
            source = lanes.least(log.rows().join(frontier.select("vertex").distinct(), "vertex", "left_semi"))
        if hubs is not None:
            parts = F.coalesce("parts", F.lit(1))
            source = source.join(F.broadcast(hubs.withColumnRenamed("src", "vertex")), "vertex", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        on = (source["vertex"] == edges["src"]) & (source["part"] == edges["part"]) if hubs is not None else source["vertex"] == edges["src"]
        offers, counts = lanes.level(two_ways)
        fresh = log.improved(source.join(edges, on).select(*offers), now != "pull" and log.n_rows > touch_rows)
        seen = Observation()
        nxt = materialize(fresh.observe(seen, *counts))
        release(fresh)
        count = seen.get
        if profile:
            row = work().agg(F.sum(F.col("k") * F.col("degree")), F.sum("degree")).first()
            profiles.append({"iteration": level, "mode": now, "frontier_size": pairs, "unique_frontier_size": unique, "virtual_edges": row[0] or 0, "actual_edges": row[1] or 0,
                             "active_queries": len(live), "bytes_written": _bytes(spark, nxt._weft_path), "wall_ms": 1000 * (time.perf_counter() - started)})
        n_rows = count.pop("rows") or 0
        live = {int(i): n for i, n in count.items() if n}
        log.add(nxt, n_rows)
        delta = nxt
        level += 1
        if len(log.written) > COMPACT:
            log.written.pop()
            log.compact()  # all but the frontier, which the next level reads by itself
            log.written.append(nxt)
    completed = dict.fromkeys(done, True)
    for lane, at_level in running.items():
        q = lanes.queries[lane].query_id
        done[q], completed[q] = level - at_level, False
    log.compact()
    cells = log.written[0].select("block", "vertex", F.posexplode(F.array(*lanes.names)).alias("k", "value")).where("value is not null")
    cells = cells.withColumn("lane", F.col("block") * width + F.col("k")).join(F.broadcast(lanes.table(spark)), "lane")  # one row for each query
    state = cells.select("query_id", "kind", "vertex", (F.col("value") * F.col("sign")).alias("value"))
    if ranks is None:
        return BatchResult(state.withColumn("label", F.lit(None).cast("long")), done, profiles, completed)
    names = ranks.select(F.col("rank").alias("vertex"), F.col("key").alias("id"))
    labels = ranks.select(F.col("rank").alias("r"), F.col("key").alias("label"))
    label_kinds = F.col("kind").isin([s.kind for s in SEMIRINGS.values() if s.all_vertices])
    state = state.join(names, "vertex").withColumn("r", F.when(label_kinds, F.col("value").cast("long"))).join(labels, "r", "left")
    state = materialize(state.select("query_id", "kind", F.col("id").alias("vertex"), F.coalesce(F.col("label").cast("double"), "value").alias("value"), "label"))
    release(edges, ranks, *log.written)
    return BatchResult(state, done, profiles, completed)


def _bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def parents(graph: Graph, result: BatchResult) -> DataFrame:
    """(query_id, vertex, parent): the smallest predecessor on a shortest path; an extension for bfs and sssp queries."""
    s = result.state.where(F.col("kind").isin("bfs", "sssp"))
    before = s.select("query_id", "kind", F.col("vertex").alias("src"), F.col("value").alias("before"))
    step = before.join(graph.edges, "src").withColumn("reach", F.when(F.col("kind") == "bfs", F.col("before") + 1).otherwise(F.col("before") + F.col("weight")))
    hit = step.join(s.select("query_id", F.col("vertex").alias("dst"), "value"), ["query_id", "dst"]).where("reach = value and (before < value)")
    return hit.groupBy("query_id", F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))


def overlap(result: BatchResult) -> DataFrame:
    """(query_id, n_reached, n_shared): vertices of each query, and how many another query reached too."""
    s = result.state.select("query_id", "vertex").distinct()
    by = s.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
    return s.join(by, "vertex").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_reached"), F.sum((F.col("n") > 1).cast("long")).alias("n_shared"))


def hops_to_hubs(graph: Graph, n_hubs: int) -> DataFrame:
    """(id, hops): least hops from each vertex to one of the n_hubs vertices of largest out-degree."""
    hubs = [r.id for r in graph.out_degree().orderBy(F.desc("degree"), "id").limit(n_hubs).collect()]
    found = run_batch(graph.reverse(), [Query(i, "bfs", h) for i, h in enumerate(hubs)], mode="push")
    return found.state.groupBy(F.col("vertex").alias("id")).agg(F.min("value").cast("long").alias("hops"))


def affinity_batches(graph: Graph, queries: list[Query], size: int, n_hubs: int = 4) -> list[list[Query]]:
    """Queries sorted by their sources' hops to the hubs and cut in batches of `size`: like frontiers meet in a batch."""
    spark = graph.edges.sparkSession
    asked = spark.createDataFrame([(q.source,) for q in queries], "id long").distinct()
    hops = {r.id: r.hops for r in hops_to_hubs(graph, n_hubs).join(asked, "id").collect()}
    order = sorted(queries, key=lambda q: (hops.get(q.source, 1 << 30), q.source, q.query_id))
    return [order[i : i + size] for i in range(0, len(order), size)]


def delayed_starts(graph: Graph, queries: list[Query], n_hubs: int = 4) -> dict[int, int]:
    """start_level for run_batch: queries far from the hubs start first, so all reach them in the same level."""
    spark = graph.edges.sparkSession
    asked = spark.createDataFrame([(q.source,) for q in queries], "id long").distinct()
    hops = {r.id: r.hops for r in hops_to_hubs(graph, n_hubs).join(asked, "id").collect()}
    far = max(hops.values(), default=0)
    return {q.query_id: far - hops.get(q.source, far) for q in queries}
