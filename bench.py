"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from weftgraph.operators.fixpoint import Query, run_batch  # noqa: E402
from weftgraph.plans import catalog, fixtures  # noqa: E402
from weftgraph.plans.scratch import materialize  # noqa: E402

NAMES = ["batch_bfs", "batch_bfs_push", "batch_bfs_pull", "batch_sssp", "heterogeneous_batch", "replenish_queue", "connected_components", "pagerank", "hits", "triangle_count", "spmv", "spmm", "u_mul_e_sum", "edge_softmax", "degree_histogram", "metapath_reachable", "select_topk"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["out_degree"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's code paths
    times: dict[str, float] = {}

    def timed(name: str, fn) -> None:
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)

    for name in NAMES:
        timed(name, lambda name=name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    # the cost of a batch against its size: one scan of the edges per level serves all queries
    graph = fixtures.parts(spark, sf_dir)
    graph.edges, graph.vertices = materialize(graph.edges), materialize(graph.vertices)
    sources = fixtures.part_sources(graph, 64)
    for kind in ("bfs", "sssp"):
        for q in (1, 4, 16, 64):
            timed(f"{kind}_q{q}", lambda kind=kind, q=q: run_batch(graph, [Query(i, kind, s) for i, s in enumerate(sources[:q])]))
    mixed = [Query(i, ("bfs", "sssp")[i % 2], s) for i, s in enumerate(sources[:16])]
    timed("queue_16_in_8_slots", lambda: run_batch(graph, mixed, slots=8))
    timed("two_batches_of_8", lambda: [run_batch(graph, mixed[i : i + 8]) for i in (0, 8)])
    ratios = {f"{k}_q{q}_over_q_times_q1": round(times[f"{k}_q{q}"] / (q * times[f"{k}_q1"]), 3) for k in ("bfs", "sssp") for q in (4, 16, 64)}
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "ratios": ratios, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
