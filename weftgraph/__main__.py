"""Command line: python -m weftgraph bfs graph.mtx --source 0 --out levels."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from weftgraph import api
from weftgraph.graph import Graph
from weftgraph.sources.files import read_sources

BATCHES = ("bfs", "sssp", "sswp", "ssnp", "viterbi")
SEEDED = {"ppr": api.ppr, "bc": api.bc}
WHOLE = {"wcc": api.wcc, "pagerank": api.pagerank, "hits": api.hits, "kcore": api.kcore, "mst": api.mst, "tc": api.tc, "color": api.color, "communities": api.communities}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description="One algorithm over one graph.")
    p.add_argument("algorithm", choices=sorted([*BATCHES, *SEEDED, *WHOLE]))
    p.add_argument("graph", help="path; the suffix names the format")
    p.add_argument("--source", help="vertex ids with commas between them, or a file of one id a line")
    p.add_argument("--undirected", action="store_true", help="add the other direction of every edge")
    p.add_argument("--no-self-loops", action="store_true")
    p.add_argument("--mode", choices=["hybrid", "push", "pull", "shared"], default="hybrid")
    p.add_argument("--slots", type=int, help="queries that run at once")
    p.add_argument("--max-iterations", type=int, default=0)
    p.add_argument("--out", help="folder for Parquet; without it the first rows are shown")
    return p


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    graph = api.read_graph(spark, args.graph)
    graph = graph.without_self_loops() if args.no_self_loops else graph
    graph = graph.symmetric() if args.undirected else graph
    if args.algorithm in WHOLE:
        return WHOLE[args.algorithm](graph)
    sources = read_sources(spark, args.source) if args.source else _first(graph)
    if args.algorithm in SEEDED:
        return SEEDED[args.algorithm](graph, sources)
    return api.paths(graph, args.algorithm, sources, mode=args.mode, slots=args.slots, max_iterations=args.max_iterations)


def _first(graph: Graph) -> list[int]:
    """The smallest vertex, where no source is named."""
    return [graph.vertices.agg({"id": "min"}).first()[0]]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    found = answer(spark, args)
    if args.out:
        found.write.parquet(args.out)
    else:
        found.show()


if __name__ == "__main__":
    main()
