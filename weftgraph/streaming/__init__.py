"""Query arrivals as a stream: each micro-batch of queries is answered as one batch over the same graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.graph import Graph
from weftgraph.operators.fixpoint import Query, run_batch


def serve(arrivals: DataFrame, graph: Graph, sink: Callable[[DataFrame, int], None], checkpoint: str, *, slots: int = 64, once: bool = False) -> StreamingQuery:
    """arrivals: a stream of (query_id, kind, source). sink gets each micro-batch's state(query_id, kind, vertex, value)."""

    def answer(batch: DataFrame, epoch: int) -> None:
        asked = [Query(r.query_id, r.kind, r.source) for r in batch.select("query_id", "kind", "source").collect()]
        if asked:
            sink(run_batch(graph, asked, slots=slots).state, epoch)

    writer = arrivals.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
