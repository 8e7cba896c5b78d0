"""A loop over DataFrames for algorithms of a user's own: prepare, step until settled, finish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.scratch import materialize, release


class Fixpoint:
    """Subclasses give prepare() and step(). The state is any DataFrame; by default it settles when no row has a true `active`.

    Each state is written below the shared folder and read back, so a plan covers one step only and survives lost executors; the state
    before it is deleted.
    """

    max_iterations = 10_000

    def __init__(self, graph: Graph):
        self.graph = graph
        self.iterations = 0

    def prepare(self) -> DataFrame:
        """The first state."""
        raise NotImplementedError

    def step(self, state: DataFrame, iteration: int) -> DataFrame:
        """The state after one more round."""
        raise NotImplementedError

    def converged(self, state: DataFrame, iteration: int) -> bool:
        return state.where("active").isEmpty()

    def finish(self, state: DataFrame) -> DataFrame:
        """The result of the last state, without its bookkeeping."""
        return state.drop("active")

    def run(self) -> DataFrame:
        """The finished result; an error if the state has not settled after max_iterations steps."""
        state = materialize(self.prepare())
        for self.iterations in range(self.max_iterations + 1):
            if self.converged(state, self.iterations):
                return self.finish(state)
            if self.iterations == self.max_iterations:
                break
            fresh = materialize(self.step(state, self.iterations))
            release(state)
            state = fresh
        release(state)
        raise RuntimeError(f"not settled in {self.max_iterations} iterations")


class Reached(Fixpoint):
    """(id, level): steps from the nearest source, as a loop that a user could write. run_batch() answers many of them at once."""

    def __init__(self, graph: Graph, sources: DataFrame):
        super().__init__(graph)
        self.sources = sources

    def prepare(self) -> DataFrame:
        return self.sources.select(F.col(self.sources.columns[0]).cast("long").alias("id")).distinct().withColumns({"level": F.lit(0).cast("long"), "active": F.lit(True)})

    def step(self, state: DataFrame, iteration: int) -> DataFrame:
        front = state.where("active").select(F.col("id").alias("src"))
        near = self.graph.edges.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        new = near.join(state, "id", "left_anti").withColumns({"level": F.lit(iteration + 1).cast("long"), "active": F.lit(True)})
        return state.withColumn("active", F.lit(False)).unionByName(new)
