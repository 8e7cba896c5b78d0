"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule, a piecewise linear weight over training time 0..1. Its target is its share of the budget
(water-filling: never above `max_repeat` times its own size); its demand up to time t is the target times the integral
of its schedule up to t over the whole integral. Documents of a source stand in a fixed hashed order; the cumulative
words before a document, inverted through the demand, give the document's training position. A source with a
target above its size starts again from its first document. Documents are range-sorted by position.

The order inside a source is by hash prefix: sums of the prefixes are added up first, then documents inside a prefix,
so a source of any size is spread over many tasks.

Defined results: null text has size 0 and takes nothing. A null source is a source of its own, last in order. Rows of equal
id and text share a place in the order and are interchangeable. An empty table gives an empty result. A text's length only counts its words. Other columns
pass through; one named mix (or, in the curriculum, position) is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD_RE

WEIGHTS = (3, 1, 2)
#: Schedules by rank of the source, repeating: rising, steady and falling, as (time, weight) knots.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
ROWS_PER_PREFIX = 4096


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(time at start, share of demand before, share inside, weight at start, slope), weights scaled to a whole integral of 1."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or min(w for _, w in knots) < 0:
        raise ValueError("a schedule needs rising times from 0 to 1 and weights of at least 0")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total = sum(areas)
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    out, before = [], 0.0
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        out.append((t0, before, area / total, w0 / total, (w1 - w0) / (t1 - t0) / total))
        before += area / total
    return out


def _position(share: Column, rank: Column, schedules: tuple) -> Column:
    """The time at which the schedule's demand reaches `share` of its whole."""
    result: Column | None = None
    for r, knots in enumerate(schedules):
        at: Column | None = None
        for t0, before, inside, w0, slope in _segments(knots):
            d = F.least(F.greatest(share - F.lit(before), F.lit(0.0)), F.lit(inside))
            # w0 x + slope x^2 / 2 = d, in the form that is stable for a small slope
            x = F.lit(t0) + F.when(d > 0, 2 * d / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * d, F.lit(0.0))))).otherwise(0.0)
            at = x if at is None else F.when(share > F.lit(before), x).otherwise(at)
        hit = (rank % len(schedules)) == r
        result = F.when(hit, at) if result is None else result.when(hit, at)
    return result


def targets(stats: DataFrame, weights: tuple[int, ...], budget: float, max_repeat: int) -> DataFrame:
    """stats (source, source_size) with rank and target. Water-filling in closed form over the sources."""
    every = Window.partitionBy(F.lit(1))
    ranked = stats.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("w", cycle[F.col("rank") % len(weights)]).withColumn("cap", F.col("source_size") * max_repeat)
    ranked = ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(budget)).withColumn("level", F.col("cap") / F.col("w"))
    order = every.orderBy("level", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # a source is capped if the level reached by capping all sources below it is not under its own
    capped = ranked.withColumn("capped", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after) >= F.col("level"))
    capped = capped.withColumn("used", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    capped = capped.withColumn("free", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("total") - F.col("used")) / F.col("free"))
    return capped.select("source", "source_size", "rank", target.alias("target"))


def plan(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, budget: float = 1.5, max_repeat: int = 2,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", rows_per_prefix: int = ROWS_PER_PREFIX, out: str = "mix",
) -> DataFrame:
    """All columns and rows of docs, plus a struct `out` (replacing a column of that name): size, source_size, target, taken, positions (one for each copy taken, ascending).

    taken counts the words of all copies; the last document that a source's target reaches is taken in part.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\x01"), body))
    keyed = docs.withColumn("__weft", F.struct(F.col(source).cast("string").alias("source"), F.regexp_count(body, F.lit(WORD_RE)).cast("long").alias("size"), order.alias("h")))
    largest = docs.groupBy(F.col(source)).count().agg(F.max("count")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, largest / rows_per_prefix), 16)))
    # plain key columns, so that the join and the window below share one shuffle of the rows
    keyed = keyed.withColumns({"__weft_s": F.coalesce(F.concat(F.lit("="), "__weft.source"), F.lit("-")), "__weft_p": F.substring("__weft.h", 1, digits)})
    sums = keyed.select("__weft_s", "__weft_p", "__weft.source", "__weft.size").groupBy("__weft_s", "__weft_p").agg(F.any_value("source").alias("source"), F.sum("size").alias("words"))
    known = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_repeat)
    # words before a prefix in two levels, so that no window holds all prefixes of a source
    top = F.substring("__weft_p", 1, digits // 2)
    tops = sums.groupBy("__weft_s", top.alias("__top")).agg(F.sum("words").alias("words"))
    rows_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__weft_s", "__top", F.coalesce(F.sum("words").over(rows_before(Window.partitionBy("__weft_s").orderBy("__top"))), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum("words").over(rows_before(Window.partitionBy("__weft_s", "__top").orderBy("__weft_p"))), F.lit(0))
    starts = sums.withColumn("__top", top).withColumn("within", within).join(tops, ["__weft_s", "__top"])
    starts = starts.join(known.withColumn("__weft_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source"), "__weft_s")
    starts = starts.select("__weft_s", "__weft_p", F.struct((F.col("above") + F.col("within")).alias("start"), "source_size", "rank", "target").alias("__start"))
    joined = keyed.join(starts, ["__weft_s", "__weft_p"])
    inside = rows_before(Window.partitionBy("__weft_s", "__weft_p").orderBy("__weft.h"))
    offset = F.col("__start.start") + F.coalesce(F.sum("__weft.size").over(inside), F.lit(0))
    joined = joined.withColumn("__off", offset)
    size, whole, target = F.col("__weft.size"), F.col("__start.source_size"), F.col("__start.target")
    at = [F.col("__off") + whole * c for c in range(max_repeat)]
    took = [F.greatest(F.lit(0), F.least(size, F.floor(target) - a)) for a in at]
    position = [F.when(t > 0, F.round(_position(F.coalesce(F.try_divide(a, target), F.lit(0.0)), F.col("__start.rank"), schedules), 9)) for a, t in zip(at, took)]
    mix = F.struct(size.alias("size"), whole.alias("source_size"), target.alias("target"), sum(took[1:], took[0]).cast("long").alias("taken"), F.array_compact(F.array(*position)).alias("positions"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], mix.alias(out))


def curriculum(planned: DataFrame, mix: str = "mix") -> DataFrame:
    """One row for each copy taken, with its `position`, range-sorted by it; the columns of docs stay (but one named position is replaced), mix goes."""
    copies = planned.withColumn("position", F.explode(F.col(mix)["positions"])).drop(mix)
    return copies.repartitionByRange("position").sortWithinPartitions("position")


def plan_sql(weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_repeat: int = 2) -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT source, CAST(ss AS BIGINT) AS ss, rk, {list(weights)}[rk % {len(weights)} + 1] AS w, (SELECT sum(ss) FROM s) * CAST({budget} AS DOUBLE) AS total FROM s),
l AS (SELECT *, {max_repeat} * ss AS cap, {max_repeat} * ss / CAST(w AS DOUBLE) AS lev FROM w),
c AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY lev, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY lev, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= lev AS capped FROM l),
t AS (SELECT source, ss, CASE WHEN capped THEN CAST(cap AS DOUBLE)
        ELSE w * (total - (SELECT coalesce(sum(cap), 0) FROM c WHERE capped)) / (SELECT sum(w) FROM c WHERE NOT capped) END AS target FROM c),
o AS (SELECT d.doc_id, d.size, t.ss, t.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target,
  CAST({' + '.join(f'greatest(0, least(size, floor(target) - off - {c} * ss))' for c in range(max_repeat))} AS BIGINT) AS taken
FROM o
"""
