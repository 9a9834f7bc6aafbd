"""Exact and bounded-error percentiles per group by bisection over counts.

``summarise`` counts a day's (or a file group's) values per group in value cells of equal
relative width; a cell keeps count, minimum and maximum. Summaries are added by ``merge``,
in any order and grouping, and ``bounds`` reads percentiles from them: the true value lies
between the returned ``lo`` and ``hi``, which differ by at most the relative ``width``.

``percentiles`` narrows these intervals to exact values. Every pass splits the interval of
each unresolved (group, percentile) at equally spaced midpoints, counts the rows below
them, and keeps the part that holds the target rank, shrunk to the least and greatest value
in it. An interval is resolved when both are the same. The two ends of an interval always
fall into different parts, so every pass makes progress, and passes go on until all are
resolved; from an interval of the default width it takes at most 53 / log2(PARTS) of them.

Values are first combined to (group, value, count), so neither a group that holds a third
of all rows nor a value that does gathers in one task; passes read only the value cells
that still hold an unresolved rank.

The percentile is the lowest value with at least ``ceil(p n)`` of the n values not above
it; p is given in 10 000ths, so the rank is exact.

Defined results: values that are null, NaN or below 0 do not count; infinity does; a whole
row that stands twice counts once (``unique_rows``); a null group column is a group; a
group without values gives no row; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.session import checkpoint

WIDTH, PARTS = 0.01, 32
_LOW, _HIGH = -(2**31), 2**31 - 1


def unique_rows(rows: DataFrame) -> DataFrame:
    """Whole rows, each once."""
    return rows.distinct()


def _values(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The groups and the values that count, as ``__gw_v``; -0.0 is 0."""
    v = F.col(f"`{value}`").cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v) & (v >= 0)).select(*(F.col(f"`{g}`") for g in groups), F.when(v == 0, F.lit(0.0)).otherwise(v).alias("__gw_v"))


def _cell(v: Column, width: float) -> Column:
    """A number that never falls as v rises; values of a cell differ by at most the relative width."""
    log = F.floor(F.log(v) / F.lit(math.log1p(width)))
    return F.when(v == 0, F.lit(_LOW)).when(v == F.lit(float("inf")), F.lit(_HIGH)).otherwise(log).cast("int")


def summarise(rows: DataFrame, groups: Sequence[str], value: str, *, width: float = WIDTH) -> DataFrame:
    """(groups, cell, n, lo, hi): a summary that ``merge`` can add to others of the same width."""
    return _values(rows, groups, value).groupBy(*groups, _cell(F.col("__gw_v"), width).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("__gw_v").alias("lo"), F.max("__gw_v").alias("hi"))


def merge(summaries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Summaries put together; ``groups`` may be fewer columns than the summaries had (days added up)."""
    return summaries.groupBy(*groups, "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def bounds(summary: DataFrame, groups: Sequence[str], tenthousandths: Sequence[int]) -> DataFrame:
    """(groups, p, rank, n, cell, below, lo, hi) with the true percentile in [lo, hi].

    A group has one row per value cell here: under 150 000 for any doubles at width 0.01.
    """
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = summary.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(upto)})
    asked = cells.withColumn("p", F.explode(F.array(*(F.lit(p) for p in tenthousandths))))
    # ceil(p n), at least the first
    rank = F.greatest(F.lit(1).cast("bigint"), F.expr("(total * p + 9999) div 10000"))
    ranked = asked.withColumn("rank", rank).withColumn("below", F.col("upto") - F.col("n"))
    return ranked.where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("upto"))).select(*groups, "p", "rank", F.col("total").alias("n"), "cell", "below", "lo", "hi")


def percentiles(rows: DataFrame, groups: Sequence[str], value: str, tenthousandths: Sequence[int], *, width: float = WIDTH, parts: int = PARTS, summary: DataFrame | None = None) -> DataFrame:
    """(groups, p, n, value), exact. ``summary``: one already made of the same rows, at the same width."""
    groups = list(groups)
    counted = _values(rows, groups, value).groupBy(*groups, "__gw_v").agg(F.count(F.lit(1)).alias("__gw_c")).withColumn("__gw_cell", _cell(F.col("__gw_v"), width))
    counted = checkpoint(counted)
    if summary is None:
        summary = counted.groupBy(*groups, F.col("__gw_cell").alias("cell")).agg(F.sum("__gw_c").alias("n"), F.min("__gw_v").alias("lo"), F.max("__gw_v").alias("hi"))
    state = checkpoint(bounds(summary, groups, tenthousandths))
    done = state.where("lo = hi")
    open_ = state.where("lo < hi")
    # every pass parts the two ends of each interval, so this ends, whatever the width was
    while not open_.isEmpty():
        state = checkpoint(_pass(counted, open_, groups, parts))
        done = done.unionByName(state.where("lo = hi"))
        open_ = state.where("lo < hi")
    return done.select(*groups, "p", "n", F.col("lo").alias("value"))


def _pass(counted: DataFrame, open_: DataFrame, groups: list[str], parts: int) -> DataFrame:
    """The intervals after one more round of counting below their midpoints."""
    o = open_.select(*(F.col(f"`{g}`").alias(f"__o{i}") for i, g in enumerate(groups)), "p", "rank", "n", "cell", "below", "lo", "hi")
    same = [F.col(f"`{g}`").eqNullSafe(F.col(f"__o{i}")) for i, g in enumerate(groups)]
    held = counted.join(o, [*same, F.col("__gw_cell") == F.col("cell")]).where((F.col("__gw_v") >= F.col("lo")) & (F.col("__gw_v") <= F.col("hi")))
    # over a wide range equal steps of the logarithm narrow faster; the ends fall into the first and the last part
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("__gw_v")
    wide = (lo > 0) & (hi / lo > 2)
    step = F.when(wide, (F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo))).otherwise((v - lo) / (hi - lo))
    part = F.when(v == hi, F.lit(parts - 1)).otherwise(F.least(F.floor(step * parts), F.lit(parts - 1))).cast("bigint")
    split = held.groupBy(*groups, "p", "rank", "n", "cell", "below", part.alias("part")).agg(F.sum("__gw_c").alias("c"), F.min("__gw_v").alias("lo"), F.max("__gw_v").alias("hi"))
    # at most ``parts`` rows per interval
    upto = F.sum("c").over(Window.partitionBy(*groups, "p").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    placed = split.withColumn("upto", F.col("below") + upto)
    inside = placed.where((F.col("rank") > F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("upto")))
    return inside.select(*groups, "p", "rank", "n", "cell", (F.col("upto") - F.col("c")).alias("below"), "lo", "hi")
