"""Ordered look-back and running sums that never order a whole group in one task.

A group is cut into blocks of consecutive order values. Windows run within blocks; what
crosses a block's edge is worked out over one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous(df: DataFrame, group: str, order: str, carry: list[str], *, tie: str, block: int = 10_000) -> DataFrame:
    """``df`` with ``prev_<c>`` for each c in ``carry``: the values of the row before it in its group.

    ``order`` is a whole number; ties go by ``tie``. Blocks span ``block`` order values.
    """
    b = df.withColumn("__gw_b", F.floor(F.col(order) / F.lit(block)))
    # order and tie first: the struct of a block's last row is then its greatest
    row = F.struct(F.col(order).alias("__gw_o"), F.col(tie).alias("__gw_t"), *(F.col(c).alias(c) for c in carry))
    inside = Window.partitionBy(group, "__gw_b").orderBy(order, tie)
    b = b.withColumn("__gw_prev", F.lag(row).over(inside))
    ends = df.groupBy(group, F.floor(F.col(order) / F.lit(block)).alias("__gw_b")).agg(F.max(row).alias("__gw_end"))
    ends = ends.withColumn("__gw_before", F.lag("__gw_end").over(Window.partitionBy(group).orderBy("__gw_b"))).select(F.col(group).alias("__gw_g"), F.col("__gw_b").alias("__gw_b2"), "__gw_before")
    joined = b.join(ends, (b[group] == ends["__gw_g"]) & (b["__gw_b"] == ends["__gw_b2"]), "left")
    before = F.coalesce("__gw_prev", "__gw_before")
    return joined.withColumns({f"prev_{c}": before[c] for c in carry}).drop("__gw_b", "__gw_b2", "__gw_g", "__gw_prev", "__gw_before")


def running_before(df: DataFrame, group: list[str], block: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before it in its group, in the order (block, *order).

    ``block`` is a column that is not decreasing in the wanted order and holds few rows per value.
    """
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("__gw_sum"))
    starts = sums.withColumn("__gw_start", F.coalesce(F.sum("__gw_sum").over(Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("__gw_inside", inside)
    return rows.join(starts.drop("__gw_sum"), [*group, block], "left").withColumn(out, F.col("__gw_start") + F.col("__gw_inside")).drop("__gw_start", "__gw_inside")
