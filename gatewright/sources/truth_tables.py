"""Example tables made from operators: every example number, those listed, or those not listed.

An example table has a unique ``id``, inputs x0.. and outputs y0.. in {0, 1}, lowest bit
first. Everything is ``range`` and bit arithmetic, so tables of any width are made in
parallel, and excluding numbers is an anti join; no complement is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.functions import operands


def bits(value: Column, n: int, prefix: str) -> list[Column]:
    return [F.shiftright(value, i).bitwiseAND(F.lit(1)).cast("int").alias(f"{prefix}{i}") for i in range(n)]


def index_table(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    """(pos, id) of a list of example numbers, in the given order."""
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "pos bigint, id bigint")


def examples(numbers: DataFrame, operator: str, nb: int, no: int | None = None, order: Sequence[int] | None = None) -> DataFrame:
    """The examples of a table of numbers (``id``; other columns stay).

    Only the low ``no`` bits of the result are kept; ``order`` then picks and orders outputs.
    """
    ni, no = operands.input_width(operator, nb), operands.default_outputs(operator, nb) if no is None else no
    value = operands.expression(operator, nb, F.col("id"))
    picked = range(no) if order is None else order
    if any(not 0 <= o < no for o in picked):
        raise ValueError(f"outputs have to be in 0..{no - 1}")
    y = [F.shiftright(value, o).bitwiseAND(F.lit(1)).cast("int").alias(f"y{i}") for i, o in enumerate(picked)]
    return numbers.select("*", *bits(F.col("id"), ni, "x"), *y)


def truth_table(spark: SparkSession, operator: str, nb: int, no: int | None = None, order: Sequence[int] | None = None) -> DataFrame:
    """All 2^ni examples."""
    return examples(spark.range(1 << operands.input_width(operator, nb)), operator, nb, no, order)


def _listed(index: DataFrame, operator: str, nb: int) -> Column:
    """``id``, failing at run time on a number outside the operator's domain."""
    limit = 1 << operands.input_width(operator, nb)
    inside = (F.col("id") >= 0) & (F.col("id") < limit)
    return F.when(inside, F.col("id")).otherwise(F.raise_error(F.format_string(f"example %s is not in 0..{limit - 1}", F.col("id"))).cast("bigint"))


def included(index: DataFrame, operator: str, nb: int, no: int | None = None, order: Sequence[int] | None = None) -> DataFrame:
    """The listed examples (``pos``, ``id``), in the given order and as often as they are listed; unknown numbers fail."""
    return examples(index.withColumn("id", _listed(index, operator, nb)), operator, nb, no, order)


def excluded(spark: SparkSession, index: DataFrame, operator: str, nb: int, no: int | None = None, order: Sequence[int] | None = None) -> DataFrame:
    """All examples but the listed ones, ascending; unknown numbers fail, as does a list longer than the domain."""
    n = 1 << operands.input_width(operator, nb)
    too_long = F.raise_error(F.lit(f"more than {n} examples are listed; there are no more")).cast("boolean")
    fits = F.when(index.agg(F.count(F.lit(1))).scalar() > n, too_long).otherwise(True)
    numbers = spark.range(n).where(fits).join(index.select(_listed(index, operator, nb).alias("id")), "id", "left_anti")
    return examples(numbers, operator, nb, no, order)


def iterate(spark: SparkSession, index: DataFrame, operator: str, nb: int, *, exclude: bool = False, **kwargs) -> DataFrame:
    """The listed or the other examples, by ``exclude``."""
    return excluded(spark, index, operator, nb, **kwargs) if exclude else included(index, operator, nb, **kwargs)
