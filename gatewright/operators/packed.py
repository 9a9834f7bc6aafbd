"""Bit-sliced tables: 64 examples per row, one bigint word per signal.

Bit i of word b is the example at position 64 b + i. Positions are unique; they need not be
dense, as the word ``valid`` has a 1 for each position that is there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(bit: Column | int, place: Column) -> Column:
    return F.call_function("shiftleft", (bit if isinstance(bit, Column) else F.lit(bit)).cast("bigint"), place)


def pack(df: DataFrame, signals: Sequence[str], position: str = "id") -> DataFrame:
    """(blk, n_valid, valid, signal words). Partial words are combined before the shuffle."""
    place = F.pmod(F.col(position), F.lit(64)).cast("int")
    words = [F.bit_or(_at(F.col(s), place)).alias(s) for s in signals]
    return df.groupBy(F.floor(F.col(position) / 64).alias("blk")).agg(F.count(F.lit(1)).cast("int").alias("n_valid"), F.bit_or(_at(1, place)).alias("valid"), *words)


def unpack(packed: DataFrame, signals: Sequence[str], position: str = "id") -> DataFrame:
    """The rows of a packed table."""
    rows = packed.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("valid", i) == 1)).alias("__gw_i"))
    return rows.select((F.col("blk") * 64 + F.col("__gw_i")).alias(position), *(F.getbit(F.col(s), F.col("__gw_i")).cast("int").alias(s) for s in signals))


def popcounts(packed: DataFrame, signals: Sequence[str]) -> DataFrame:
    """One row: the ones of every signal; bits that gates may have set where there is no example don't count."""
    return packed.agg(*(F.sum(F.bit_count(F.col(s).bitwiseAND(F.col("valid"))).cast("bigint")).alias(s) for s in signals))


def floodcounts(packed: DataFrame, signals: Sequence[str]) -> DataFrame:
    """One row: per signal the examples from its first one to the last example, 0 if it has none.

    The first block with a one is found by one aggregation, the examples before it by another;
    nothing is ordered.
    """
    word = lambda s: F.col(s).bitwiseAND(F.col("valid"))
    first = packed.agg(F.struct(*(F.min(F.when(word(s) != 0, F.col("blk"))).alias(s) for s in signals))).scalar()
    # in that block, the valid bits from the lowest one of the signal up
    from_here = lambda s: F.col("valid").bitwiseAND(F.bitwise_not((word(s).bitwiseAND(-word(s))) - 1))
    n = lambda s: F.when(F.col("blk") > first[s], F.col("n_valid")).when(F.col("blk") == first[s], F.bit_count(from_here(s)))
    return packed.agg(*(F.coalesce(F.sum(n(s).cast("bigint")), F.lit(0)).alias(s) for s in signals))
