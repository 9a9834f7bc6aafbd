"""Exactly one copy of every message that was delivered at least once.

Identifiers are counted first, with map-side combination. An identifier that occurs once
needs no ordering, so its message passes directly; only the rows of repeated identifiers
are shuffled and ranked. An identifier with more than ``hot_rows`` copies (and more than one in
MAX_HOT of all repeated rows) is not ordered at all: its first copy is found by an aggregation
that combines before the shuffle, and its rows stay where they are, so no task ever holds one
identifier's copies.

Defined results
* Null and blank identifiers are no identifiers: such messages pass and are never copies.
* Ties in time are settled by the lower delivery key; a null time comes after every time.
* If a whole row stands twice, ``keep_one`` returns one of the two, and ``copies`` does not
  name it, because its key is the key of the row that stays.
* Empty input gives empty output. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\r\n"
HOT_ROWS = 200_000
#: At most so many identifiers are hot, so that their list can be sent to every task.
MAX_HOT = 50_000

_ID, _N, _RANK, _FIRST = "__gw_id", "__gw_n", "__gw_rank", "__gw_first"


def normal_id(column: Column) -> Column:
    """The identifier without white space at its ends and without letter case; null if nothing is left."""
    bare = F.lower(F.btrim(column.cast("string"), F.lit(WHITE)))
    return F.when(bare != "", bare)


def _all(new: DataFrame, stored: DataFrame | None) -> DataFrame:
    return new if stored is None else stored.unionByName(new, allowMissingColumns=True)


def _ranked(keyed: DataFrame, repeated: DataFrame, at_col: str, key_col: str, hot_rows: int, *, one: bool) -> DataFrame:
    """The rows of repeated identifiers with ``_RANK`` 1 for the copy that stays.

    Rows with the same identifier, time and key share a rank, or (``one``) only one of them has rank 1.
    """
    # fewer than MAX_HOT identifiers can have more than 1 / MAX_HOT of all rows each, which bounds the list
    limit = F.greatest(F.lit(hot_rows), F.ceil(repeated.agg(F.sum(_N)).scalar() / MAX_HOT))
    hot = F.broadcast(repeated.where(F.col(_N) > limit).select(_ID))
    few = repeated.where(F.col(_N) <= limit).select(_ID)
    at, key = F.col(f"`{at_col}`"), F.col(f"`{key_col}`")
    order = Window.partitionBy(_ID).orderBy(at.asc_nulls_last(), key.asc_nulls_last())
    cold = keyed.join(hot, _ID, "left_anti").join(few, _ID, "left_semi").withColumn(_RANK, (F.row_number() if one else F.rank()).over(order))
    # the first copy of a hot identifier by aggregation, combined before the shuffle; its rows are never ordered
    place = F.struct(at.isNull().alias("a"), at.alias("b"), key.isNull().alias("c"), key.alias("d"))
    many = keyed.join(hot, _ID, "left_semi")
    first = F.broadcast(many.groupBy(_ID).agg(F.min(place).alias(_FIRST)))
    placed = many.join(first, _ID).withColumn(_RANK, F.when(at.eqNullSafe(F.col(_FIRST)["b"]) & key.eqNullSafe(F.col(_FIRST)["d"]), 1).otherwise(2)).drop(_FIRST)
    if one:
        placed = placed.where(F.col(_RANK) == 1).dropDuplicates([_ID])
    return cold.unionByName(placed)


def _parts(new: DataFrame, stored: DataFrame | None, id_col: str, at_col: str, key_col: str, hot_rows: int, *, one: bool):
    keyed = _all(new, stored)
    keyed = keyed.withColumn(_ID, normal_id(keyed[f"`{id_col}`"]))
    named = keyed.where(F.col(_ID).isNotNull())
    repeated = named.groupBy(_ID).agg(F.count(F.lit(1)).alias(_N)).where(F.col(_N) > 1)
    return keyed, repeated, _ranked(named, repeated, at_col, key_col, hot_rows, one=one)


def copies(new: DataFrame, stored: DataFrame | None = None, *, id_col: str = "id", at_col: str = "received_at", key_col: str = "delivery_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of the copies to drop among all stored and new messages."""
    narrow = [id_col, at_col, key_col]
    pick = lambda df: df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(narrow)))
    _, _, ranked = _parts(pick(new), None if stored is None else pick(stored), id_col, at_col, key_col, hot_rows, one=False)
    return ranked.where(F.col(_RANK) > 1).select(F.col(f"`{key_col}`"))


def keep_one(new: DataFrame, stored: DataFrame | None = None, *, id_col: str = "id", at_col: str = "received_at", key_col: str = "delivery_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """All messages, one of each identifier: singles as they are, and the first of every repeated one."""
    keyed, repeated, ranked = _parts(new, stored, id_col, at_col, key_col, hot_rows, one=True)
    single = keyed.join(repeated.select(_ID), _ID, "left_anti").drop(_ID)
    return single.unionByName(ranked.where(F.col(_RANK) == 1).drop(_RANK, _ID))
