"""Example tables derived from the star-schema tables: thresholds and low bits as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.session import table


def _bit(condition):
    return F.coalesce(condition, F.lit(False)).cast("int")


def events(spark: SparkSession, sf: str) -> DataFrame:
    kind, value, user, event = F.col("event_type"), F.col("value"), F.col("user_id"), F.col("event_id")
    return table(spark, sf, "events").select(
        event.alias("id"), _bit(value >= 50).alias("x0"), _bit(kind.isin("purchase", "signup")).alias("x1"), (user % 2).cast("int").alias("x2"),
        _bit((kind == "purchase") & (value >= 50)).alias("y0"), _bit(kind == "error").alias("y1"), ((user + event) % 2).cast("int").alias("y2"),
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    low = [F.shiftright("o_custkey", i).bitwiseAND(F.lit(1)).cast("int").alias(f"x{i}") for i in range(4)]
    made = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), *low, _bit(F.col("o_orderstatus") == "F").alias("x4"), _bit(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("x5"), _bit(F.col("o_totalprice") >= 250000).alias("y0")
    )
    x0, x4, x5 = F.col("x0"), F.col("x4"), F.col("x5")
    return made.select("*", x0.bitwiseXOR(x4).alias("y1"), x4.bitwiseAND(x5).alias("y2"), _bit(x0 + F.col("x1") + x5 >= 2).alias("y3"))


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """No key: only for metrics that don't depend on the order of examples."""
    return table(spark, sf, "lineitem").select(_bit(F.col("l_quantity") > 25).alias("x0"), _bit(F.col("l_discount") >= 0.05).alias("x1"), _bit(F.col("l_returnflag") == "R").alias("y0"))
