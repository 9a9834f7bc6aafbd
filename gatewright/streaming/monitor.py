"""A network watched on a stream of examples, and results watched as tasks finish.

Both are windowed aggregations with watermarks: late rows are counted as long as their
window is open, state is one row per open window (and learner), and files may be read
again after a failure without being counted twice if the sink is idempotent per window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.model.network import Network
from gatewright.operators import evaluate, metrics


def network_quality(examples: DataFrame, network: Network, *, at: str, window: str = "1 hour", late: str = "10 minutes", inputs: Sequence[str] | None = None, targets: Sequence[str] | None = None) -> DataFrame:
    """(start, ne, err, cor, mcc) per window of a stream (or table) of examples with a time column."""
    errors = evaluate.errors(examples, network, inputs=inputs, targets=targets, keep=[at])
    timed = errors.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if examples.isStreaming else timed
    spans = timed.withColumn("__gw_w", F.window(at, window))
    kept = metrics.profile(spans, network.no, by=["__gw_w"])
    return kept.select(F.col("__gw_w.start").alias("start"), "ne", *(metrics.value(f, network.no).alias(n) for n, f in (("err", "e1"), ("cor", "correctness"), ("mcc", "macro_mcc"))))


def finished_tasks(results: DataFrame, *, at: str = "finished_at", window: str = "1 day", late: str = "14 days", key: str = "result_id") -> DataFrame:
    """(start, learner, n, mean_err) of result records as they come in, records that come twice counted once."""
    timed = results.withColumn(at, F.col(at).cast("timestamp")).withColumn("learner", F.lower("learner"))
    timed = timed.withWatermark(at, late).dropDuplicates([key, at]) if results.isStreaming else timed.dropDuplicates([key, at])
    kept = timed.groupBy(F.window(at, window).alias("w"), "learner").agg(F.count(F.lit(1)).alias("n"), F.avg("test_err").alias("mean_err"))
    return kept.select(F.col("w.start").alias("start"), "learner", "n", "mean_err")
