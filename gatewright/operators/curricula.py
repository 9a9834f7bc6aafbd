"""Orders in which to learn the outputs of an example table, from the table's own statistics.

Entropies, effects and feature sets only depend on how often each pattern of signals
occurs, so the examples are first counted per pattern (with map-side combination); there
are at most 2^(signals used) patterns, however many examples there are. What follows works
on counts, or on matrices of outputs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Feature sets are searched exactly among subsets of at most so many features.
MAX_EXACT = 12
_ENTROPY_DIGITS = 12


def pattern_counts(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """(signals, n): how often each pattern occurs."""
    return df.groupBy(*signals).agg(F.count(F.lit(1)).alias("n"))


def label_pairs(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(i, j, a, b, n): how often outputs i and j are a and b together, for all ordered pairs."""
    counts = pattern_counts(df, targets)
    pair = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(s).alias("a"), F.col(t).alias("b")) for i, s in enumerate(targets) for j, t in enumerate(targets)]
    return counts.select(F.explode(F.array(*pair)).alias("p"), "n").groupBy("p.i", "p.j", "p.a", "p.b").agg(F.sum("n").alias("n"))


def conditional_entropy(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(i, j, h): H(output i | output j) in bits, from the observed frequencies."""
    pairs = label_pairs(df, targets)
    given = pairs.groupBy("i", "j", "b").agg(F.sum("n").cast("double").alias("nb"), F.collect_list(F.col("n").cast("double")).alias("ns"))
    part = F.aggregate("ns", F.lit(0.0), lambda acc, n: acc - n * F.log2(n / F.col("nb")))
    per = given.select("i", "j", part.alias("s"), "nb").groupBy("i", "j").agg((F.sum("s") / F.sum("nb")).alias("h"))
    return per.select("i", "j", F.abs("h").alias("h"))


def effect_relation(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(i, j, e): how much output j's mean differs between output i = 0 and 1, columns scaled to sum 1."""
    means = label_pairs(df, targets).groupBy("i", "j").agg(
        *((F.sum(F.when((F.col("a") == a) & (F.col("b") == 1), F.col("n")).otherwise(0)) / F.sum(F.when(F.col("a") == a, F.col("n")))).alias(f"m{a}") for a in (0, 1))
    )
    # a constant output has no mean for one of its values
    raw = means.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.coalesce(F.abs(F.col("m0") - F.col("m1")), F.lit(0.0))).alias("e"))
    total = raw.groupBy(F.col("j").alias("tj")).agg(F.sum("e").alias("total"))
    scaled = raw.join(total, raw["j"] == total["tj"])
    return scaled.select("i", "j", F.when(F.col("total") == 0, F.col("e")).otherwise(F.col("e") / F.col("total")).alias("e"))


def matrix(df: DataFrame, value: str, n: int) -> np.ndarray:
    """A matrix of outputs by outputs on the driver; n is a number of columns, not of rows."""
    out = np.zeros((n, n))
    for row in df.collect():
        out[row["i"], row["j"]] = row[value]
    return out


def label_effect_scores(effects: DataFrame, steps: int) -> DataFrame:
    """(i, v): row sums of the effect matrix to the power ``steps``, by repeated joins."""
    v = effects.groupBy("i").agg(F.sum("e").alias("v"))
    for _ in range(steps - 1):
        right = v.select(F.col("i").alias("k"), F.col("v").alias("w"))
        v = effects.join(right, effects["j"] == right["k"]).groupBy("i").agg(F.sum(F.col("e") * F.col("w")).alias("v"))
    return v


def label_effect_rank(df: DataFrame, targets: Sequence[str], steps: int, digits: int = _ENTROPY_DIGITS) -> DataFrame:
    """(i, v, rank): outputs by falling score; equal scores (to ``digits``) share the lower rank."""
    scored = label_effect_scores(effect_relation(df, targets), steps).withColumn("v", F.round("v", digits))
    # one row per output
    return scored.withColumn("rank", F.rank().over(Window.orderBy(F.col("v").desc())) - 1)


def entropy_order(h: np.ndarray, variant: int = 1, rng: np.random.Generator | None = None) -> list[int]:
    """An order from a conditional entropy matrix.

    Variants 1 and 2 sum over rows, 3 and 4 over columns; 1 and 3 pick the least sum, 2 and
    4 the greatest; 1 and 4 fill the order from its end. Ties go to the lowest output, or
    to one by chance with ``rng``.
    """
    if variant not in (1, 2, 3, 4):
        raise ValueError("variants are 1 to 4")
    left, order = list(range(len(h))), []
    while left:
        sums = np.round(h[np.ix_(left, left)].sum(axis=1 if variant < 3 else 0), _ENTROPY_DIGITS)
        best = np.flatnonzero(sums == (sums.min() if variant in (1, 3) else sums.max()))
        order.append(left.pop(int(best[0] if rng is None else rng.choice(best))))
    return order[::-1] if variant in (1, 4) else order


def order_from_rank(rank: Sequence[int], rng: np.random.Generator | None = None) -> list[int]:
    """Outputs by rank; ties by number, or shuffled with ``rng``."""
    tie = range(len(rank)) if rng is None else rng.permutation(len(rank))
    return [i for _, _, i in sorted(zip(rank, tie, range(len(rank)), strict=True))]


def _code(columns: Sequence[str]) -> Column:
    code = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        code = code.bitwiseOR(F.shiftleft(F.col(c).cast("bigint"), i))
    return code


def feasible_masks(df: DataFrame, features: Sequence[str], target: str, size: int) -> DataFrame:
    """(mask): the feature subsets of ``size`` under which no two examples agree but differ in the target."""
    patterns = df.select(_code(features).alias("code"), F.col(target).alias("y")).distinct()
    # the subsets are laid out beside each pattern by explode, and one aggregation combines them
    masks = [sum(1 << i for i in s) for s in combinations(range(len(features)), size)]
    seen = patterns.select("y", "code", F.explode(F.array(*(F.lit(m).cast("bigint") for m in masks))).alias("mask")).groupBy("mask", F.col("code").bitwiseAND(F.col("mask")).alias("part")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return seen.groupBy("mask").agg(F.max(F.col("hi") - F.col("lo")).alias("clash")).where("clash = 0").select("mask")


def min_feature_set(df: DataFrame, features: Sequence[str], target: str) -> list[int] | None:
    """The lowest-numbered smallest feature set that tells examples of different targets apart; None if none does."""
    if len(features) > MAX_EXACT:
        raise ValueError(f"exact search takes at most {MAX_EXACT} features; use greedy_feature_set")
    patterns = df.select(*features, target).distinct().persist()
    try:
        for size in range(len(features) + 1):
            found = feasible_masks(patterns, features, target, size)
            sets = sorted([i for i in range(len(features)) if m >> i & 1] for (m,) in found.collect())
            if sets:
                return sets[0]
        return None
    finally:
        patterns.unpersist()


def feature_set_ranks(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> tuple[list[int], list[list[int] | None]]:
    """(rank per target by the size of its smallest feature set, the feature sets)."""
    sets = [min_feature_set(df, features, t) for t in targets]
    sizes = [len(features) + 1 if s is None else len(s) for s in sets]
    return [sum(o < s for o in sizes) for s in sizes], sets


def greedy_cover(x: np.ndarray, y: np.ndarray) -> list[int]:
    """A feature set found greedily on distinct patterns in memory: split the mixed groups best, one feature at a time."""
    chosen: list[int] = []
    group = np.zeros(len(x), dtype=np.int64)
    while True:
        def pairs(g: np.ndarray) -> int:
            """Pairs of examples in one group with different targets."""
            _, at = np.unique(g, return_inverse=True)
            ones = np.bincount(at, weights=y)
            return int((ones * (np.bincount(at) - ones)).sum())

        if (now := pairs(group)) == 0:
            return sorted(chosen)
        left = [(pairs(group * 2 + x[:, f]), f) for f in range(x.shape[1]) if f not in chosen]
        if not left or min(left)[0] >= now:
            return sorted(chosen)
        chosen.append(min(left)[1])
        _, group = np.unique(group * 2 + x[:, chosen[-1]], return_inverse=True)


def greedy_feature_set(df: DataFrame, features: Sequence[str], target: str) -> list[int]:
    """Greedy feature selection by aggregation: each round takes the feature that leaves the fewest clashing pairs.

    Clashing pairs are counted from group sizes (ones times zeros per group), never formed.
    """
    counts = df.groupBy(*features, target).agg(F.count(F.lit(1)).alias("n")).persist()
    chosen: list[int] = []
    try:
        now = _clashes(counts.withColumns({"f": F.lit(-1), "v": F.lit(0)}), [], target).get(-1, 0)
        while now and len(chosen) < len(features):
            kept = [features[i] for i in chosen]
            tried = F.array(*(F.struct(F.lit(i).alias("f"), F.col(features[i]).alias("v")) for i in range(len(features)) if i not in chosen))
            # all features are tried in one aggregation
            left = _clashes(counts.select(*kept, target, "n", F.inline(tried)), kept, target)
            best = min(left, key=lambda f: (left[f], f))
            if left[best] >= now:
                break
            chosen.append(best)
            now = left[best]
        return sorted(chosen)
    finally:
        counts.unpersist()


def _clashes(counts: DataFrame, kept: Sequence[str], target: str) -> dict[int, float]:
    """Clashing pairs that remain with the kept features and feature f, whose value is v."""
    per = counts.groupBy("f", "v", *kept).agg(F.sum(F.when(F.col(target) == 1, F.col("n")).otherwise(0)).cast("double").alias("ones"), F.sum("n").cast("double").alias("all"))
    return dict(per.groupBy("f").agg(F.sum(F.col("ones") * (F.col("all") - F.col("ones")))).collect())


def repeated_patterns(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Input patterns that occur more than once, with their number."""
    return pattern_counts(df, inputs).where("n > 1")
