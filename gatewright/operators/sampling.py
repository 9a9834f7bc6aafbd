"""Examples picked, split, bagged and made noisy, the same on every run and cluster.

Where chance is wanted, rows are ordered by ``md5`` of their id, a seed and a number, which
any engine reproduces. The k lowest of n are found without ordering anything in one place,
whatever k is: one scan counts the rows of all draws per prefix of the hash (a histogram of
2^bits rows a draw), the running sum names the bucket in which the k-th row lies and the rows
before each bucket, and only rows within a bucket are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance(id_: Column, seed: int | str, number: Column | int | str = 0) -> Column:
    """A text that orders rows at random, by id, seed and number."""
    number = number if isinstance(number, Column) else F.lit(str(number))
    return F.md5(F.concat_ws("-", id_.cast("string"), F.lit(str(seed)), number.cast("string")))


def gather(df: DataFrame, index: DataFrame, key: str = "id") -> DataFrame:
    """The rows listed in ``index`` (pos, key), once per listing."""
    return index.join(df, key)


def partition(df: DataFrame, index: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the listed rows, all the others)."""
    return gather(df, index, key), df.join(index.select(key), key, "left_anti")


def sample(df: DataFrame, index: DataFrame, *, invert: bool = False, key: str = "id") -> DataFrame:
    return partition(df, index, key)[1 if invert else 0]


#: Bits of the hash that a bucket stands for; more of them make buckets smaller and the histogram larger.
BUCKET_BITS = 16


def _buckets(df: DataFrame, numbers: Sequence[int | str], seed: int | str, key: str, bits: int) -> DataFrame:
    """(__gw_k, __gw_n, __gw_c, __gw_b): every row once per draw with its chance and the bucket of that."""
    draw = F.array(*(F.struct(F.lit(n).alias("n"), chance(F.col(key), seed, n).alias("c")) for n in numbers))
    rows = df.select(F.col(key).alias("__gw_k"), F.explode(draw).alias("d")).select("__gw_k", F.col("d.n").alias("__gw_n"), F.col("d.c").alias("__gw_c"))
    return rows.withColumn("__gw_b", F.shiftright(F.conv(F.substring("__gw_c", 1, 8), 16, 10).cast("bigint"), 32 - bits))


def _starts(bucketed: DataFrame) -> DataFrame:
    """(__gw_n, __gw_b, __gw_start, __gw_size): the rows before each bucket and in it; a draw has 2^bits rows here at most."""
    sizes = bucketed.groupBy("__gw_n", "__gw_b").agg(F.count(F.lit(1)).alias("__gw_size"))
    before = F.sum("__gw_size").over(Window.partitionBy("__gw_n").orderBy("__gw_b").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("__gw_start", F.coalesce(before, F.lit(0)))


def _lowest(df: DataFrame, numbers: Sequence[int | str], size: int, seed: int | str, key: str, bits: int) -> DataFrame:
    """(__gw_k, __gw_n, __gw_c, __gw_b, __gw_start): the rows of the buckets that hold the ``size`` lowest of each draw."""
    bucketed = _buckets(df, numbers, seed, key, bits)
    return bucketed.join(_starts(bucketed).where(F.col("__gw_start") < size).drop("__gw_size"), ["__gw_n", "__gw_b"])


def sample_index(df: DataFrame, n_samples: int, size: int, seed: int | str, key: str = "id", *, bits: int = BUCKET_BITS) -> DataFrame:
    """(sample, pos, key): independent samples of ``size`` rows each, without replacement."""
    near = _lowest(df, range(n_samples), size, seed, key, bits)
    inside = F.row_number().over(Window.partitionBy("__gw_n", "__gw_b").orderBy("__gw_c", "__gw_k")) - 1
    placed = near.select(F.col("__gw_n").alias("sample"), (F.col("__gw_start") + inside).alias("pos"), F.col("__gw_k").alias(key))
    return placed.where(F.col("pos") < size)


def train_test_index(df: DataFrame, n_samples: int, train: int, test: int, seed: int | str, key: str = "id") -> DataFrame:
    """(sample, pos, key, part): train and test drawn together, so they share no row."""
    both = sample_index(df, n_samples, train + test, seed, key)
    return both.withColumn("part", F.when(F.col("pos") < train, "train").otherwise("test"))


def bag_index(df: DataFrame, n_rows: int, seed: int | str, key: str = "id", *, bits: int = BUCKET_BITS) -> DataFrame:
    """(pos, key): ``n_rows`` draws with replacement from the ``n_rows`` rows of ``df``, whatever their keys.

    Rows are numbered 0.. by key within buckets of a hash of it; keys that are 0..n_rows-1 already are
    their own numbers.
    """
    draw = F.pmod(F.conv(F.substring(chance(F.col("id"), seed, "bag"), 1, 15), 16, 10).cast("bigint"), F.lit(max(n_rows, 1)))
    drawn = df.sparkSession.range(n_rows).select(F.col("id").alias("pos"), draw.alias("__gw_place"))
    span = df.agg(F.count(F.lit(1)), F.count_distinct(key), F.min(key), F.max(key)).first()
    if span[0] and (span[1], span[2], span[3]) == (n_rows, 0, n_rows - 1):
        return drawn.withColumnRenamed("__gw_place", key)
    if span[1] != n_rows or span[0] != n_rows:
        raise ValueError(f"a bag of {n_rows} draws needs as many rows with different keys, not {span[0]} rows with {span[1]}")
    bucketed = _buckets(df, ["places"], seed, key, bits)
    inside = F.row_number().over(Window.partitionBy("__gw_n", "__gw_b").orderBy("__gw_c", "__gw_k")) - 1
    places = bucketed.join(_starts(bucketed), ["__gw_n", "__gw_b"]).select((F.col("__gw_start") + inside).alias("__gw_place"), F.col("__gw_k").alias(key))
    return drawn.join(places, "__gw_place").select("pos", key)


def flips(n: int, rate: float) -> int:
    """Targets to flip per column: n times rate, halves to even."""
    return round(n * rate)


def noisy(df: DataFrame, targets: Sequence[str], n_rows: int, rate: float, seed: int | str, key: str = "id", *, bits: int = BUCKET_BITS) -> DataFrame:
    """``df`` with exactly ``flips`` random flips in each target column, columns independent.

    Rows in buckets below the one in which the last flip lies are flipped where they are, by a
    bound on their hash; only that bucket's rows are ordered, for the hash of the last flip.
    """
    k = flips(n_rows, rate)
    if k == 0:
        return df
    near = _lowest(df, list(targets), k, seed, key, bits)
    # the bucket of the k-th row of each target
    edge = near.groupBy("__gw_n").agg(F.max("__gw_b").alias("__gw_e")).withColumnRenamed("__gw_n", "__gw_t")
    last = near.join(edge, (F.col("__gw_n") == F.col("__gw_t")) & (F.col("__gw_b") == F.col("__gw_e")), "left_semi")
    place = F.row_number().over(Window.partitionBy("__gw_n").orderBy("__gw_c", "__gw_k")) + F.col("__gw_start")
    bound = last.withColumn("__gw_place", place).where(F.col("__gw_place") == k).groupBy("__gw_n").agg(F.max(F.struct("__gw_c", "__gw_k")).alias("__gw_last"))
    # one row per target: what is flipped lies at or below its bound
    bounds = {r["__gw_n"]: r["__gw_last"] for r in bound.collect()}

    def flipped(t: str) -> Column:
        c, at = chance(F.col(key), seed, t), bounds.get(t)
        if at is None:  # fewer than k rows: all of them
            return 1 - F.col(t)
        hit = (c < at["__gw_c"]) | ((c == at["__gw_c"]) & (F.col(key) <= at["__gw_k"]))
        return F.when(hit, 1 - F.col(t)).otherwise(F.col(t))

    return df.withColumns({t: flipped(t) for t in targets})


def effective_rate(n_rows: int, rate: float) -> float:
    return flips(n_rows, rate) / n_rows if n_rows else 0.0
