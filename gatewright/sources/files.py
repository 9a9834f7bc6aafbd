"""Example tables, index lists, tasks and results in files."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signals(df: DataFrame) -> tuple[list[str], list[str]]:
    """The input and output columns of an example table, by number."""
    named = lambda p: sorted((c for c in df.columns if c[:1] == p and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return named("x"), named("y")


def read_examples(spark: SparkSession, path: str, targets: Sequence[int] | None = None) -> DataFrame:
    """An example table in Parquet, with the given outputs in the given order."""
    return pick_targets(spark.read.parquet(path), targets)


def pick_targets(df: DataFrame, targets: Sequence[int] | None) -> DataFrame:
    x, y = signals(df)
    if targets is None:
        return df
    return df.select("id", *x, *(F.col(f"y{t}").alias(f"y{i}") for i, t in enumerate(targets)))


def read_split(spark: SparkSession, training: str, test: str, targets: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test tables from separate files; they have to have the same signals."""
    a, b = read_examples(spark, training), read_examples(spark, test)
    if signals(a) != signals(b):
        raise ValueError(f"the files have different signals: {signals(a)}, {signals(b)}")
    return pick_targets(a, targets), pick_targets(b, targets)


def from_arrays(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> DataFrame:
    """An example table from 0/1 arrays, examples by signals."""
    import pandas as pd

    frame = pd.DataFrame({"id": np.arange(len(x), dtype=np.int64)} | {f"x{i}": x[:, i].astype(np.int32) for i in range(x.shape[1])} | {f"y{i}": y[:, i].astype(np.int32) for i in range(y.shape[1])})
    return spark.createDataFrame(frame)


def npz_arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(x, y), signals by examples, of a packed array file: ``matrix`` (signals by words, lowest bit first), ``Ne`` examples, ``Ni`` inputs."""
    with np.load(path, allow_pickle=False) as held:
        matrix, ne, ni = np.ascontiguousarray(held["matrix"]), int(held["Ne"]), int(held["Ni"])
    rows = np.unpackbits(matrix.astype(matrix.dtype.newbyteorder("<")).view(np.uint8), axis=1, bitorder="little")[:, :ne]
    return rows[:ni], rows[ni:]


def parquet_arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(x, y), signals by examples, of an example table in Parquet, by ``id``; read by the process that calls, not by Spark."""
    import pyarrow.parquet as pq

    held = pq.read_table(path).sort_by("id")
    column = lambda p: sorted((c for c in held.column_names if c[:1] == p and c[1:].isdigit()), key=lambda c: int(c[1:]))
    rows = lambda p: np.array([held[c].to_numpy() for c in column(p)], dtype=np.uint8)
    return rows("x"), rows("y")


def read_npz(spark: SparkSession, path: str, targets: Sequence[int] | None = None) -> DataFrame:
    """A packed array file as an example table."""
    x, y = npz_arrays(path)
    return pick_targets(from_arrays(spark, x.T, y.T), targets)


def read_function_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A function written as JSON: ``{name: [[input bits, output bits], ...]}``."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.from_json(F.get_json_object("value", f"$.{name}"), "array<array<array<int>>>")
    rows = text.select(F.posexplode(pairs).alias("id", "p"))
    first = rows.select(F.size(F.get("p", F.lit(0))), F.size(F.get("p", F.lit(1)))).first()
    bit = lambda side, i, p: F.get(F.get("p", F.lit(side)), F.lit(i)).alias(f"{p}{i}")
    return rows.select(F.col("id").cast("bigint").alias("id"), *(bit(0, i, "x") for i in range(first[0])), *(bit(1, i, "y") for i in range(first[1])))


def read_index(spark: SparkSession, source: Sequence[int] | str) -> DataFrame:
    """(pos, id) from a list, a ``.npy`` file or a Parquet file of it."""
    from gatewright.sources.truth_tables import index_table

    if not isinstance(source, str):
        return index_table(spark, source)
    if source.endswith(".npy"):
        return index_table(spark, np.load(source, allow_pickle=False).ravel().tolist())
    return spark.read.parquet(source).select("pos", "id")


def write_results(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


class Encoder(json.JSONEncoder):
    """JSON for values that NumPy made."""

    def default(self, value: object) -> object:
        if isinstance(value, np.generic):
            return value.item()
        if isinstance(value, np.ndarray):
            return value.tolist()
        return super().default(value)


def write_description(experiment: dict, path: str) -> None:
    Path(path).write_text(json.dumps(experiment, cls=Encoder, indent=1))
