"""Networks evaluated over example tables.

A network becomes columns: one ``select`` per level of the network, each gate an expression
over columns of earlier levels, so Catalyst sees a chain of projections and fuses them into
generated code. Gates that no wanted column depends on are left out beforehand. Networks of
more than ``WIDE_GATES`` connected gates, whose generated code would get too large, are
evaluated with NumPy over Arrow batches, in which a gate is one vector operation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.functions.gates import TABLE, gate
from gatewright.model.network import Network

WIDE_GATES = 400


def source_columns(network: Network, inputs: Sequence[str] | None = None) -> list[str]:
    """The column of every source: given inputs, then s{number} for gates."""
    inputs = [f"x{i}" for i in range(network.ni)] if inputs is None else list(inputs)
    if len(inputs) != network.ni:
        raise ValueError(f"the network has {network.ni} inputs, not {len(inputs)}")
    return [*inputs, *(f"s{network.ni + g}" for g in range(network.ng))]


def activations(df: DataFrame, network: Network, *, inputs: Sequence[str] | None = None, packed: bool = False) -> DataFrame:
    """``df`` with a column for every gate."""
    name = source_columns(network, inputs)
    for level in range(1, max(network.levels, default=0) + 1):
        mine = [g for g in range(network.ng) if network.levels[network.ni + g] == level]
        df = df.select("*", *(gate(network.gates[g][2], F.col(name[network.gates[g][0]]), F.col(name[network.gates[g][1]]), packed=packed).alias(name[network.ni + g]) for g in mine))
    return df


def outputs(df: DataFrame, network: Network, *, inputs: Sequence[str] | None = None, prefix: str = "o", packed: bool = False, wide_gates: int = WIDE_GATES) -> DataFrame:
    """``df`` with the outputs as ``{prefix}0``.. ."""
    kept = network.shrunk()
    if kept.ng > wide_gates:
        return _vectors(df, kept, inputs, prefix)
    name = source_columns(kept, inputs)
    had = [F.col(f"`{c}`") for c in df.columns]
    return activations(df, kept, inputs=inputs, packed=packed).select(*had, *(F.col(name[s]).alias(f"{prefix}{i}") for i, s in enumerate(kept.outputs)))


def evaluate_bits(gates: Sequence[tuple[int, int, int]], ni: int, x: np.ndarray) -> np.ndarray:
    """All activations of bit-valued (bool) or packed (unsigned) input rows, one row per source."""
    act = np.empty((ni + len(gates), *x.shape[1:]), dtype=x.dtype)
    act[:ni] = x
    for g, (a, b, k) in enumerate(gates, ni):
        act[g] = vector_gate(k, act[a], act[b])
    return act


def vector_gate(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A function on vectors of bools or of unsigned words; always a new array."""
    return np.array(TABLE[k](x, y, ~np.zeros_like(x)))


def _vectors(df: DataFrame, network: Network, inputs: Sequence[str] | None, prefix: str) -> DataFrame:
    gates, ni, no = network.gates, network.ni, network.no
    names = source_columns(network, inputs)[:ni]

    @F.pandas_udf(", ".join(f"{prefix}{i} int" for i in range(no)))
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part.to_numpy().T != 0
            act = evaluate_bits(gates, ni, np.ascontiguousarray(x))
            yield pd.DataFrame(act[-no:].T.astype(np.int32), columns=[f"{prefix}{i}" for i in range(no)])

    made = df.withColumn("__gw_o", run(F.struct(*(F.col(f"`{c}`") for c in names))))
    return made.select(*(F.col(f"`{c}`") for c in df.columns), "__gw_o.*")


def errors(df: DataFrame, network: Network, *, inputs: Sequence[str] | None = None, targets: Sequence[str] | None = None, keep: Sequence[str] = ("id",), packed: bool = False) -> DataFrame:
    """The error table: ``keep``, targets t0.., and error bits e0.. (output xor target)."""
    targets = [f"y{r}" for r in range(network.no)] if targets is None else list(targets)
    out = outputs(df, network, inputs=inputs, prefix="__gw_o", packed=packed)
    return out.select(*keep, *(F.col(t).alias(f"t{r}") for r, t in enumerate(targets)), *(F.col(f"__gw_o{r}").bitwiseXOR(F.col(t)).alias(f"e{r}") for r, t in enumerate(targets)))


def checked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, failing at run time on a signal that is null or not 0 or 1."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    return df.where(F.coalesce(F.when(bad, F.raise_error(F.lit("a signal is null or not 0 or 1")).cast("boolean")), F.lit(True)))


def cells(errors_: DataFrame, no: int, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per example and output: keep, r, e, t."""
    return errors_.select(*keep, F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.col(f"e{r}").alias("e"), F.col(f"t{r}").alias("t")) for r in range(no)))).alias("c")).select(*keep, "c.*")

