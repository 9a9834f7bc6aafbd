"""Networks as data: tables of very many networks, looked at one row per network.

Each network is bounded metadata, so it stays within its row: gates are folded by
higher-order functions in the JVM where the fold's state is small (depths, reachability),
and evaluated by NumPy over Arrow batches where it is a truth table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.functions import operands
from gatewright.model.network import Network
from gatewright.operators.evaluate import evaluate_bits

#: Examples of a truth table that are looked at together, and inputs beyond which a full table is an error.
BLOCK_EXAMPLES, MAX_INPUTS = 1 << 18, 40


def gate_table(networks: DataFrame) -> DataFrame:
    """(net_id, ni, nout, g, src1, src2, tf): one row per gate."""
    return networks.select("net_id", "ni", "nout", F.posexplode("gates").alias("g", "gate")).select("net_id", "ni", "nout", "g", "gate.*")


def depths(networks: DataFrame) -> DataFrame:
    """(net_id, r, depth): the longest path to each output, by one fold over the gates."""
    start = F.transform(F.sequence(F.lit(1), F.col("ni")), lambda _: F.lit(0))
    level = F.aggregate("gates", start, lambda acc, g: F.concat(acc, F.array(F.greatest(F.get(acc, g["src1"]), F.get(acc, g["src2"])) + 1)))
    last = F.slice(level, -F.col("nout"), F.col("nout"))
    return networks.where("nout > 0 and size(gates) >= nout and ni > 0").select("net_id", F.posexplode(last).alias("r", "depth"))


def _live(batch_gates: list, ni: int, no: int) -> tuple[int, int]:
    net = Network.of([(g["src1"], g["src2"], g["tf"]) for g in batch_gates], ni, no)
    return len(net.connected_gates()), sum(s < ni for s in net.connected_sources())


def connectivity(networks: DataFrame) -> DataFrame:
    """(net_id, live_gates, live_inputs): what the outputs depend on. Invalid networks give nulls."""

    @F.pandas_udf("live_gates int, live_inputs int")
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for gates, ni, no in zip(part["gates"], part["ni"], part["nout"], strict=True):
                try:
                    rows.append(_live(list(gates), int(ni), int(no)))
                except (ValueError, TypeError):
                    rows.append((None, None))
            yield pd.DataFrame(rows, columns=["live_gates", "live_inputs"]).astype("Int32")

    return networks.select("net_id", count(F.struct("gates", "ni", "nout")).alias("c")).select("net_id", "c.*")


def operator_errors(networks: DataFrame) -> DataFrame:
    """(net_id, r, ne, errors): each output against the network's target function over all 2^ni examples.

    Two-operand functions take ni / 2 bits each. Invalid networks and those without a known
    function or with an odd number of inputs for two operands give no rows. Tables are worked through
    in blocks; more than MAX_INPUTS inputs, whose table nobody could wait for, raise.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for net_id, name, ni, no, gates in part.itertuples(index=False):
                try:
                    ni, no = int(ni), int(no)
                    if ni < 1 or ni % operands.operand_count(name):
                        continue
                    net = Network.of([(g["src1"], g["src2"], g["tf"]) for g in gates], ni, no)
                except (ValueError, TypeError):
                    continue
                if ni > MAX_INPUTS:
                    raise ValueError(f"network {net_id} has {ni} inputs; a full table is made for at most {MAX_INPUTS}")
                wrong = np.zeros(no, dtype=np.int64)
                for begun in range(0, 1 << ni, BLOCK_EXAMPLES):
                    ids = np.arange(begun, min(begun + BLOCK_EXAMPLES, 1 << ni), dtype=np.int64)
                    act = evaluate_bits(net.gates, ni, (ids >> np.arange(ni)[:, None] & 1).astype(bool))[-no:]
                    want = operands.values(name, ni // operands.operand_count(name), ids)
                    # outputs above the 63rd bit of a value are 0
                    bits = np.minimum(np.arange(no), 63)[:, None]
                    wrong += (act != (want >> bits & 1).astype(bool)).sum(axis=1)
                out += [(net_id, r, 1 << ni, int(w)) for r, w in enumerate(wrong)]
            yield pd.DataFrame(out, columns=["net_id", "r", "ne", "errors"]).astype({"r": "int32", "ne": "int64", "errors": "int64", "net_id": "int64"})

    return networks.select("net_id", "target_function", "ni", "nout", "gates").mapInPandas(run, "net_id bigint, r int, ne bigint, errors bigint")
