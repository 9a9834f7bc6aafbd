import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.functions import operands
from gatewright.operators import graphs, packed, sampling
from gatewright.operators.scans import previous, running_before
from gatewright.sources import truth_tables


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_previous_row(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(g), int(o), i) for i, (g, o) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 25, 60)))]
    df = spark.createDataFrame(rows, "g int, o bigint, t int").repartition(4)
    got = {r["t"]: r["prev_t"] for r in previous(df, "g", "o", ["t"], tie="t", block=block).collect()}
    want = {}
    for g in range(3):
        order = sorted((o, t) for h, o, t in rows if h == g)
        want |= {t: before for (_, t), (_, before) in zip(order, [(None, None), *order])}
    assert got == want
    assert previous(df.where("g > 9"), "g", "o", ["t"], tie="t").count() == 0


def test_running_sum(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(b), i, int(v)) for i, (g, b, v) in enumerate(zip(rng.integers(0, 2, 80), rng.integers(0, 6, 80), rng.integers(0, 9, 80)))]
    df = spark.createDataFrame(rows, "g int, b int, k int, v int").repartition(3)
    got = {r["k"]: r["s"] for r in running_before(df, ["g"], "b", ["k"], "v", "s").collect()}
    for g in (0, 1):
        total = 0
        for _, b, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[k] == total
            total += v


@pytest.mark.parametrize("operator", operands.OPERATORS)
def test_operators_agree_with_plain_numbers(spark, operator):
    nb, no = 3, 6
    ni = operands.input_width(operator, nb)
    for row in truth_tables.truth_table(spark, operator, nb, no).collect():
        want = operands.value(operator, nb, row["id"])
        assert sum(row[f"y{i}"] << i for i in range(no)) == want and sum(row[f"x{i}"] << i for i in range(ni)) == row["id"]


def test_operator_limits(spark):
    index = truth_tables.index_table(spark, [1, 3, 1])
    assert sorted(r["pos"] for r in truth_tables.included(index, "and", 2).collect()) == [0, 1, 2]
    assert truth_tables.excluded(spark, index, "and", 2).count() == 14
    for outside in (99, -1):
        index = truth_tables.index_table(spark, [1, outside])
        for made in (truth_tables.included(index, "and", 2), truth_tables.excluded(spark, index, "and", 2)):
            with pytest.raises(Exception, match="is not in 0..15"):
                made.collect()
    with pytest.raises(Exception, match="more than 16"):
        truth_tables.excluded(spark, truth_tables.index_table(spark, list(range(16)) + [3]), "and", 2).collect()
    for bad in (lambda: operands.operand_count("div"), lambda: operands.input_width("and", 0), lambda: truth_tables.truth_table(spark, "and", 2, 2, order=[2])):
        with pytest.raises(ValueError):
            bad()


def test_network_tables_with_bad_rows(spark):
    schema = "net_id bigint, ni int, nout int, target_function string, gates array<struct<src1:int,src2:int,tf:int>>"
    good = [(0, 1, 8), (0, 1, 6)]
    df = spark.createDataFrame([(1, 2, 2, "add", good), (2, 2, 3, "add", good), (3, 2, 1, "none", good), (4, None, 1, None, good), (5, 2, 1, "add", None), (6, 3, 1, "add", good)], schema)
    assert sorted(map(tuple, graphs.depths(df).collect())) == [(1, 0, 1), (1, 1, 1), (3, 0, 1), (6, 0, 1)]
    live = {r["net_id"]: (r["live_gates"], r["live_inputs"]) for r in graphs.connectivity(df).collect()}
    assert live == {1: (2, 2), 2: (None, None), 3: (1, 2), 4: (None, None), 5: (None, None), 6: (1, 2)}
    assert sorted(map(tuple, graphs.operator_errors(df).collect())) == [(1, 0, 4, 3), (1, 1, 4, 3)]


def test_truth_tables_in_blocks(spark, monkeypatch):
    schema = "net_id bigint, ni int, nout int, target_function string, gates array<struct<src1:int,src2:int,tf:int>>"
    wide = [(0, 1, 8)]
    df = spark.createDataFrame([(1, 22, 1, "and", wide)], schema)
    assert [tuple(r) for r in graphs.operator_errors(df).collect()] == [(1, 0, 1 << 22, 1 << 20)]
    with pytest.raises(Exception, match="at most 40"):
        graphs.operator_errors(df.withColumn("ni", F.lit(42))).collect()


@pytest.mark.parametrize("operator", operands.OPERATORS)
def test_operators_on_vectors(operator):
    ids = np.arange(1 << operands.input_width(operator, 3))
    assert operands.values(operator, 3, ids).tolist() == [operands.value(operator, 3, int(i)) for i in ids]


def test_noise_and_bags(spark):
    df = spark.range(40).selectExpr("id", "0 as y0", "1 as y1")
    flipped = sampling.noisy(df, ["y0", "y1"], 40, 0.1, 1).collect()
    assert sum(r["y0"] for r in flipped) == 4 and sum(1 - r["y1"] for r in flipped) == 4
    assert sampling.noisy(df, ["y0"], 40, 0.001, 1) is df and sampling.effective_rate(40, 0.1) == 0.1 and sampling.effective_rate(0, 0.1) == 0
    bag = sampling.bag_index(df, 40, 3).collect()
    assert len(bag) == 40 and all(0 <= r["id"] < 40 for r in bag) and len({r["id"] for r in bag}) < 40
    assert sampling.sample_index(df, 2, 99, 1).count() == 80
    # any keys will do: places are given to them first
    sparse = spark.range(0, 300, 3)
    bag = sampling.gather(sparse, sampling.bag_index(sparse, 100, 3)).collect()
    assert len(bag) == 100 and all(r["id"] % 3 == 0 for r in bag)
    assert sampling.bag_index(df.limit(0), 0, 3).count() == 0


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_lowest_of_many_without_ordering_all(spark, bits):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(5)
    chance = lambda s, k: hashlib.md5(f"{k}-7-{s}".encode()).hexdigest()
    got = sampling.sample_index(df, 3, 60, 7, "k", bits=bits)
    rows = {(r["sample"], r["pos"]): r["k"] for r in got.collect()}
    assert rows == {(s, i): k for s in range(3) for i, k in enumerate(sorted(range(500), key=lambda k: chance(s, k))[:60])}
    flipped = sampling.noisy(df.selectExpr("k", "0 as y0", "0 as y1"), ["y0", "y1"], 500, 0.2, 7, "k", bits=bits).collect()
    for t in ("y0", "y1"):
        assert {r["k"] for r in flipped if r[t]} == set(sorted(range(500), key=lambda k: chance(t, k))[:100])
    assert sampling.sample_index(df, 2, 0, 7, "k", bits=bits).count() == 0


def test_packed_positions_with_gaps(spark):
    df = spark.createDataFrame([(0, 1), (5, 1), (40, 1), (41, 0), (200, 1)], "id bigint, s int")
    words = packed.pack(df, ["s"])
    assert packed.popcounts(words, ["s"]).first()["s"] == 4
    assert sorted(tuple(r) for r in packed.unpack(words, ["s"]).collect()) == [(0, 1), (5, 1), (40, 1), (41, 0), (200, 1)]
    # rows from the first one to the last: all five; with the first row 0, four
    assert packed.floodcounts(words, ["s"]).first()["s"] == 5
    assert packed.floodcounts(packed.pack(df.withColumn("s", F.when(F.col("id") == 0, 0).otherwise(F.col("s"))), ["s"]), ["s"]).first()["s"] == 4
