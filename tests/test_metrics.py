import numpy as np
import pytest

from gatewright.model.network import Network
from gatewright.operators import curricula, evaluate, metrics, packed, sampling
from gatewright.search.state import metric, pack_rows
from gatewright.sources import truth_tables

# networks, their functions and the values that have to come out (fixed values)
GOLDEN = [
    ("add", 2, 3, [(0, 2, 7), (1, 3, 7), (0, 4, 7), (2, 4, 7), (4, 4, 7), (1, 5, 7), (3, 5, 7), (9, 10, 7), (8, 11, 7), (8, 12, 7), (11, 12, 7), (6, 7, 7), (13, 14, 7), (5, 12, 7)], [3, 6, 5], None,
     {"e1": 0.0, "e4": 0.0, "e7": 0.0, "correctness": 1.0, "macro_mcc": 1.0}),
    ("add", 2, 3, [(0, 2, 8), (1, 3, 6), (1, 3, 8), (4, 5, 8), (0, 2, 6), (4, 5, 6), (6, 7, 14)], [1, 2, 3], [1, 2, 11], {"e1": 0.0, "e5": 0.0, "correctness": 1.0, "per_output_mcc": [1.0, 1.0, 1.0]}),
    ("unary_and", 4, 1, [(0, 1, 7), (2, 3, 7), (4, 4, 7), (5, 5, 7), (6, 7, 7), (8, 8, 7)], [4], None, {"e1": 0.0, "macro_mcc": 1.0}),
    ("unary_or", 4, 1, [(0, 0, 7), (1, 1, 7), (2, 2, 7), (3, 3, 7), (4, 5, 7), (6, 7, 7), (8, 8, 7), (9, 9, 7), (10, 11, 7)], [4], None, {"e1": 0.0, "macro_mcc": 1.0}),
    ("zero", 4, 1, [(0, 1, 7), (2, 3, 7), (4, 5, 7)], [2], None, {"e1": 0.4375, "e7": 1.0, "e4": 0.8125, "e5": 0.8125, "e6": 0.4375, "correctness": 0.5625, "macro_mcc": 0.125}),
    ("zero", 2, 1, [(0, 1, 7)], [1], None, {"e1": 0.75, "e4": 1.0, "correctness": 0.25, "macro_mcc": -0.5}),
    ("zero", 4, 2, [(0, 1, 7), (2, 3, 7)], [1, 1], [0, 2, 6, 8, 9, 10, 14, 15],
     {"e1": 0.8125, "e2": 0.8333333333333334, "e3": 0.875, "e7": 1.0, "e4": 1.0, "e5": 1.0, "e6": 0.9375, "correctness": 0.125, "macro_mcc": -0.625, "per_output_error": [0.875, 0.75], "per_output_mcc": [-0.75, -0.5]}),
    ("zero", 4, 2, [(0, 1, 7), (2, 3, 7), (4, 5, 7)], [1, 2], None,
     {"e1": 0.59375, "e2": 0.6458333333333334, "e3": 0.875, "e6": 0.875, "correctness": 0.0, "macro_mcc": -0.1875, "per_output_error": [0.75, 0.4375], "per_output_mcc": [-0.5, 0.125]}),
]


def got(errors, name, no, **options):
    rows = metrics.evaluate(errors, name, no, **options)
    if metrics.FUNCTIONS[name][2]:
        return [r["value"] for r in rows.orderBy("r").collect()]
    return rows.first()["value"]


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: f"{c[0]}-{len(c[3])}")
def test_golden_networks(spark, case):
    operator, nb, no, gates, depths, samples, want = case
    df = truth_tables.truth_table(spark, operator, nb, no)
    df = df if samples is None else sampling.gather(df, truth_tables.index_table(spark, samples))
    net = Network.of(gates, nb * (2 if operator == "add" else 1), no)
    assert net.depths() == depths
    errors = evaluate.errors(df, net)
    for name, value in want.items():
        assert got(errors, name, no) == pytest.approx(value), name


def test_four_bit_counter(spark):
    """Errors are the bits of the example's number, targets all zero; lowest bit first, then last."""
    for order, want in (([0, 1, 2, 3], {"e3": 0.765625, "e4": 0.9375, "e5": 0.984375, "e6": 0.875}), ([3, 2, 1, 0], {"e4": 0.765625, "e5": 0.875, "e6_mcc": -0.75})):
        errors = spark.range(16).selectExpr("id", *(f"cast(shiftright(id, {b}) & 1 as int) as e{r}" for r, b in enumerate(order)), *(f"0 as t{r}" for r in range(4)))
        for name, value in want.items():
            assert got(errors, name, 4) == pytest.approx(value), name


OPTIONS = {"e3_general": {"dependencies": [[], [0], [0, 1], [2]]}, "e6_general": {"dependencies": [[], [0], [0, 1], [2]], "threshold": 0.3}, "e6_thresholded": {"threshold": 0.4}}


@pytest.mark.parametrize("seed", range(4))
def test_columns_agree_with_packed_words(spark, seed):
    rng = np.random.default_rng(seed)
    ne, no = int(rng.integers(1, 150)), 4
    e, t = (rng.random((no, ne)) < rng.random((no, 1))).astype(np.uint8), (rng.random((no, ne)) < 0.5).astype(np.uint8)
    if seed == 1:
        e[:] = 0
    if seed == 2:
        t[0], t[1] = 0, 1
    # ids with gaps, so that ranks are not ids
    rows = [(3 * i + 5, *map(int, e[:, i]), *map(int, t[:, i])) for i in range(ne)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join([f"e{r} int" for r in range(no)] + [f"t{r} int" for r in range(no)])).repartition(3)
    pe, pt = pack_rows(e), pack_rows(t)
    for name in metrics.FUNCTIONS:
        options = OPTIONS.get(name, {})
        assert got(df, name, no, **options) == pytest.approx(metric(name, pe, pt, ne, **options)), name


def test_groups_weights_and_no_examples(spark):
    df = spark.createDataFrame([(1, "a", 1, 0, 1, 1), (2, "a", 0, 0, 0, 1), (3, None, 0, 1, 1, 0)], "id bigint, g string, e0 int, e1 int, t0 int, t1 int")
    by = {r["g"]: r["value"] for r in metrics.evaluate(df, "e4", 2, by=["g"]).collect()}
    assert by == {"a": 1.0, None: 0.5}
    assert got(df.where("g = 'a'"), "e2", 2, given_weights=[3, 1]) == pytest.approx(0.375)
    assert got(df.where("id > 9"), "e1", 2) is None and got(df.where("id > 9"), "macro_mcc", 2) is None
    with pytest.raises(ValueError):
        metrics.evaluate(df, "e9", 2)
    with pytest.raises(ValueError):
        metrics.evaluate(df, "e3_general", 2, dependencies=[[5], []])
    assert metrics.confusion(df, 2).where("r = 0").first().asDict() == {"r": 0, "tp": 1, "fp": 0, "fn": 1, "tn": 1}


def test_packing_round_trip_and_counts(spark):
    df = spark.range(130).selectExpr("id", "cast(id % 3 = 0 as int) a", "cast(id >= 70 as int) b", "0 c")
    words = packed.pack(df, ["a", "b", "c"])
    back = packed.unpack(words, ["a", "b", "c"]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.orderBy("id").collect()]
    assert packed.popcounts(words, ["a", "b", "c"]).first().asDict() == {"a": 44, "b": 60, "c": 0}
    assert packed.floodcounts(words, ["a", "b", "c"]).first().asDict() == {"a": 130, "b": 60, "c": 0}


def test_curricula(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((300, 5)) < 0.5).astype(int)
    y = np.stack([x[:, 0] & x[:, 3], x[:, 1], x[:, 0] ^ x[:, 1] ^ x[:, 2]], axis=1)
    df = spark.createDataFrame([(*map(int, a), *map(int, b)) for a, b in zip(x, y)], ", ".join([f"x{i} int" for i in range(5)] + [f"y{i} int" for i in range(3)]))
    features = [f"x{i}" for i in range(5)]
    ranks, sets = curricula.feature_set_ranks(df, features, ["y0", "y1", "y2"])
    assert sets == [[0, 3], [1], [0, 1, 2]] and ranks == [1, 0, 2]
    assert curricula.order_from_rank(ranks) == [1, 0, 2]
    assert curricula.greedy_feature_set(df, features, "y0") == [0, 3]
    assert curricula.greedy_cover(x, y[:, 0]) == [0, 3]
    assert curricula.min_feature_set(df.union(df.selectExpr(*features, "1 - y0 as y0", "y1", "y2").limit(1)), features, "y0") is None
    h = curricula.matrix(curricula.conditional_entropy(df, ["y0", "y1", "y2"]), "h", 3)
    assert np.allclose(np.diag(h), 0) and h[1, 0] <= 1.0
    for variant in (1, 2, 3, 4):
        assert sorted(curricula.entropy_order(h, variant)) == [0, 1, 2]
    with pytest.raises(ValueError):
        curricula.entropy_order(h, 5)
    e = curricula.matrix(curricula.effect_relation(df, ["y0", "y1", "y2"]), "e", 3)
    assert np.allclose(np.diag(e), 0) and np.allclose(e.sum(axis=0), 1)
    v = {r["i"]: r["v"] for r in curricula.label_effect_rank(df, ["y0", "y1", "y2"], 2).collect()}
    assert np.allclose([v[i] for i in range(3)], (e @ e).sum(axis=1))
