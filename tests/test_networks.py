import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gatewright.functions.gates import gate, value
from gatewright.model.network import Editor, Move, Network, beside, chained, inverse, spacings
from gatewright.operators import evaluate
from gatewright.operators.evaluate import evaluate_bits, vector_gate
from gatewright.sources import truth_tables
from pyspark.sql import functions as F


def random_net(seed, ni=None, no=None, ng=None):
    rng = np.random.default_rng(seed)
    ni, no = ni or int(rng.integers(1, 8)), no or int(rng.integers(1, 5))
    return Network.random(max(no, ng or int(rng.integers(1, 25))), ni, no, list(range(16)), rng), rng


def outputs(net, x):
    return evaluate_bits(net.gates, net.ni, x)[-net.no :]


def table(n):
    return (np.arange(1 << n)[None, :] >> np.arange(n)[:, None] & 1).astype(bool)


def test_vector_gates_follow_the_truth_table(spark):
    x, y = np.array([0, 0, 1, 1], dtype=bool), np.array([0, 1, 0, 1], dtype=bool)
    for k in range(16):
        assert vector_gate(k, x, y).tolist() == [bool(value(k, a, b)) for a, b in zip(x, y)]
    with pytest.raises(ValueError):
        gate(16, F.lit(0), F.lit(0))


@pytest.mark.parametrize(
    ("gates", "ni", "no"),
    [([(0, 1, 7)], 0, 1), ([], 2, 1), ([(0, 1, 7)], 2, 2), ([(0, 1, 7)], 2, 0), ([(0, 1, 16)], 2, 1), ([(0, 2, 7)], 2, 1), ([(0, -1, 7)], 2, 1), ([(0, 1)], 2, 1)],
)
def test_invalid_networks(gates, ni, no):
    with pytest.raises(ValueError):
        Network.of(gates, ni, no)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_shrinking_keeps_outputs(seed):
    net, _ = random_net(seed)
    small = net.shrunk()
    assert small.ng == len(net.connected_gates())
    assert (outputs(small, table(net.ni)) == outputs(net, table(net.ni))).all()
    assert small.depths() == net.depths()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_moves_are_feed_forward_and_can_be_taken_back(seed):
    net, rng = random_net(seed)
    edit = Editor(net)
    for _ in range(5):
        move = edit.network.random_move(rng)
        assert move.new_source in edit.network.sources_allowed(move.gate)
        edit.apply(move)
    edit.revert()
    edit.revert_all()
    assert edit.network == net and edit.is_clean
    with pytest.raises(RuntimeError):
        edit.revert()
    again = net.randomised(rng)
    assert [g[2] for g in again.gates] == [g[2] for g in net.gates]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_chain_is_the_cascade(seed):
    rng = np.random.default_rng(seed)
    ni, no = int(rng.integers(1, 5)), int(rng.integers(1, 5))
    nets = [Network.random(int(rng.integers(1, 9)), ni + i, 1, list(range(16)), rng) for i in range(no)]
    order = rng.permutation(no).tolist()
    x = feed = table(ni)
    want = [None] * no
    for i, net in enumerate(nets):
        out = outputs(net, feed)
        want[order[i]] = out[0]
        feed = np.vstack([feed, out])
    assert (outputs(chained(nets, order), x) == np.array(want)).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_networks_side_by_side(seed):
    rng = np.random.default_rng(seed)
    ni = int(rng.integers(2, 6))
    first = Network.random(int(rng.integers(2, 9)), ni, int(rng.integers(1, 3)), list(range(16)), rng)
    readable = ni + first.ng - first.no
    feed = rng.choice(readable, size=min(readable, 3), replace=False).tolist()
    second = Network.random(int(rng.integers(2, 9)), len(feed), 1, list(range(16)), rng)
    x = table(ni)
    act = evaluate_bits(first.gates, ni, x)
    want = np.vstack([act[-first.no :], outputs(second, act[feed])])
    both = beside(first, second, ni, feed)
    assert (outputs(both, x) == want).all()
    order = rng.permutation(both.no).tolist()
    assert (outputs(both.reordered(order), x) == want[order]).all()
    assert inverse(inverse(order)) == order
    with pytest.raises(ValueError):
        beside(first, second, ni, [readable] * second.ni)


def test_spacings():
    for n, k in ((51, 4), (3, 5), (8, 8)):
        parts = spacings(n, k)
        assert sum(parts) == n and len(parts) == k and max(parts) - min(parts) <= 1 and parts == sorted(parts)
    with pytest.raises(ValueError):
        spacings(3, 0)


def test_columns_and_vectors_agree(spark):
    net, rng = random_net(5, ni=5, no=3, ng=30)
    df = spark.range(32).select("id", *truth_tables.bits(F.col("id"), 5, "x"))
    want = outputs(net, table(5)).astype(int)
    for limit in (1000, 0):
        got = evaluate.outputs(df, net, wide_gates=limit).orderBy("id").select("o0", "o1", "o2").collect()
        assert (np.array(got).T == want).all()
    packed = net.moved(Move(0, 0, 0))
    assert evaluate.outputs(df, packed).count() == 32
    with pytest.raises(ValueError):
        evaluate.outputs(df, net, inputs=["x0"])


def test_bad_signals_fail(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id bigint, x0 int")
    with pytest.raises(Exception, match="a signal is null"):
        evaluate.checked(df, ["x0"]).collect()
    assert evaluate.checked(df.where("id = 1"), ["x0"]).count() == 1
