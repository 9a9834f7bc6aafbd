"""A query for every operator of the Boolean-network engine, with the SQL that says the same.

Example tables come from ``events`` and ``orders`` (thresholds and low bits), from the
``examples`` table, and from truth tables of operators; networks from constants and from
the ``networks`` table. All queries read their whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.functions import operands
from gatewright.functions.gates import gate
from gatewright.model.network import Move, Network, beside, chained, spacings
from gatewright.operators import curricula, evaluate, graphs, metrics, packed, sampling
from gatewright.plans import experiment
from gatewright.search.optimisers import geometric, late_acceptance
from gatewright.session import table
from gatewright.sources import tables, truth_tables
from gatewright.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NET = Network.of([(0, 1, 8), (0, 1, 14), (1, 2, 7)], 3, 3)


def _ripple_adder(bits: int) -> Network:
    """The sum of two numbers, built from half and full adders; the low number in the first inputs."""
    gates: list[tuple[int, int, int]] = []

    def add(x: int, y: int, function: int) -> int:
        gates.append((x, y, function))
        return 2 * bits + len(gates) - 1

    sums, carry = [], None
    for i in range(bits):
        half, both = add(i, bits + i, 6), add(i, bits + i, 8)
        if carry is None:
            sums, carry = [half], both
        else:
            passed = add(half, carry, 8)
            sums.append(add(half, carry, 6))
            carry = add(both, passed, 14)
    for s in [*sums, carry]:
        add(s, s, 12)
    return Network.of(gates, 2 * bits, bits + 1)


DEEP = _ripple_adder(2)
DEAD = Network.of([(0, 1, 8), (1, 2, 6), (3, 2, 14), (0, 0, 7), (4, 5, 13), (3, 2, 9)], 3, 2)
DEPENDENCIES = [[], [0], [0, 1]]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# gates and evaluation

_BITS = "(select a.range::int as x, b.range::int as y from range(2) a, range(2) b)"
_EVENTS = """bx as (select event_id as id, (value >= 50)::int as x0, (event_type in ('purchase', 'signup'))::int as x1, (user_id % 2)::int as x2,
    (event_type = 'purchase' and value >= 50)::int as y0, (event_type = 'error')::int as y1, ((user_id + event_id) % 2)::int as y2 from events)"""
_ORDERS = """bo as (select *, xor(x0, x4) as y1, x4 & x5 as y2, (x0 + x1 + x5 >= 2)::int as y3 from (
    select o_orderkey as id, (o_custkey & 1)::int as x0, (o_custkey >> 1 & 1)::int as x1, (o_custkey >> 2 & 1)::int as x2, (o_custkey >> 3 & 1)::int as x3,
    (o_orderstatus = 'F')::int as x4, (o_orderpriority in ('1-URGENT', '2-HIGH'))::int as x5, (o_totalprice >= 250000)::int as y0 from orders))"""
_ERRORS = f"""{_EVENTS}, er as (select id, y0 as t0, y1 as t1, y2 as t2, xor(x0 & x1, y0) as e0, xor(x0 | x1, y1) as e1, xor(1 - (x1 & x2), y2) as e2, row_number() over (order by id) as rn, count(*) over () as ne from bx)"""
_CELLS = f"""{_ERRORS}, cells as (select id, rn, ne, unnest([0, 1, 2]) as r, unnest([e0, e1, e2]) as e, unnest([t0, t1, t2]) as t from er),
    o as (select r, any_value(ne)::double as ne, sum(e)::double as c, sum(t)::double as p, sum(e * t)::double as b, coalesce(any_value(ne) - min(rn) filter (e = 1) + 1, 0)::double as f from cells group by r),
    m as (select *, case when p in (0, ne) then 2 * (ne - c) / ne - 1 when p - b + c - b in (0, ne) then 0e0
        else ((p - b) * (ne - p - c + b) - (c - b) * b) / (sqrt((p - b + c - b) * p) * sqrt((ne - p) * (ne - p - c + b + b))) end as mcc from o)"""


@query("tf_truth_table", f"select k::int as k, x, y, (k >> (2 * x + y) & 1)::int as f from range(16) t(k), {_BITS}")
def tf_truth_table(spark: SparkSession, sf: str) -> DataFrame:
    xy = spark.range(4).select(F.shiftright("id", 1).cast("int").alias("x"), F.col("id").bitwiseAND(F.lit(1)).cast("int").alias("y"))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), gate(k, F.col("x"), F.col("y")).cast("int").alias("f")) for k in range(16)))
    return xy.select("x", "y", F.explode(rows).alias("g")).select("g.k", "x", "y", "g.f")


@query("tf_packed", f"select k::int as k, sum(k >> (2 * x + y) & 1)::bigint * 16 as ones from range(16) t(k), {_BITS} group by k")
def tf_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The packed gates on a word pair that holds each input pair 16 times."""
    xy = spark.range(64).select("id", F.shiftright("id", 1).bitwiseAND(F.lit(1)).cast("int").alias("x"), F.col("id").bitwiseAND(F.lit(1)).cast("int").alias("y"))
    words = packed.pack(xy, ["x", "y"])
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.bit_count(gate(k, F.col("x"), F.col("y"), packed=True)).cast("bigint").alias("ones")) for k in range(16)))
    return words.select(F.explode(rows).alias("g")).select("g.*")


def _event_errors(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.errors(tables.events(spark, sf), NET)


@query("net_outputs", f"with {_EVENTS} select id, x0 & x1 as o0, x0 | x1 as o1, 1 - (x1 & x2) as o2 from bx")
def net_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.outputs(tables.events(spark, sf), NET).select("id", "o0", "o1", "o2")


@query("net_activation_counts", f"with {_EVENTS} select sum(x0 & x1)::bigint as s3, sum(x0 | x1)::bigint as s4, sum(1 - (x1 & x2))::bigint as s5, sum(x0)::bigint as x0 from bx")
def net_activation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.activations(tables.events(spark, sf), NET).agg(*(F.sum(c).alias(c) for c in ("s3", "s4", "s5", "x0")))


@query("error_matrix", f"with {_ERRORS} select id, t0, t1, t2, e0, e1, e2 from er")
def error_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _event_errors(spark, sf)


@query("net_outputs_wide", "with t as (select range as id, (range >> 2) + (range & 3) as s from range(16)) select id, (s & 1)::int as o0, (s >> 1 & 1)::int as o1, (s >> 2 & 1)::int as o2 from t")
def net_outputs_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A two-bit adder by NumPy over Arrow batches, as very large networks are evaluated."""
    return evaluate.outputs(truth_tables.truth_table(spark, "add", 2, 3), DEEP, wide_gates=0).select("id", "o0", "o1", "o2")


@query("net_shrunk_outputs", "with t as (select range as id, (range >> 2) + (range & 3) as s from range(16)) select id, (s & 1)::int as o0, (s >> 1 & 1)::int as o1, (s >> 2 & 1)::int as o2 from t")
def net_shrunk_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.outputs(truth_tables.truth_table(spark, "add", 2, 3), DEEP.shrunk()).select("id", "o0", "o1", "o2")


@query("state_matrices", f"with {_EVENTS} select sum(x0)::bigint as inputs, sum(y0)::bigint as targets, sum(x0 & x1)::bigint as outputs, sum(xor(x0 & x1, y0))::bigint as errors, (sum(x0) + sum(x0 & x1))::bigint as activation from bx")
def state_matrices(spark: SparkSession, sf: str) -> DataFrame:
    act = evaluate.activations(tables.events(spark, sf), NET)
    return act.agg(F.sum("x0").alias("inputs"), F.sum("y0").alias("targets"), F.sum("s3").alias("outputs"), F.sum(F.col("s3").bitwiseXOR(F.col("y0"))).alias("errors"), (F.sum("x0") + F.sum("s3")).alias("activation"))


# metrics

_METRICS = {
    "e1": "select sum(c) / (3 * any_value(ne)) as v from o",
    "e2": "select sum((3 - r) / 6e0 * c / ne) as v from o",
    "e3": "select sum(q)::double / (3 * any_value(ne)) as v from (select ne, max(e) over (partition by id order by r) as q from cells)",
    "e3_general": "select sum(greatest(e0, 0) + greatest(e1, e0) + greatest(e2, e0, e1))::double / (3 * any_value(ne)) as v from er",
    "e4": "select sum(q) / (3 * any_value(ne)) as v from (select ne, max(f) over (order by r) as q from o)",
    "e5": "select coalesce(min_by(ne * (2 - r) + f, r) filter (f > 0), 0) / (3 * any_value(ne)) as v from o",
    "e6": "select coalesce(min_by(ne * (2 - r) + c, r) filter (c > 0), 0) / (3 * any_value(ne)) as v from o",
    "e6_thresholded": "select avg(case when s then 1e0 else c / ne end) as v from (select *, coalesce(bool_or(c / ne > 0.2) over (order by r rows between unbounded preceding and 1 preceding), false) as s from o)",
    "e6_general": "select avg(case when exists (select 1 from o d where d.r < o.r and d.c / d.ne > 0.05) then 1e0 else c / ne end) as v from o",
    "e7": "select coalesce(3 - min(r) filter (c > 0), 0) / 3e0 as v from o",
    "correctness": "select 1 - sum(greatest(e0, e1, e2))::double / any_value(ne) as v from er",
    "macro_mcc": "select avg(mcc) as v from m",
    "e2_mcc": "select sum((3 - r) / 6e0 * mcc) as v from m",
    "e6_mcc": "select coalesce(min_by(mcc - (2 - r), r) filter (c > 0), 0) / 3e0 as v from m",
}
_EXTRA: dict[str, dict] = {"e3_general": {"dependencies": DEPENDENCIES}, "e6_general": {"dependencies": DEPENDENCIES, "threshold": 0.05}, "e6_thresholded": {"threshold": 0.2}}


def _metric_query(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        got = metrics.evaluate(_event_errors(spark, sf), name, 3, **_EXTRA.get(name, {}))
        return got.select(F.round("value", 9).alias("value"))

    return run


for _name, _sql in _METRICS.items():
    query(f"metric_{_name}", f"with {_CELLS} select round(v, 9) as value from ({_sql})")(_metric_query(_name))


@query("metric_per_output_error", f"with {_CELLS} select r, round(c / ne, 9) as value from o")
def metric_per_output_error(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluate(_event_errors(spark, sf), "per_output_error", 3).select("r", F.round("value", 9).alias("value"))


@query("metric_per_output_mcc", f"with {_CELLS} select r, round(mcc, 9) as value from m")
def metric_per_output_mcc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluate(_event_errors(spark, sf), "per_output_mcc", 3).select("r", F.round("value", 9).alias("value"))


@query("metric_confusion", f"with {_CELLS} select r, (p - b)::bigint as tp, (c - b)::bigint as fp, b::bigint as fn, (ne - p - c + b)::bigint as tn from o")
def metric_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_event_errors(spark, sf), 3)


@query("error_cells", f"with {_CELLS} select id, r, e, t from cells")
def error_cells(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.cells(_event_errors(spark, sf), 3)


@query("metric_directory", """select * from (values ('e1', true, 0e0, false), ('e2', true, 0e0, false), ('e3', true, 0e0, false), ('e3_general', true, 0e0, false), ('e4', true, 0e0, false), ('e5', true, 0e0, false), ('e6', true, 0e0, false),
    ('e6_thresholded', true, 0e0, false), ('e6_general', true, 0e0, false), ('e7', true, 0e0, false), ('correctness', false, 1e0, false), ('per_output_error', true, 0e0, true), ('per_output_mcc', false, 1e0, true), ('macro_mcc', false, 1e0, false),
    ('e2_mcc', false, 1e0, false), ('e6_mcc', false, 1e0, false)) t(name, minimise, optimum, per_output)""")
def metric_directory(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, metrics.is_minimiser(n), float(metrics.optimum(n)), n in metrics.function_names(scalar=False)) for n in metrics.function_names()]
    return spark.createDataFrame(rows, "name string, minimise boolean, optimum double, per_output boolean")


_EX = "examples_errors as (select dataset_id, y0 as t0, y1 as t1, xor(x0 & x1, y0) as e0, xor(xor(x2, x3), y1) as e1 from examples)"
NET8 = Network.of([(0, 1, 8), (2, 3, 6)], 8, 2)


@query("examples_metrics_by_dataset", f"""with {_EX} select dataset_id, count(*) as ne, round(avg(e0 + e1) / 2, 9) as err, round(1 - avg(greatest(e0, e1)), 9) as cor,
    round((avg(e0) + avg(greatest(e0, e1))) / 2, 9) as e3 from examples_errors group by dataset_id""")
def examples_metrics_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The largest table, metrics per data set: one map-side combined aggregation, hot data set or not."""
    errors = evaluate.errors(table(spark, sf, "examples"), NET8, keep=["dataset_id"])
    kept = metrics.profile(errors, 2, by=["dataset_id"])
    value = lambda n, a: F.round(metrics.value(n, 2), 9).alias(a)
    return kept.select("dataset_id", "ne", value("e1", "err"), value("correctness", "cor"), value("e3", "e3"))


@query("lineitem_metrics", """with t as (select (l_quantity > 25)::int & (l_discount >= 0.05)::int as o, (l_returnflag = 'R')::int as y from lineitem)
    select count(*) as ne, round(avg(xor(o, y)), 9) as err, round(1 - avg(xor(o, y)), 9) as cor from t""")
def lineitem_metrics(spark: SparkSession, sf: str) -> DataFrame:
    errors = evaluate.errors(tables.lineitem(spark, sf), Network.of([(0, 1, 8)], 2, 1), keep=[])
    kept = metrics.record(errors, 1)
    return kept.select("ne", F.round("err", 9).alias("err"), F.round("cor", 9).alias("cor"))


@query("quality_by_day", f"""with {_ERRORS} select date_trunc('day', ts) as start, count(*) as ne, round(avg(e0 + e1 + e2) / 3, 9) as err, round(1 - avg(greatest(e0, e1, e2)), 9) as cor
    from er join events on id = event_id group by 1""")
def quality_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """What the streaming monitor gives, over the whole table."""
    timed = tables.events(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts"), "id")
    got = monitor.network_quality(timed, NET, at="ts", window="1 day")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "ne", F.round("err", 9).alias("err"), F.round("cor", 9).alias("cor"))


# operators and example sources


def _op_sql(op: str, nb: int, no: int) -> str:
    ni = operands.input_width(op, nb)
    a, b, full = f"(x >> {nb})", f"(x & {2**nb - 1})", 2**nb - 1
    v = {"zero": "0", "not": f"xor(x, {full})", "unary_and": f"(x = {full})::int", "unary_or": "(x <> 0)::int", "and": f"({a} & {b})", "or": f"({a} | {b})", "xor": f"xor({a}, {b})", "add": f"({a} + {b})", "sub": f"(({a} - {b} + {full + 1}) % {full + 1})", "mul": f"({a} * {b})"}[op]
    x = ", ".join(f"(x >> {i} & 1)::int as x{i}" for i in range(ni))
    y = ", ".join(f"({v} >> {i} & 1)::int as y{i}" for i in range(no))
    return f"select x as id, {x}, {y} from (select range::bigint as x from range({2**ni}))"


def _op_query(op: str, nb: int, no: int) -> Query:
    return lambda spark, sf: truth_tables.truth_table(spark, op, nb, no)


for _op in operands.OPERATORS:
    _nb = 8 if operands.operand_count(_op) == 1 else 4
    _no = 2 * _nb if _op == "mul" else _nb + 1 if _op == "add" else _nb
    query(f"op_{_op}", _op_sql(_op, _nb, _no))(_op_query(_op, _nb, _no))

_PICK = [5, 3, 3, 250, 17, 0, 255, 5]
_PICKED = "(values " + ", ".join(f"({i}::bigint, {v}::bigint)" for i, v in enumerate(_PICK)) + ") p(pos, id)"


@query("op_include", f"select pos, t.* from {_PICKED} join ({_op_sql('add', 4, 5)}) t using (id)")
def op_include(spark: SparkSession, sf: str) -> DataFrame:
    return truth_tables.iterate(spark, truth_tables.index_table(spark, _PICK), "add", 4, no=5)


@query("op_exclude", f"select * from ({_op_sql('add', 4, 5)}) where id not in (select id from {_PICKED})")
def op_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return truth_tables.iterate(spark, truth_tables.index_table(spark, _PICK), "add", 4, exclude=True, no=5)


@query("op_target_order", f"select id, y2 as y0, y0 as y1 from ({_op_sql('sub', 4, 4)})")
def op_target_order(spark: SparkSession, sf: str) -> DataFrame:
    return truth_tables.truth_table(spark, "sub", 4, 4, order=[2, 0]).select("id", "y0", "y1")


@query("op_widths", """select * from (values ('zero', 1, 4, 4, 16::bigint), ('not', 1, 4, 4, 16), ('unary_and', 1, 4, 4, 16), ('unary_or', 1, 4, 4, 16), ('and', 2, 8, 4, 256), ('or', 2, 8, 4, 256), ('xor', 2, 8, 4, 256),
    ('add', 2, 8, 4, 256), ('sub', 2, 8, 4, 256), ('mul', 2, 8, 4, 256)) t(operator, operands, ni, nout, n)""")
def op_widths(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(o, operands.operand_count(o), operands.input_width(o, 4), operands.default_outputs(o, 4), 1 << operands.input_width(o, 4)) for o in operands.OPERATORS]
    return spark.createDataFrame(rows, "operator string, operands int, ni int, nout int, n bigint")


# sampling, splitting, noise


def _md5(id_: str, number: str) -> str:
    return f"md5(concat_ws('-', {id_}, '7', {number}))"


_SAMPLES = f"""s as (select sample, id, row_number() over (partition by sample order by {_md5('id', 'sample')}, id) - 1 as pos from bx, range(3) t(sample))"""


@query("sample_k", f"with {_EVENTS}, {_SAMPLES} select sample::int as sample, pos::int as pos, id from s where pos < 100")
def sample_k(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_index(tables.events(spark, sf), 3, 100, 7)


@query("train_test_joint", f"with {_EVENTS}, {_SAMPLES} select sample::int as sample, pos::int as pos, id, case when pos < 60 then 'train' else 'test' end as part from s where pos < 100")
def train_test_joint(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.train_test_index(tables.events(spark, sf), 3, 60, 40, 7)


@query("train_test_partition", f"with {_EVENTS}, {_SAMPLES}, k as (select id from s where sample = 0 and pos < 100) select 'train' as part, bx.* from bx join k using (id) union all select 'test', bx.* from bx where id not in (select id from k)")
def train_test_partition(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.events(spark, sf)
    train, test = sampling.partition(df, sampling.sample_index(df, 1, 100, 7).select("pos", "id"))
    return train.drop("pos").withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("sample_inverted", f"select t.* from ({_op_sql('mul', 4, 8)}) t where id not in (select id from {_PICKED})")
def sample_inverted(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample(truth_tables.truth_table(spark, "mul", 4, 8), truth_tables.index_table(spark, _PICK), invert=True)


@query("bagging", f"""with n as (select count(*) as n from orders), d as (select range as pos, ('0x' || left({_md5('range', "'bag'")}, 15))::bigint % n as id from n, range((select n from n)))
    select pos, o_orderkey as id, o_totalprice from d join orders on id = o_orderkey""")
def bagging(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return sampling.gather(orders, sampling.bag_index(orders, orders.count(), 7)).select("pos", "id", "o_totalprice")


def _noise(column: str) -> str:
    other = f"'{column}'"
    return f"case when row_number() over (order by {_md5('id', other)}, id) <= round_even(count(*) over () * 0.05, 0) then 1 - {column} else {column} end as {column}"


@query("target_noise", f"with {_EVENTS} select id, {_noise('y0')}, {_noise('y1')}, {_noise('y2')} from bx")
def target_noise(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.events(spark, sf)
    return sampling.noisy(df, ["y0", "y1", "y2"], df.count(), 0.05, 7).select("id", "y0", "y1", "y2")


@query("spacings", "select n, k, i, (n // k + (i >= k - n % k)::int)::int as part from (values (51, 4), (7, 7), (3, 5)) t(n, k), lateral (select unnest(range(k)) as i)")
def spacings_(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, k, i, p) for n, k in ((51, 4), (7, 7), (3, 5)) for i, p in enumerate(spacings(n, k))]
    return spark.createDataFrame(rows, "n int, k int, i bigint, part int")


@query("pack_unpack", f"with {_EVENTS} select id, x0, x1, y1 from bx")
def pack_unpack(spark: SparkSession, sf: str) -> DataFrame:
    return packed.unpack(packed.pack(tables.events(spark, sf), ["x0", "x1", "y1"]), ["x0", "x1", "y1"])


@query("packed_error_counts", f"with {_CELLS} select max(c) filter (r = 0)::bigint as e0, max(c) filter (r = 1)::bigint as e1, max(c) filter (r = 2)::bigint as e2 from o")
def packed_error_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Error counts from packed words: gates run on 64 examples at once."""
    words = packed.pack(tables.events(spark, sf), ["x0", "x1", "x2", "y0", "y1", "y2"])
    return packed.popcounts(evaluate.errors(words, NET, keep=["blk", "n_valid", "valid"], packed=True), ["e0", "e1", "e2"])


@query("packed_floodcounts", f"with {_CELLS} select max(f) filter (r = 0)::bigint as e0, max(f) filter (r = 1)::bigint as e1, max(f) filter (r = 2)::bigint as e2 from o")
def packed_floodcounts(spark: SparkSession, sf: str) -> DataFrame:
    words = packed.pack(tables.events(spark, sf), ["x0", "x1", "x2", "y0", "y1", "y2"])
    return packed.floodcounts(evaluate.errors(words, NET, keep=["blk", "n_valid", "valid"], packed=True), ["e0", "e1", "e2"])


@query("target_reorder", f"with {_ORDERS} select id, y3 as y0, y1 as y1 from bo")
def target_reorder(spark: SparkSession, sf: str) -> DataFrame:
    return tables.orders(spark, sf).select("id", F.col("y3").alias("y0"), F.col("y1"))


@query("feature_mask", f"with {_ORDERS} select id, x0, x4, xor(x0, x4) as o0 from bo")
def feature_mask(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.outputs(tables.orders(spark, sf), Network.of([(0, 1, 6)], 2, 1), inputs=["x0", "x4"]).select("id", "x0", "x4", "o0")


@query("distinct_patterns", f"with {_ORDERS} select x0, x1, x2, x3, x4, x5, count(*) as n from bo group by all having count(*) > 1")
def distinct_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return curricula.repeated_patterns(tables.orders(spark, sf), [f"x{i}" for i in range(6)])


# graphs


def _edges(net: Network) -> str:
    rows = ", ".join(f"({g + net.ni}, {s})" for g, (a, b, _) in enumerate(net.gates) for s in (a, b))
    return f"edges as (select * from (values {rows}) t(node, source))"


def _reached(net: Network) -> str:
    outs = ", ".join(f"({s})" for s in net.outputs)
    return f"{_edges(net)}, live as (select node from (values {outs}) t(node) union select source from live join edges using (node))"


@query("connected_sources", f"with recursive {_reached(DEAD)} select node as source from live")
def connected_sources(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in DEAD.connected_sources()], "source int")


@query("connected_gates", f"with recursive {_reached(DEAD)} select node - {DEAD.ni} as gate from live where node >= {DEAD.ni}")
def connected_gates(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(g,) for g in DEAD.connected_gates()], "gate int")


@query("filter_connected", "select id, x0, x1, x2, case when xor(x1, x2) = 0 and (x0 & x1 | x2) = 1 then 0 else 1 end as o0, (1 - xor(x0 & x1, x2))::int as o1 from (select range::bigint as id, (range & 1)::int as x0, (range >> 1 & 1)::int as x1, (range >> 2 & 1)::int as x2 from range(8))")
def filter_connected(spark: SparkSession, sf: str) -> DataFrame:
    inputs = spark.range(8).select("id", *truth_tables.bits(F.col("id"), 3, "x"))
    # unconnected gates away, the two outputs as before
    return evaluate.outputs(inputs, DEAD.shrunk())


@query("node_depths", f"with recursive {_edges(DEEP)}, paths as (select node, 1 as d from edges where source < {DEEP.ni} union select e.node, d + 1 from paths p join edges e on e.source = p.node) select (node - {DEEP.outputs[0]})::int as r, max(d)::int as depth from paths where node >= {DEEP.outputs[0]} group by 1")
def node_depths(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DEEP.depths())), "r int, depth int")


_NET_EDGES = "e as (select net_id, ni, nout, g + ni as node, unnest([s1, s2]) as source from (select net_id, ni, nout, unnest(range(len(gates))) as g, unnest(gates).src1 as s1, unnest(gates).src2 as s2 from networks))"


@query("networks_depths", "select net_id, (unnest(range(len(max_depths))))::int as r, unnest(max_depths)::int as depth from networks")
def networks_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Depths of all stored networks by a fold over their gates; the table has them stored too."""
    return graphs.depths(table(spark, sf, "networks"))


@query("networks_connectivity", f"""with recursive {_NET_EDGES}, live as (
        select net_id, ni, ni + len(gates) - 1 - unnest(range(nout)) as node from networks
        union select l.net_id, l.ni, e.source from live l join e using (net_id, node))
    select net_id, count(*) filter (node >= ni)::int as live_gates, count(*) filter (node < ni)::int as live_inputs from live group by net_id""")
def networks_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.connectivity(table(spark, sf, "networks"))


@query("networks_gate_table", "select net_id, ni, nout, (unnest(range(len(gates))))::int as g, unnest(gates).src1 as src1, unnest(gates).src2 as src2, unnest(gates).tf as tf from networks")
def networks_gate_table(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.gate_table(table(spark, sf, "networks"))


_NET_VALUE = " ".join(f"when '{o}' then " + {"zero": "0", "not": "xor(x, top)", "unary_and": "(x = top)::int", "unary_or": "(x <> 0)::int", "and": "a & b", "or": "a | b", "xor": "xor(a, b)", "add": "a + b", "sub": "(a - b + top + 1) % (top + 1)", "mul": "a * b"}[o] for o in operands.OPERATORS)


@query("networks_operator_errors", f"""with recursive known as (
        select net_id, ni, nout, gates, target_function as f, (case when target_function in {operands.UNARY} then ni else ni // 2 end)::bigint as nb from networks
        where target_function in {operands.OPERATORS} and (target_function in {operands.UNARY} or ni % 2 = 0)),
    ev as (select net_id, gates, x, 0 as g, list_transform(range(ni), lambda i: (x >> i & 1)::int) as act from known, lateral (select unnest(range((1::bigint << ni)::bigint)) as x)
        union all select net_id, gates, x, g + 1, list_append(act, (gates[g + 1].tf >> (2 * act[gates[g + 1].src1 + 1] + act[gates[g + 1].src2 + 1])) & 1) from ev where g < len(gates)),
    want as (select net_id, x, nout, ni, case f {_NET_VALUE} end as v from (select net_id, f, nout, ni, x, (1::bigint << nb) - 1 as top, x >> nb as a, x & ((1::bigint << nb) - 1) as b from known, lateral (select unnest(range((1::bigint << ni)::bigint)) as x)))
    select net_id, r::int as r, count(*) as ne, count(*) filter (act[len(act) - nout + r + 1] <> (v >> r & 1)) as errors
    from ev join want using (net_id, x), lateral (select unnest(range(nout::bigint)) as r) where g = len(gates) group by net_id, r""")
def networks_operator_errors(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.operator_errors(table(spark, sf, "networks"))


_CHAIN = [Network.of([(0, 1, 7), (2, 2, 7)], 2, 1), Network.of([(0, 2, 6)], 3, 1), Network.of([(1, 3, 14), (4, 2, 8)], 4, 1)]


@query("chain_join_eval", "select id, x0, x1, ((x1 | xor(x0, x0 & x1)) & (x0 & x1))::int as o0, (x0 & x1)::int as o1, xor(x0, x0 & x1)::int as o2 from (select range::bigint as id, (range & 1)::int as x0, (range >> 1 & 1)::int as x1 from range(4))")
def chain_join_eval(spark: SparkSession, sf: str) -> DataFrame:
    """A joined chain: its stages learnt outputs 1, 2 and 0."""
    inputs = spark.range(4).select("id", *truth_tables.bits(F.col("id"), 2, "x"))
    return evaluate.outputs(inputs, chained(_CHAIN, [1, 2, 0]))


_XY = "(select range::bigint as id, (range & 1)::int as x0, (range >> 1 & 1)::int as x1, (range >> 2 & 1)::int as x2 from range(8))"


@query("split_join_eval", f"select id, x0, x1, x2, (x0 & x1)::int as o0, xor(x1, x2)::int as o1 from {_XY}")
def split_join_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Two networks side by side, the second fed features 1 and 2 only."""
    inputs = spark.range(8).select("id", *truth_tables.bits(F.col("id"), 3, "x"))
    first = Network.of([(0, 1, 7), (3, 3, 7)], 3, 1)
    return evaluate.outputs(inputs, beside(first, Network.of([(0, 1, 6)], 2, 1), 3, [1, 2]))


@query("strata_join_eval", f"select id, x0, x1, x2, xor(1 - (x0 & x1), x2)::int as o0, (x0 & x1)::int as o1 from {_XY}")
def strata_join_eval(spark: SparkSession, sf: str) -> DataFrame:
    """A second stratum that reads an inner gate of the first, outputs put in order afterwards."""
    inputs = spark.range(8).select("id", *truth_tables.bits(F.col("id"), 3, "x"))
    first = Network.of([(0, 1, 7), (3, 3, 7)], 3, 1)
    return evaluate.outputs(inputs, beside(first, Network.of([(0, 1, 6)], 2, 1), 3, [3, 2]).reordered([1, 0]))


_START = Network.of([(0, 1, 7), (2, 3, 7)], 4, 2)
_MOVES = [Move(0, 0, 2), Move(1, 1, 0), Move(0, 1, 3)]


@query("move_script_errors", """with t as (select range as id, (range & 1)::int as x0, (range >> 1 & 1)::int as x1, (range >> 2 & 1)::int as x2, (range >> 3 & 1)::int as x3 from range(16)),
    s as (select 0 as step, id, 1 - (x0 & x1) as e0, 1 - (x2 & x3) as e1 from t union all select 1, id, 1 - (x2 & x1), 1 - (x2 & x3) from t
        union all select 2, id, 1 - (x2 & x1), 1 - (x2 & x0) from t union all select 3, id, 1 - (x2 & x3), 1 - (x2 & x0) from t)
    select step::int as step, sum(e0)::bigint as c0, sum(e1)::bigint as c1 from s group by step""")
def move_script_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error counts against zero after each of a script of moves."""
    examples, net, out = truth_tables.truth_table(spark, "zero", 4, 2), _START, None
    for step in range(len(_MOVES) + 1):
        part = evaluate.errors(examples, net).agg(F.lit(step).alias("step"), F.sum("e0").alias("c0"), F.sum("e1").alias("c1"))
        out = part if out is None else out.unionByName(part)
        net = net.moved(_MOVES[step]) if step < len(_MOVES) else net
    return out


# curricula

_Y = ["y0", "y1", "y2", "y3"]
_PAIRS = f"""{_ORDERS}, l as (select id, unnest([0, 1, 2, 3]) as i, unnest([y0, y1, y2, y3]) as v from bo),
    pr as (select p.i, q.i as j, p.v as a, q.v as b, count(*)::double as n from l p join l q using (id) group by all)"""
_EFFECT = f"""{_PAIRS}, mn as (select i, j, sum(n * b) filter (a = 0) / sum(n) filter (a = 0) as m0, sum(n * b) filter (a = 1) / sum(n) filter (a = 1) as m1 from pr group by all),
    raw as (select i, j, case when i = j then 0 else coalesce(abs(coalesce(m0, null) - m1), 0) end as e from mn),
    eff as (select i, j, e / case when sum(e) over (partition by j) = 0 then 1 else sum(e) over (partition by j) end as e from raw)"""


@query("conditional_entropy", f"with {_PAIRS}, h as (select i, j, n, sum(n) over (partition by i, j, b) as nb, sum(n) over (partition by i, j) as nn from pr) select i, j, round(abs(-sum(n / nn * log2(n / nb))), 9) as h from h group by i, j")
def conditional_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return curricula.conditional_entropy(tables.orders(spark, sf), _Y).select("i", "j", F.round("h", 9).alias("h"))


@query("effect_relation", f"with {_EFFECT} select i, j, round(e, 9) as e from eff")
def effect_relation(spark: SparkSession, sf: str) -> DataFrame:
    return curricula.effect_relation(tables.orders(spark, sf), _Y).select("i", "j", F.round("e", 9).alias("e"))


@query("label_effect_rank", f"with {_EFFECT}, v1 as (select i, sum(e) as v from eff group by i), v2 as (select eff.i, sum(e * v) as v from eff join v1 on v1.i = eff.j group by eff.i) select i, round(v, 9) as v, (rank() over (order by round(v, 12) desc) - 1)::int as rank from v2")
def label_effect_rank(spark: SparkSession, sf: str) -> DataFrame:
    return curricula.label_effect_rank(tables.orders(spark, sf), _Y, 2).select("i", F.round("v", 9).alias("v"), "rank")


@query("cebcc_order", f"""with recursive {_PAIRS}, hh as (select i, j, n, sum(n) over (partition by i, j, b) as nb, sum(n) over (partition by i, j) as nn from pr), h as (select i, j, abs(-sum(n / nn * log2(n / nb))) as h from hh group by i, j),
    -- one output is picked per round; the sums are over those that are left
    pick as (select v, 0 as round, [0, 1, 2, 3] as rest, null::int as target from (values (1), (2), (3), (4)) t(v)
        union all select v, round + 1, list_filter(rest, lambda t: t <> best), best from (select v, round, rest, (select t from (select t, round((select sum(h) from h where case when v < 3 then i = t and list_contains(rest, j) else j = t and list_contains(rest, i) end), 12) as s from (select unnest(rest) as t)) order by case when v in (1, 3) then s else -s end, t limit 1) as best from pick where len(rest) > 0))
    select v::int as variant, (case when v in (1, 4) then 4 - round else round - 1 end)::int as place, target::int as target from pick where target is not null""")
def cebcc_order(spark: SparkSession, sf: str) -> DataFrame:
    h = curricula.matrix(curricula.conditional_entropy(tables.orders(spark, sf), _Y), "h", 4)
    rows = [(v, p, t) for v in (1, 2, 3, 4) for p, t in enumerate(curricula.entropy_order(h, v))]
    return spark.createDataFrame(rows, "variant int, place int, target int")


_MASKS = f"""{_ORDERS}, pt as (select distinct x0 + 2 * x1 + 4 * x2 + 8 * x3 + 16 * x4 + 32 * x5 as code, unnest([1, 2, 3]) as t, unnest([y1, y2, y3]) as y from bo),
    ms as (select t, m, max(hi - lo) as clash from (select t, m, code & m as part, min(y) as lo, max(y) as hi from pt, range(64) r(m) group by all) group by t, m)"""


@query("min_feature_set", f"with {_MASKS} select t as target, min(bit_count(m))::int as size from ms where clash = 0 group by t")
def min_feature_set(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.orders(spark, sf)
    rows = [(t, len(curricula.min_feature_set(df, [f"x{i}" for i in range(6)], f"y{t}") or [])) for t in (1, 2, 3)]
    return spark.createDataFrame(rows, "target int, size int")


@query("greedy_feature_set")
def greedy_feature_set(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.orders(spark, sf)
    rows = [(t, curricula.greedy_feature_set(df, [f"x{i}" for i in range(6)], f"y{t}")) for t in (1, 2, 3)]
    return spark.createDataFrame(rows, "target int, features array<int>")


@query("pairwise_labels", f"with {_ORDERS} select count(*) filter (xor(y0, y1) = 1) as d01, count(*) filter (xor(y1, y2) = 1) as d12, count(*) filter (xor(y2, y3) = 1) as d23 from bo")
def pairwise_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring outputs compared, pair by pair."""
    return tables.orders(spark, sf).agg(*(F.count(F.when(F.col(a) != F.col(b), 1)).alias(f"d{a[1]}{b[1]}") for a, b in zip(_Y, _Y[1:], strict=False)))


# configurations, tasks, search

EXPERIMENT = {
    "name": "adders", "seed": 11,
    "base_config": {
        "data": {"type": "generated", "operator": "add", "bits": 2, "out_width": 3}, "sampling": {"type": "generated", "Ns": 2, "Ne": 12, "seed": "shared"},
        "learner": {"name": "split", "network_params": {"Ng": "8n", "node_funcs": [7]}, "target_order": "lsb"},
        "optimiser": {"name": "LAHC", "guiding_function": "e1", "cost_list_length": 20, "max_iterations": 300}, "notes": "query",
        "log_keys": [["{}_size", True, ["(sampling)", "(Ne)"]]],
    },
    "product": [
        [{"learner": {"name": "monolithic"}, "optimiser": {"guiding_function": "e3"}}, {"learner": {"name": "classifierchain", "target_order": "auto", "early_terminate": False}}, {"learner": {"name": "stratified", "target_order": "auto", "early_terminate": False}}],
        [{"sampling": {"Ne": 8}}, {"sampling": {"Ne": 12}}],
    ],
}


@query("config_product", "select (row_number() over (order by a, b) - 1)::int as config_num, learner, ne from (values (0, 'monolithic'), (1, 'classifierchain'), (2, 'stratified')) t(a, learner), (values (0, 8), (1, 12)) u(b, ne)")
def config_product(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, c["learner"]["name"], c["sampling"]["Ne"]) for i, c in enumerate(experiment.configurations(EXPERIMENT))]
    return spark.createDataFrame(rows, "config_num int, learner string, ne int")


@query("task_explode", "select c::int as config_num, s::int as training_set_number from range(6) t(c), range(2) u(s)")
def task_explode(spark: SparkSession, sf: str) -> DataFrame:
    return experiment.tasks(spark, EXPERIMENT).select("config_num", "training_set_number")


@query("log_key_filter", "select * from (values ('learner_name', 'monolithic'), ('optimiser_name', 'LAHC'), ('size', '8')) t(key, value)")
def log_key_filter(spark: SparkSession, sf: str) -> DataFrame:
    config = experiment.configurations(EXPERIMENT)[0]
    got = experiment.filter_keys(config, [("{}_name", [".*", "name"]), ("size", ["sampling", "Ne"])])
    return spark.createDataFrame([(k, str(v)) for k, v in got.items()], "key string, value string")


@query("cooling_schedule", "select i::int as i, round(5 * pow(0.95e0, i), 9) as t from range(20) r(i)")
def cooling_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(i, round(t, 9)) for i, t in enumerate(geometric(5, 0.95, 20))], "i int, t double")


@query("late_acceptance_trace", """with recursive c as (select unnest(range(9))::int as i, unnest([9e0, 11e0, 9.5, 8e0, 8.5, 8.9, 12e0, 8e0, 7.5]) as cost),
    r as (select -1 as i, null::double as cost, null::boolean as accepted, 10e0 as now, [10e0, 10e0, 10e0] as past
        union all select c.i, c.cost, c.cost <= r.now or c.cost < r.past[1], case when c.cost <= r.now or c.cost < r.past[1] then c.cost else r.now end, list_append(r.past[2:3], case when c.cost <= r.now or c.cost < r.past[1] then c.cost else r.now end) from r join c on c.i = r.i + 1)
    select i, cost, accepted, now from r where i >= 0""")
def late_acceptance_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Late acceptance replayed over a fixed trace of costs."""
    accept, now, rows = late_acceptance(10.0, 3), 10.0, []
    for i, cost in enumerate([9.0, 11.0, 9.5, 8.0, 8.5, 8.9, 12.0, 8.0, 7.5]):
        ok = accept(i, now, cost)
        now = cost if ok else now
        rows.append((i, cost, ok, now))
    return spark.createDataFrame(rows, "i int, cost double, accepted boolean, now double")


def _agreeing(spark: SparkSession, one: dict) -> DataFrame:
    """Results of an experiment on a generated table, and whether their networks, evaluated here as rows, say the same.

    The recorded final network of each task is folded over all examples of the truth table in
    the JVM; the errors on the examples that the task was given, and on the others, have to be the
    recorded ones, output by output.
    """
    tasks = experiment.tasks(spark, one).persist()
    results = experiment.run(tasks).join(tasks.select("task_id", "training_indices"), "task_id")
    data = one["base_config"]["data"]
    table_ = truth_tables.truth_table(spark, data["operator"], data["bits"], data["out_width"])
    x, y = ([F.col(c) for c in table_.columns if c[0] == p] for p in "xy")
    examples = table_.select("id", F.array(*x).alias("x"), F.array(*y).alias("y"))
    # a task has few examples and there are few tasks; both sides are tiny here
    cells = results.select("task_id", "nout", "final_net", "training_indices", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(x) - 1))).alias("id"))
    act = F.aggregate("final_net", F.col("x"), lambda a, g: F.concat(a, F.array(F.call_function("shiftright", g[2], 2 * F.get(a, g[0]) + F.get(a, g[1])).bitwiseAND(F.lit(1)))))
    cells = cells.join(examples, "id").withColumn("o", F.slice(act, -F.col("nout"), F.col("nout")))
    wrong = F.aggregate(F.zip_with("o", "y", lambda a, b: a.bitwiseXOR(b)), F.lit(0), lambda a, e: a + e)
    mine = F.array_contains("training_indices", F.col("id").cast("bigint"))
    mean = lambda part: F.avg(F.when(part, wrong / F.col("nout")))
    errors = cells.groupBy("task_id").agg(mean(mine).alias("trg"), mean(~mine).alias("test"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    whole = F.array_sort("target_order") == F.sequence(F.lit(0), F.col("nout") - 1)
    return results.join(errors, "task_id").select(
        "config_num", "training_set_number", "learner", "guiding_function", "ni", "nout", "ne", near("trg_err", "trg").alias("trained_as_told"), near("test_err", "test").alias("tested_as_told"), whole.alias("order_whole"),
        (F.size("final_net") == F.col("ng")).alias("size_as_told"), F.col("failed").isNull().alias("ended"),
    )


def _told(rows: str) -> str:
    return f"select c::int as config_num, s::int as training_set_number, learner, guide as guiding_function, 4 as ni, 3 as nout, n::int as ne, true as trained_as_told, true as tested_as_told, true as order_whole, true as size_as_told, true as ended from {rows}"


#: Sixteen examples of a two-bit adder; the first samples of training examples, as lists so that anyone can tell which they are.
_GIVEN = [[0, 2, 3, 5, 6, 8, 9, 11, 12, 14, 15, 1], [4, 7, 10, 13, 0, 1, 2, 3, 8, 9, 14, 15]]


def _with(learner: dict, optimiser: dict | None = None, noise: float = 0.0) -> dict:
    base = EXPERIMENT["base_config"]
    data = {**base["data"], "add_noise": noise} if noise else base["data"]
    return {"name": "one", "seed": 11, "base_config": {**base, "data": data, "sampling": {"type": "given", "indices": _GIVEN}, "learner": {"network_params": {"Ng": "8n", "node_funcs": [7]}, **learner}, "optimiser": optimiser or base["optimiser"], "log_keys": []}}


@query("learn_tasks", _told("(values (0, 'monolithic', 'e3'), (1, 'classifierchain', 'e1'), (2, 'stratified', 'e1')) v(c, learner, guide), (values (0, 12), (1, 12)) w(s, n)"))
def learn_tasks(spark: SparkSession, sf: str) -> DataFrame:
    one = _with({"name": "monolithic", "target_order": "auto"})
    return _agreeing(spark, {**one, "list": [{"optimiser": {"guiding_function": "e3"}}, {"learner": {"name": "classifierchain", "early_terminate": False}}, {"learner": {"name": "stratified", "early_terminate": False}}]})


def _optimiser_run(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        extra = {"SA": {"num_temps": 10, "steps_per_temp": 30, "init_temp": 0.1, "temp_rate": 0.7}, "HC": {"max_iterations": 300}, "LAHC": {"max_iterations": "100n", "cost_list_length": 20}}[name]
        return _agreeing(spark, _with({"name": "monolithic", "target_order": "lsb"}, {"name": name, "guiding_function": "e1", "max_restarts": 1, **extra}))

    return run


for _name in ("HC", "LAHC", "SA"):
    query(f"{_name.lower()}_run", _told("(values (0, 'monolithic', 'e1')) v(c, learner, guide), (values (0, 12), (1, 12)) w(s, n)"))(_optimiser_run(_name))


def _learner_run(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        more: dict = {"sublearner": "classifierchain", "curricula_method": "CEbCC", "early_terminate": False} if name == "wrapper" else {"target_order": "auto"}
        if name not in ("monolithic", "wrapper"):
            more["early_terminate"] = False
        return _agreeing(spark, _with({"name": name, **more}, noise=0.1))

    return run


for _name in ("monolithic", "split", "classifierchain", "classifierchain_plus", "ecc_member", "stratified", "stratmultipar", "wrapper"):
    query(f"learner_{_name}", _told(f"(values (0, '{_name}', 'e1')) v(c, learner, guide), (values (0, 12), (1, 12)) w(s, n)"))(_learner_run(_name))


@query("results_by_learner", """select lower(learner) as learner, guiding_function, count(*) as n, round(avg(trg_err), 9) as trg_err, round(avg(test_err), 9) as test_err, min(finished_at) as first_at
    from (select distinct * from results) group by all""")
def results_by_learner(spark: SparkSession, sf: str) -> DataFrame:
    """Result records summed up, records that stand twice counted once."""
    unique = table(spark, sf, "results").distinct()
    return unique.groupBy(F.lower("learner").alias("learner"), "guiding_function").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("trg_err"), 9).alias("trg_err"), F.round(F.avg("test_err"), 9).alias("test_err"), F.min("finished_at").alias("first_at"))


@query("best_result_per_dataset", """select dataset_id, result_id, test_err from (select distinct * from results) where test_err is not null
    qualify row_number() over (partition by dataset_id order by test_err, result_id) = 1""")
def best_result_per_dataset(spark: SparkSession, sf: str) -> DataFrame:
    best = table(spark, sf, "results").where("test_err is not null").groupBy("dataset_id").agg(F.min(F.struct("test_err", "result_id")).alias("b"))
    return best.select("dataset_id", "b.result_id", "b.test_err")

