import datetime as dt
import math

import numpy as np
import pytest

from gatewright.llm import percentiles as P

SCHEMA = "learner string, day date, learning_time double, n int, hi string"
ASKED = [0, 1, 2500, 5000, 9000, 9999, 10000]


def brute(values, p):
    values = sorted(values)
    return values[max(1, -(-len(values) * p // 10000)) - 1]


def make(spark, rows):
    return spark.createDataFrame([(g, d, v, 0, "clash") for g, d, v in rows], SCHEMA)


def by_group(rows):
    out = {}
    for g, _, v in rows:
        if v is not None and not math.isnan(v) and v >= 0:
            out.setdefault(g, []).append(v)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    made = []
    for day in range(4):
        d = dt.date(2026, 1, 1 + day)
        made += [("hot", d, float(v)) for v in rng.lognormal(3, 2.5, 700)] + [("ties", d, float(v)) for v in rng.integers(0, 3, 200)] + [(None, d, float(v)) for v in rng.random(20)]
        made += [("odd", d, v) for v in (None, float("nan"), -1.0, 0.0, -0.0, float("inf"), 5e-324, 1.7e308, 3.0 + day * 1e-15)]
    return [*made, ("one", dt.date(2026, 1, 1), 7.25), ("none", dt.date(2026, 1, 1), -1.0)]


def test_exact(spark, rows):
    got = {(r["learner"], r["p"]): (r["n"], r["value"]) for r in P.percentiles(make(spark, rows).repartition(5), ["learner"], "learning_time", ASKED).collect()}
    assert got == {(g, p): (len(v), brute(v, p)) for g, v in by_group(rows).items() for p in ASKED}


@pytest.mark.parametrize("parts", [2, 7])
def test_narrow_passes(spark, rows, parts):
    got = {(r["learner"], r["p"]): r["value"] for r in P.percentiles(make(spark, rows), ["learner"], "learning_time", [5000, 9000], parts=parts, width=50.0).collect()}
    assert got == {(g, p): brute(v, p) for g, v in by_group(rows).items() for p in (5000, 9000)}


def test_summaries_merge_and_bound(spark, rows):
    df = make(spark, rows)
    whole = P.summarise(df, ["learner"], "learning_time")
    days = P.summarise(df, ["learner", "day"], "learning_time")
    merged = P.merge(days, ["learner"])
    half = P.merge(P.merge(days.where("day < '2026-01-03'"), ["learner"]).unionByName(P.merge(days.where("day >= '2026-01-03'"), ["learner"])), ["learner"])
    sort = lambda d: sorted(map(str, d.select("learner", "cell", "n", "lo", "hi").collect()))
    assert sort(whole) == sort(merged) == sort(half)
    truth = by_group(rows)
    for r in P.bounds(merged, ["learner"], ASKED).collect():
        value = brute(truth[r["learner"]], r["p"])
        assert r["lo"] <= value <= r["hi"] and (r["hi"] <= r["lo"] * (1 + P.WIDTH) * (1 + 1e-9) or r["lo"] == r["hi"])
    got = {(r["learner"], r["p"]): r["value"] for r in P.percentiles(df, ["learner"], "learning_time", [5000], summary=merged).collect()}
    assert got == {(g, 5000): brute(v, 5000) for g, v in truth.items()}


def test_repeated_rows_and_empty(spark):
    df = make(spark, [("a", None, 1.0)] * 3 + [("a", None, 2.0), ("a", dt.date(2026, 1, 1), 1.0)])
    assert P.percentiles(P.unique_rows(df), ["learner"], "learning_time", [5000]).first()["n"] == 3
    empty = make(spark, [])
    assert P.percentiles(empty, ["learner", "day"], "learning_time", ASKED).count() == 0 and P.bounds(P.summarise(empty, ["learner"], "learning_time"), ["learner"], [5000]).count() == 0


def test_very_wide_intervals_are_resolved_too(spark):
    values = [10.0 ** (e - 150) for e in range(301)]
    df = make(spark, [("a", None, v) for v in values])
    got = {r["p"]: r["value"] for r in P.percentiles(df, ["learner"], "learning_time", [1, 5000, 9900], width=1e300).collect()}
    assert got == {p: brute(values, p) for p in (1, 5000, 9900)}
