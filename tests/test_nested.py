import json

import pytest
from pyspark.sql import functions as F

import brute
from gatewright.operators import nested
from gatewright.session import table

RESULTS = "result_id bigint, nout int, target_order string, extra string, rk string"


def got(spark, rows):
    return sorted(tuple(r) for r in nested.learning_features(spark.createDataFrame([(*r, "clash") for r in rows], RESULTS)).collect())


def test_whole_table_against_brute_force(spark, sf):
    results = table(spark, sf, "results")
    found = [tuple(r) for r in nested.learning_features(results).collect()]
    want = brute.learning_cases([tuple(r) for r in results.select("result_id", "nout", "target_order", "extra").collect()])
    assert len(found) == len(set(found)) and set(found) == want


def test_forms(spark):
    sets = json.dumps({"feature_sets": [[0, "x2"], None, [], [{"input": 3, "score": 0.5}]]})
    strata = json.dumps({"strata": [{"targets": [{"target": 1, "fs": [4]}, {"target": 0, "fs": None}]}, {"targets": {"target": 2, "fs": ["x5"]}}]})
    stages = json.dumps({"extra": json.dumps({"stages": [{"stage": 2, "target": 0, "feature_set": {"features": [1]}, "net": {"gates": [{"src1": 9, "src2": 9, "tf": 7}]}}, {"stage": 1, "feature_set": {"features": [6]}}]}), "v": 2})
    rows = [(1, 4, "lsb", sets), (2, 4, "msb", sets), (3, 4, "[2, 0, 1, 3]", sets), (4, 4, '["2", "0", "1", "3"]', sets), (5, 4, '[{"target": 1, "rank": 3}, {"target": 2, "rank": 0}]', sets), (6, 4, None, sets), (7, 3, None, strata), (8, 3, '"[2, 0, 1]"', json.dumps(stages))]
    assert got(spark, rows) == sorted([
        (1, 0, 0, 0), (1, 0, 0, 2), (1, 3, 3, 3), (2, 0, 3, 0), (2, 0, 3, 2), (2, 3, 0, 3), (3, 0, 2, 0), (3, 0, 2, 2), (3, 3, 3, 3), (4, 0, 2, 0), (4, 0, 2, 2), (4, 3, 3, 3),
        (5, 0, 2, 0), (5, 0, 2, 2), (5, 3, 1, 3), (7, 0, 1, 4), (7, 1, 2, 5), (8, 2, 0, 1), (8, 1, 0, 6),
    ])


def test_nulls_repeats_broken_and_long(spark):
    good = json.dumps({"feature_sets": [[1]]})
    rows = [(1, 1, "lsb", good), (1, 1, "lsb", good), (2, 1, "lsb", None), (3, 1, "lsb", ""), (4, 1, "lsb", "{broken"), (5, None, "lsb", good), (None, 1, "lsb", good), (6, 1, "LSB ", good), (7, 1, "[]", good), (8, 1, "[null]", good), (9, 1, "lsb", "[" * 100_000)]
    assert sorted(map(str, nested.learning_features(spark.createDataFrame([(*r, "") for r in rows], RESULTS)).collect())) == sorted(
        f"Row(result_id={i}, stage_no=0, target=0, feature=1)" for i in (1, None, 6)
    )
    assert got(spark, []) == []
    wide = json.dumps({"feature_sets": [list(range(5000))] * 4})
    assert len(got(spark, [(1, 4, "lsb", wide)])) == 20_000
    # two records of one result don't mix
    assert got(spark, [(1, 1, "lsb", good), (1, 1, None, json.dumps({"strata": [{"targets": {"target": 7, "fs": [2]}}]}))]) == [(1, 0, 0, 1), (1, 0, 7, 2)]


def test_intervals_are_containment(spark):
    text = json.dumps({"a": [{"b": 1, "c": [True, None]}, "s"], "d": {"e": "[1, {\"f\": 2.50}]"}})
    df = spark.createDataFrame([("r", text)], "rk string, extra string")
    nodes = nested.label(df, ["extra"]).orderBy("pre").collect()
    assert [n["type"] for n in nodes] == ["$", "$.a", "$.a[]", "$.a[].b", "$.a[].c", "$.a[].c[]", "$.a[].c[]", "$.a[]", "$.d", "$.d.e", "$.d.e[]", "$.d.e[]", "$.d.e[].f"]
    assert nodes[-1]["value"] == "2.50" and nodes[5]["value"] == "true" and nodes[6]["kind"] == "null"
    labels = [x for n in nodes for x in (n["pre"], n["post"])]
    assert sorted(labels) == list(range(2 * len(nodes)))
    for a in nodes:
        for b in nodes:
            inside = a["pre"] < b["pre"] and b["post"] < a["post"]
            assert inside == (b["type"] != a["type"] and b["type"].startswith(a["type"]) and not (a["pre"] > b["pre"] or a["post"] < b["pre"]))
    assert [n["parent"] for n in nodes] == [None, 0, 1, 2, 2, nodes[4]["pre"], nodes[4]["pre"], 1, 0, nodes[8]["pre"], nodes[9]["pre"], nodes[9]["pre"], nodes[11]["pre"]]
    tied = nested.label(df, ["extra"], containers={"item": nested.Container(r"\$\.a\[\]", ["b"])})
    assert [tuple(r) for r in tied.where("type = '$.a[].c[]'").select("item.place", "item.b").collect()] == [(0, "1"), (0, "1")]
    assert tied.where(nested.within(F.struct("pre", "post"), F.col("item"))).count() == 6
    assert nested.node_table(nested.label(df, ["extra"]), "$.a[].b").count() == 1


def test_any_depth_and_any_wrapping(spark):
    deep = "[" * 30_000 + "7" + "]" * 30_000
    value = nested._decoded(deep)
    depth = 0
    while isinstance(value, list):
        value, depth = value[0], depth + 1
    assert depth == 30_000 and value == "7"
    assert len(nested.walk(nested._decoded("[" * 3_000 + "7" + "]" * 3_000))) == 3_001
    text = json.dumps({"feature_sets": [[1]]})
    for _ in range(12):
        text = json.dumps(text)
    assert got(spark, [(1, 1, "lsb", text)]) == [(1, 0, 0, 1)]
    same = ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\"", {}], "b": {"c": []}, "a": 2}', "[]", "{}", ' [ 1 , [ ] ] ', '{"a":{"b":[{"c":"d"}]}}']
    for t in same:
        assert nested._parse_deep(t) == json.loads(t, parse_int=nested._Raw, parse_float=nested._Raw)
    for t in ("[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "[", "]", "[}", '{"a":1]', "", "[1]x", '{1:2}', "[,1]"):
        with pytest.raises(ValueError):
            nested._parse_deep(t)


def test_related_tables(spark):
    strata = json.dumps({"strata": [{"stage": 4, "targets": [{"target": 1, "fs": [4, "x5"]}, {"fs": [6]}]}, {"targets": {"target": 2, "fs": None}}]})
    sets = json.dumps({"feature_sets": [[0, "x2"], None]})
    rows = [(1, 4, "lsb", strata), (1, 4, "lsb", strata), (2, 4, "lsb", sets), (3, 4, "lsb", None)]
    tables = nested.learning_tables(spark.createDataFrame([(*r, "clash") for r in rows], RESULTS))
    s, t, f = (tables[n].alias(n[0]) for n in ("stages", "targets", "features"))
    assert sorted((r["result_id"], r["stage_no"]) for r in s.collect()) == [(1, 1), (1, 4), (2, 0), (2, 1)]
    linked = t.join(s, (F.col("s.rk") == F.col("t.rk")) & (F.col("stage_pre") == F.col("s.pre")))
    assert sorted((r["stage_no"], r["target"]) for r in linked.collect()) == [(1, 2), (4, 1)]
    linked = f.join(s, (F.col("s.rk") == F.col("f.rk")) & (F.col("stage_pre") == F.col("s.pre"))).join(t, (F.col("t.rk") == F.col("f.rk")) & (F.col("target_pre") == F.col("t.pre")), "left")
    assert sorted(((r["result_id"], r["stage_no"], r["feature"], r["target"]) for r in linked.select("s.result_id", "stage_no", "feature", "target").collect()), key=str) == sorted([(1, 4, 4, 1), (1, 4, 5, 1), (1, 4, 6, None), (2, 0, 0, None), (2, 0, 2, None)], key=str)
    # links and intervals say the same
    inside = f.join(s, (F.col("s.rk") == F.col("f.rk")) & nested.within(F.struct("f.pre", "f.post"), F.struct("s.pre", "s.post")))
    assert all(r[0] == r[1] for r in inside.select("f.stage_pre", "s.pre").collect()) and inside.count() == 5
