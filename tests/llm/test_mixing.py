import pytest

from gatewright.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, n_tokens string, copies int"
WEIGHTS = "source_name string, target_share double, max_repeats int"


def make(spark, docs, weights):
    return spark.createDataFrame([(i, t, s, "clash", 0) for i, t, s in docs], DOCS).repartition(3), spark.createDataFrame(weights, WEIGHTS)


def test_rates():
    got = M.rates({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1})
    assert got == {"a": 2.0, "b": pytest.approx(0.2)}
    # a capped source gives all it may, the rest goes to the others by share
    got = M.rates({"a": 100, "b": 1000, "c": 1000}, {"a": 0.6, "b": 0.2, "c": 0.2}, {"a": 1, "b": 1, "c": 1}, 1100)
    assert got == {"a": 1.0, "b": pytest.approx(0.5), "c": pytest.approx(0.5)}
    assert M.rates({"a": 10}, {"a": 1.0}, {"a": 2}, 1000) == {"a": 2.0}
    assert M.rates({}, {"a": 1.0}, {"a": 2}) == {"a": 0.0} == M.rates({"a": 5}, {"a": 0.0}, {"a": 2})


def test_shares_caps_and_counts(spark):
    words = "one two three four five six seven eight nine ten".split()
    docs = [(i, " ".join(words[: 1 + i % 10]) + ".", ["web", " WEB ", "we-b", None, "other"][i % 5] if i < 3000 else "small") for i in range(3200)]
    weights = [("web", 0.5, 1), ("small", 0.3, 4), ("We_B", 0.1, 2), ("gone", 0.1, 5)]
    drawn, report = M.mix(*make(spark, docs, weights), block_rows=100)
    rows = {r["source_name"]: r for r in report.collect()}
    assert set(rows) == {"web", "small", "we_b", "gone"} and rows["gone"]["drawn_docs"] == 0 and rows["gone"]["actual_share"] == 0
    for name, share in (("web", 0.5), ("small", 0.3), ("we_b", 0.1)):
        assert rows[name]["actual_share"] == pytest.approx(share / 0.9, abs=0.003)
        assert rows[name]["most_copies"] <= rows[name]["max_repeats"]
    got = drawn.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and sum(r["copies"] for r in got) == sum(r["drawn_docs"] for r in rows.values())
    for r in rows.values():
        # systematic: the number drawn is the expected one but for rounding
        assert abs(r["drawn_docs"] - r["rate"] * r["docs"]) < 1
    assert all(r["copies"] in (int(rows[r["source_name"]]["rate"]), int(rows[r["source_name"]]["rate"]) + 1) for r in got)
    again = M.mix(*make(spark, docs[::-1], weights), block_rows=100)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    other = M.mix(*make(spark, docs, weights), block_rows=100, seed=5)[0].collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))


def test_given_total_and_full_caps(spark):
    docs = [(i, "alpha beta gamma", "ab"[i % 2]) for i in range(200)]
    drawn, report = M.mix(*make(spark, docs, [("a", 0.9, 2), ("b", 0.1, 9)]), total_tokens=1e9)
    assert {r["source_name"]: r["copies"] for r in drawn.collect()} == {"a": 2, "b": 9} and drawn.count() == 200


def test_nulls_repeats_long_and_empty(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "word " * 60_000, "a"), (4, "x" * 50_000, "a"), (5, "hi", "a"), (5, "hi", "a"), (None, "hi", "a"), (6, "\ud800 bad".encode("utf-8", "replace").decode(), "a"), (7, "x", ""), (8, "x", None)]
    drawn, report = M.mix(*make(spark, docs, [("a", 1.0, 1), (None, 1.0, 1), ("b", None, None)]))
    assert drawn.count() == 8 and report.where("source_name = 'a'").first()["actual_share"] == 1.0
    by = {r["doc_id"]: r["n_tokens"] for r in drawn.collect()}
    assert by[1] == by[2] == 0 and by[3] >= 60_000 and by[5] == 1
    drawn, report = M.mix(*make(spark, [], [("a", 1.0, 1)]))
    assert drawn.isEmpty() and report.count() == 1
    drawn, report = M.mix(*make(spark, docs, []))
    assert drawn.isEmpty() and report.isEmpty()
