import json

import brute
from gatewright.operators import drift
from gatewright.session import table

LINES = "log_file_id bigint, line_no int, line string"
FILES = "log_file_id bigint, stream_id bigint, seq int"


def cases(spark, lines, files):
    versioned = drift.versions(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES))
    return {tuple(r) for r in drift.report(drift.migrations(versioned)).collect()}


def test_whole_table_against_brute_force(spark, sf):
    lines, files = table(spark, sf, "record_lines"), table(spark, sf, "record_files")
    got = [tuple(r) for r in drift.report(drift.migrations(drift.versions(lines, files))).collect()]
    want = brute.drift_cases([(r[0], r[1]) for r in lines.select("log_file_id", "line").collect()], [tuple(r) for r in files.select("log_file_id", "stream_id", "seq").collect()])
    assert len(got) == len(set(got)) and set(got) == want


def test_kinds_of_change(spark):
    text = lambda **k: json.dumps(k)
    files = [(1, 1, 5), (2, 1, 9), (3, 1, 12), (4, 2, 1), (5, 2, 2), (6, 3, 1)]
    lines = [
        (1, 0, text(id=1, a=1.5, b="x", c=[1], d=True)), (1, 1, text(id=2, a=None)),
        (2, 0, text(id=1, z=2.5, b="y", c=[1, 2.5], d=True)),  # a -> z, c retyped
        (3, 0, text(id="1", z=2, b={"q": [1]}, d=True, e=[], f=[])), (3, 0, text(id=7, z=2)),  # id, z, b retyped; c removed; e, f added
        (4, 0, text(p=1, q=1)), (5, 0, text(r=1, s=1)),  # two of a type go, two come: no rename
        (6, 0, text(only=1)),
    ]
    got = cases(spark, lines, files)
    assert got == {
        (2, "a", "renamed"), (2, "c", "retyped"), (3, "id", "retyped"), (3, "z", "retyped"), (3, "b", "retyped"), (3, "c", "removed"), (3, "e", "added"), (3, "f", "added"),
        (5, "p", "removed"), (5, "q", "removed"), (5, "r", "added"), (5, "s", "added"),
    }


def test_types():
    read = lambda t: drift.json_type(json.loads(t, parse_int=len))
    assert [read(t) for t in ("true", "1", "12345678901234567890123", "1.0", "1e3", '"a"', "{}", "[]", "[1, null, [2.5]]", "null")] == [
        "boolean", "integer", "integer", "decimal", "decimal", "string", "object", "array<>", "array<array<decimal>,integer>", None,
    ]


def test_nulls_repeats_and_bad_lines(spark):
    good = json.dumps({"a": 1})
    files = [(1, 1, 1), (1, 1, 1), (2, 1, 2), (None, 1, 3), (3, None, 1), (4, 1, None), (5, 1, 7)]
    lines = [(1, 0, good), (1, 0, good), (2, 0, None), (2, 1, ""), (2, 2, "{broken"), (2, 3, "[1]"), (2, 4, '{"a": NaN}'), (2, 5, good), (None, 0, good), (3, 0, good), (4, 0, good), (9, 0, good), (2, 6, "[" * 50_000)]
    assert cases(spark, lines, files) == {(5, "a", "removed")}  # a file without lines has no fields
    assert cases(spark, [], []) == set() and cases(spark, lines, []) == set()
    long = json.dumps({"a": 1, "text": "x" * 300_000, "\ud800": 1})
    assert {c[1:] for c in cases(spark, [(1, 0, good), (2, 0, long)], [(1, 1, 1), (2, 1, 2)])} == {("text", "added"), ("?", "added")}


def test_order_over_many_blocks(spark):
    files = [(i, 1, 15_000 * (i // 3) + i) for i in range(30)]
    lines = [(i, 0, json.dumps({f"k{i // 5}": 1})) for i in range(30)]
    got = cases(spark, lines, files)
    assert got == {(i, f"k{i // 5 - 1}", "renamed") for i in range(5, 30, 5)}


def unified(spark, files, lines, fields=drift.RECORD_FIELDS):
    files, lines = spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)
    versioned = drift.versions(lines, files)
    routed = drift.routes(versioned, drift.migrations(versioned), fields)
    got = drift.unify(lines, routed, fields)
    return routed, drift.applied(routed, versioned, fields), got


def text(**k):
    return json.dumps(k)


FIELDS = [drift.Field("id", "bigint", "integer"), drift.Field("setup_time", "double", "decimal", drift._seconds), drift.Field("trg_err", "double", "decimal"), drift.Field("learner", "string", "string", None, "unknown")]


def test_unified_table(spark):
    files = [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    lines = [
        (1, 1, text(id=1, setup_time=1.5, target_order=[1, 0], extra={"a": 1})), (2, 1, text(id=2, setupTime=0.5, target_order="1,0", extra={"a": 1}, more=True)), (3, 1, text(id=3, setupTime="2.5 s", target_order=["1", "0"], extra=None)),
        (3, 2, text(id=4, setupTime={"value": 0.25, "unit": "s"}, target_order="MSB")), (3, 3, text(id=5, setupTime=750)), (3, 4, "no json"), (3, 5, None),
    ]
    routed, _, got = unified(spark, files, lines)
    assert {(r["file_id"], r["field"], r["target"]) for r in routed.where("target = 'setup_time'").collect()} == {(1, "setup_time", "setup_time"), (2, "setupTime", "setup_time"), (3, "setupTime", "setup_time")}
    rows = {(r["log_file_id"], r["line_no"]): r for r in got.collect()}
    assert [rows[k]["setup_time"] for k in sorted(rows)] == [1.5, 0.5, 2.5, 0.25, 750.0, None, None]
    assert [rows[k]["target_order"] for k in sorted(rows)] == ["[1,0]", "[1,0]", "[1,0]", "msb", None, None, None]
    assert rows[2, 1]["others"] == {"more": "true"} and rows[1, 1]["extra"] == '{"a":1}' and len(rows) == 7
    assert [tuple(r) for r in drift.leftovers(got).collect()] == [(3, 4, None, "unparsed", "no json")]


def test_no_value_is_lost(spark):
    files = [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    lines = [
        (1, 1, text(id=1, setup_time=1.5, trg_err=0.5)), (2, 1, text(id=2, setupTime=2.5, trg_err="n/a")), (3, 1, text(id=3, st=9.25, trg_err=0.5)),
        (9, 1, '{"setup_time": 1.5, "st": 9.25}'), (9, 2, text(id="about 2", setup_time="about 2 s", learner="split")), (9, 3, text(setup_time={"value": 3, "unit": "h"})), (9, 4, '{"id": 1, "id": 2}'),
    ]
    _, _, got = unified(spark, [*files, (9, 1, 9)], lines[:3] + [(9, 1, text(id=4, setup_time=1.5, trg_err=0.5)), (9, 2, text(id=5, st=9.25, trg_err=0.5))], FIELDS)
    # setup_time and st meet in file 9, but their chain runs over setupTime
    rows = {(r["log_file_id"], r["line_no"]): r for r in got.collect()}
    assert [rows[k]["setup_time"] for k in sorted(rows)] == [1.5, 2.5, 9.25, 1.5, 9.25]
    assert rows[2, 1]["trg_err"] is None and rows[2, 1]["others"] == {"trg_err": "n/a"} and rows[1, 1]["learner"] == "unknown"
    _, _, got = unified(spark, [*files, (9, 1, 9)], lines, FIELDS)
    rows = {(r["log_file_id"], r["line_no"]): r for r in got.collect()}
    assert rows[9, 1]["setup_time"] == 1.5 and rows[9, 1]["others"] == {"st": "9.25"}
    assert rows[9, 2]["others"] == {"id": "about 2", "setup_time": "about 2 s"} and rows[9, 2]["learner"] == "split" and rows[9, 4]["id"] == 2
    assert {tuple(r) for r in drift.leftovers(got).collect()} == {
        (2, 1, "trg_err", "uncast", "n/a"), (9, 1, "st", "unused", "9.25"), (9, 2, "id", "uncast", "about 2"), (9, 2, "setup_time", "uncast", "about 2 s"), (9, 3, "setup_time", "uncast", '{"value":3,"unit":"h"}'),
    }


def test_streams_keep_their_own_names(spark):
    whole = dict(id=1, trg_err=0.5, learner="split")
    files = [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 1), (5, 4, 1), (6, 4, 2)]
    lines = [
        (1, 1, text(**whole, setup_time=1.5)), (2, 1, text(**whole, st=2.5)),  # the rename
        (3, 1, text(id=3, st=7.5, colour="red")),  # another kind of record with a field st of its own
        (4, 1, text(**whole, st=3.5)),  # the same kind, in a stream that never renamed it
        (5, 1, text(**whole, begin=4.5)), (6, 1, text(**whole, start=5.5)),  # renamed, but not from or to a target
        (7, 1, text(id=7, st=1.5, setup_time=2.5)),  # a file of no stream is read by the target names
    ]
    routed, done, got = unified(spark, files, lines, FIELDS)
    rows = {r["log_file_id"]: (r["setup_time"], r["others"]) for r in got.collect()}
    assert rows == {1: (1.5, {}), 2: (2.5, {}), 3: (None, {"st": "7.5", "colour": "red"}), 4: (3.5, {}), 5: (None, {"begin": "4.5"}), 6: (None, {"start": "5.5"}), 7: (2.5, {"st": "1.5"})}
    assert {tuple(r) for r in done.where("log_file_id in (2, 3, 4)").collect()} == {
        (2, "st", "setup_time", "rename"), (4, "st", "setup_time", "rename"), (3, None, "setup_time", "default"), (3, None, "trg_err", "default"), (3, None, "learner", "default"),
    }


def test_chance_renames_make_no_rule(spark):
    files = [(1, 1, 1), (2, 1, 2), (3, 2, 1)]
    lines = [(1, 1, text(setup_time=1.5)), (2, 1, text(noise=0.5)), (3, 1, text(setup_time=1.5, noise=0.5))]
    routed, _, got = unified(spark, files, lines)
    assert {(r["file_id"], r["field"]) for r in routed.collect()} == {(1, "setup_time"), (3, "setup_time")}
    assert drift.leftovers(got).isEmpty()
    routed, done, got = unified(spark, [], [])
    assert got.isEmpty() and done.isEmpty()
