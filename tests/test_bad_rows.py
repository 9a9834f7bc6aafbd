import datetime as dt

from gatewright.operators import bad_rows

DATASETS = [(1, 2, 1), (2, 1, 1), (3, None, 1), (1, 2, 1)]
BIG = 2**63 - 1


def judged(spark, lines):
    df = spark.createDataFrame([(i, d, t, 7, "clash") for i, (d, t) in enumerate(lines)], "raw_id bigint, dataset_id int, line string, ni int, reason string")
    ds = spark.createDataFrame(DATASETS, "dataset_id int, ni int, nout int")
    rows = bad_rows.judge(df, ds).orderBy("raw_id").collect()
    return [(r["reason"], r["broken_field"]) for r in rows], bad_rows.split_rows(df, ds)


def test_reasons(spark):
    cases = {
        "1,0,1,1,lab,2026-01-02": None,
        "1,0,1,1,,": None,
        ' 1 , 0,"1" ,1, "a, ""b"" \n c" , "2026-02-28" ': None,
        f"000{BIG},0,1,1,x,": None,
        f"{BIG + 1},0,1,1,x,": ("value", "id"),
        "99999999999999999999,0,1,1,x,": ("value", "id"),
        "0,0,1,1,x,0001-12-31": None,
        "+1,0,1,1,x,": ("value", "id"),
        ",0,1,1,x,": ("value", "id"),
        "1,2,1,1,x,": ("value", "x0"),
        '1,0," 1",1,x,': ("value", "x1"),
        "1,0,1,,x,": ("value", "y0"),
        "1,0,1,1,x,2026-02-29": ("value", "day"),
        "1,0,1,1,x,2024-02-29": None,
        "1,0,1,1,x,1900-02-29": ("value", "day"),
        "1,0,1,1,x,2000-02-29": None,
        "1,0,1,1,x,0000-01-01": ("value", "day"),
        "1,0,1,1,x,2026-04-31": ("value", "day"),
        "1,0,1,1,x,2026-1-5": ("value", "day"),
        "1,0,1,1,x": ("columns", None),
        "1,0,1,1,x,,": ("columns", None),
        "": ("columns", None),
        " ": ("columns", None),
        '1,0,1,1,"x,': ("quoting", None),
        '1,0,1,1,"x"y,': ("quoting", None),
        '1,0,1,1,x"y,': ("quoting", None),
        '1,"0,1': ("quoting", None),
        "﻿1,0,1,1,x,": ("value", "id"),
        "1,0,1,1,x,2026-01-01\n": ("value", "day"),
        "1,0,1,1,x,\t": ("value", "day"),
        "١,0,1,1,x,": ("value", "id"),
    }
    got, _ = judged(spark, [(1, t) for t in cases])
    for (text, want), (reason, field) in zip(cases.items(), got):
        assert reason == (want and want[0]), text
        assert want is None or want[1] is None or field == want[1], text


def test_schemas_nulls_and_long_rows(spark):
    long_label, long_quoted = "x" * 300_000, '"' + '""a,' * 100_000 + '"'
    lines = [(2, "1,0,1,x,"), (1, "1,0,1,x,"), (9, "1,0,1,x,"), (None, "1"), (3, "1"), (1, None), (1, f"1,0,1,1,{long_label},"), (1, f"1,0,1,1,{long_quoted},"), (1, f"1,0,1,1,{long_quoted}"), (1, "," * 100_000), (1, '"' * 100_001), (2, "1,0,1,x,"), (1, "0" * 200_000 + "1,0,1,1,a,")]
    got, (good, bad) = judged(spark, lines)
    assert [r for r, _ in got] == [None, "columns", "schema", "schema", "schema", "columns", None, None, "columns", "columns", "quoting", None, None]
    assert good.count() == 5 and bad.count() == 8 and {"raw_id", "line"} <= set(bad.columns)
    assert judged(spark, [])[0] == []


def test_values_are_loaded(spark):
    _, (good, _) = judged(spark, [(1, ' 01 , 0,"1" ,1, "a, ""b"" \n c" , "2026-02-28" '), (2, "7,1,0,,")])
    a, b = good.orderBy("raw_id").collect()
    assert (a["parsed_id"], a["x"], a["y"], a["label"], a["day"]) == (1, [0, 1], [1], 'a, "b" \n c', dt.date(2026, 2, 28))
    assert (b["parsed_id"], b["x"], b["y"], b["label"], b["day"]) == (7, [1], [0], "", None)
