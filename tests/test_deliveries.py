import datetime as dt

import pytest

from gatewright.operators import deliveries

SCHEMA = "delivery_id bigint, id string, received_at timestamp_ntz, body string, n int"


def at(m):
    return dt.datetime(2026, 1, 1, 0, m)


ROWS = [
    (1, "ab", at(5), "x", 1), (2, " AB\n", at(1), "y", 1), (3, "Ab\t", at(1), "z", 1), (4, "a b", at(1), "z", 1), (5, None, at(1), "", 1), (6, "  ", at(1), "", 1), (7, None, at(1), "", 1),
    (8, "solo", None, None, None), (9, "late", None, "", 1), (10, "late", at(9), "", 1), (11, " ab", at(0), "", 1), (None, "nokey", at(1), "", 1), (12, "nokey", at(1), "", 1),
]


@pytest.mark.parametrize("hot_rows", [200_000, 1])
def test_first_copy_stays(spark, hot_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(str(r[0]) for r in deliveries.copies(df, hot_rows=hot_rows).collect()) == ["1", "3", "9", "None"]
    kept = deliveries.keep_one(df, hot_rows=hot_rows)
    assert kept.columns == df.columns
    assert sorted(r["delivery_id"] for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 10, 11, 12]


@pytest.mark.parametrize("hot_rows", [200_000, 10])
def test_hot_identifier(spark, hot_rows):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i // 2}", at((i * 7) % 60), "", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    first = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        first.setdefault(r[1], r[0])
    assert {r["delivery_id"] for r in deliveries.keep_one(df, hot_rows=hot_rows).collect()} == set(first.values())
    assert {r[0] for r in deliveries.copies(df, hot_rows=hot_rows).collect()} == {r[0] for r in rows} - set(first.values())


def test_stored_and_new(spark):
    stored, new = spark.createDataFrame(ROWS[:2], SCHEMA), spark.createDataFrame(ROWS[2:], SCHEMA).drop("n")
    assert sorted(str(r[0]) for r in deliveries.copies(new, stored).collect()) == ["1", "3", "9", "None"]
    assert deliveries.keep_one(new, stored).count() == 9


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([ROWS[0]] * 3, SCHEMA)
    for hot_rows in (200_000, 1):
        assert deliveries.keep_one(df, hot_rows=hot_rows).count() == 1 and deliveries.copies(df, hot_rows=hot_rows).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert deliveries.copies(empty).count() == 0 and deliveries.keep_one(empty).count() == 0
