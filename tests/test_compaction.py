import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewright.operators import compaction
from gatewright.session import table

FILES = "file_id bigint, dataset_id int, written_at timestamp_ntz, n_rows int, rows_in string"
ROWS = "file_id bigint, row_no int, " + ", ".join(f"{c} {'bigint' if c == 'id' else 'int'}" for c in compaction.RECORD) + ", written_at string"


def at(minute):
    return dt.datetime(2026, 1, 1, 0, minute)


def row(file_id, id_, bits=0, dataset=1):
    return (file_id, 0, dataset, id_, *((bits >> i & 1) for i in range(12)), "clash")


def make(spark, files, rows):
    return spark.createDataFrame([(f, d, t, None, "clash") for f, d, t in files], FILES), spark.createDataFrame(rows, ROWS)


def found(journal):
    return sorted(r[0] for r in compaction.adds_nothing(journal).collect())


def test_files_that_add_nothing(spark):
    files = [(1, 1, at(5)), (2, 1, at(1)), (3, 1, at(1)), (4, 1, at(9)), (5, 1, at(8)), (6, 1, None), (7, 1, at(2)), (8, None, at(3))]
    rows = [row(2, 10), row(3, 10), row(3, 10), row(1, 11), row(1, 10), row(5, 12), row(4, 10), row(4, 11), row(4, 12), row(6, 12), row(7, 10, 1), row(8, 10, 1)]
    # 3 ties with 2 and has the higher number; 4 is held by 1, 2 and 5 together; 6 has no time
    assert found(compaction.compact(*make(spark, files, rows))) == [3, 4, 6, 8]


def test_against_brute_force(spark, sf):
    files, rows = table(spark, sf, "small_files"), table(spark, sf, "examples")
    seen, nothing = set(), []
    held = {}
    for r in rows.collect():
        held.setdefault(r["file_id"], []).append(tuple(r[c] for c in compaction.RECORD))
    for f in sorted(files.collect(), key=lambda f: (f["written_at"], f["file_id"])):
        mine = set(held.get(f["file_id"], []))
        if mine <= seen:
            nothing.append(f["file_id"])
        seen |= mine
    journal = compaction.compact(files, rows, target_bytes=200, bytes_per_row=1.0, fan_in=4)
    assert found(journal) == sorted(nothing)
    out = compaction.compacted(files, rows, journal)
    assert sorted(tuple(r[c] for c in compaction.RECORD) for r in out.collect()) == sorted(seen)
    # every kept file ends in one output, every merge has at least two inputs, all rows arrive
    merges = journal.where("output is not null and not startswith(txn, 'S-')").groupBy("output").agg({"input": "count", "rows_kept": "sum"}).collect()
    assert all(m["count(input)"] >= 2 for m in merges)
    sizes = [r["count"] for r in out.groupBy("out_file").count().collect()]
    assert len(sizes) < 0.2 * len(held) and sum(sizes) == len(seen)
    assert journal.where("level = 0").groupBy("input").count().where("count > 1").isEmpty()


def test_any_values_and_nulls(spark):
    files, rows = make(spark, [(1, 1, at(1)), (2, 1, at(2)), (3, 1, at(3)), (1, 1, at(7))], [])
    odd = [(1, 0, 1, 5, *[None] * 12, ""), (2, 0, 1, 5, *[None] * 12, ""), (3, 0, 1, 5, 7, *[None] * 11, ""), (None, 0, 1, 6, *[0] * 12, ""), (9, 0, None, None, *[1] * 12, "")]
    rows = spark.createDataFrame(odd, ROWS)
    assert found(compaction.compact(files, rows)) == [2]
    got = compaction.compacted(files, rows).select(*compaction.RECORD).collect()
    assert len(got) == 4 and (1, 5, 7, *[None] * 11) in [tuple(r) for r in got]


def test_empty(spark):
    files, rows = make(spark, [], [])
    assert compaction.compact(files, rows).isEmpty()
    files, _ = make(spark, [(4, 1, at(1))], [])
    assert found(compaction.compact(files, rows)) == [4]


def test_runs_are_incremental_and_idempotent(spark, tmp_path):
    folder = str(tmp_path / "store")
    files, rows = make(spark, [(i, 1, at(i)) for i in range(20)], [row(i, i % 15) for i in range(20)])
    first = compaction.run(spark, files, rows, folder, fan_in=4, target_bytes=8, bytes_per_row=1.0)
    assert {r[0] for r in compaction.adds_nothing(first).collect()} == set(range(15, 20))
    assert sorted(r["id"] for r in compaction.stored_records(spark, folder).collect()) == list(range(15))
    # the same again changes nothing
    assert compaction.run(spark, files, rows, folder, fan_in=4, target_bytes=8, bytes_per_row=1.0).isEmpty()
    # later files: one record is stored already, one is new
    more_files, more_rows = make(spark, [(i, 1, at(i)) for i in (*range(20), 30, 31)], [*(row(i, i % 15) for i in range(20)), row(30, 3), row(31, 99)])
    compaction.run(spark, more_files, more_rows, folder, fan_in=4, target_bytes=8, bytes_per_row=1.0)
    stored = compaction.stored_records(spark, folder)
    assert sorted(r["id"] for r in stored.collect()) == [*range(15), 99]
    assert len({r["out_file"] for r in stored.select("out_file").distinct().collect()}) <= 6


def test_plans_in_parts_are_whole_too(spark, sf):
    files, rows = table(spark, sf, "small_files"), table(spark, sf, "examples")
    one, many = (compaction.compact(files, rows, fan_in=4, target_bytes=300, bytes_per_row=1.0, plan_files=n).cache() for n in (50_000, 8))
    assert many.agg({"stage": "max"}).first()[0] > 1 == one.agg({"stage": "max"}).first()[0]
    for journal in (one, many):
        tiny = journal.where("not startswith(input, 'L')")
        assert tiny.count() == tiny.select("input").distinct().count() == files.select("file_id").distinct().count()
        ends = compaction.destinations(journal)
        assert ends.count() == tiny.where("output is not null").count()
        # rows of an output are those of its inputs, and arrive where the journal says
        made = {r["output"]: r["n"] for r in journal.where("output is not null").groupBy("output").agg(F.sum("rows_kept").alias("n")).collect()}
        assert all(made[r["input"]] == r["rows_kept"] for r in journal.where("startswith(input, 'L')").collect())
        sizes = {r["out_file"]: r["n"] for r in compaction.compacted(files, rows, journal).groupBy("out_file").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert set(sizes) == {r[0] for r in ends.select("out_file").distinct().collect()} and all(made[o] == n for o, n in sizes.items())
    assert {r[0] for r in compaction.adds_nothing(one).collect()} == {r[0] for r in compaction.adds_nothing(many).collect()}


def test_files_of_the_target_size(spark, tmp_path):
    n, folder = 40_000, tmp_path / "store"
    files = spark.range(400).selectExpr("id as file_id", "1 + cast(id % 2 as int) as dataset_id", "timestamp_ntz '2026-01-01' + make_interval(0,0,0,0,0,0,id) as written_at")
    bits = [f"cast(shiftright(xxhash64(id), {i}) & 1 as int) as {c}" for i, c in enumerate(compaction.RECORD[2:])]
    rows = spark.range(n).selectExpr("id % 400 as file_id", "1 + cast(id % 400 % 2 as int) as dataset_id", "xxhash64(id) as id", *bits)
    target = 40_000
    compaction.run(spark, files, rows, str(folder), target_bytes=target)
    sizes = sorted(p.stat().st_size for p in folder.glob("data/run=*/*/*.parquet"))
    assert len(sizes) <= 2 * sum(sizes) / target and all(target / 2 <= s <= 2.5 * target for s in sizes[2:]), sizes
    assert compaction.stored_records(spark, str(folder)).count() == n
    assert {p.parent.name for p in folder.glob("data/run=*/*/*.parquet")} == {"__gw_key=1", "__gw_key=2"}


def test_bytes_of_a_row_are_those_of_all_stored_rows(spark, tmp_path):
    # the first 60 000 rows take few bytes, all others many; and of those few are stored but once
    n, narrow, folder = 150_000, 60_000, tmp_path / "store"
    files = spark.range(200).selectExpr("id as file_id", "1 as dataset_id", "timestamp_ntz '2026-01-01' + make_interval(0,0,0,0,0,0,id) as written_at")
    values = [f"if(id < {narrow}, 0, hash(id, {i})) as {c}" for i, c in enumerate(compaction.RECORD[2:])]
    rows = spark.range(0, n, 1, 4).selectExpr("id % 200 as file_id", "1 as dataset_id", f"if(id < {narrow}, id % 5000, xxhash64(id)) as id", *values)
    target = 400_000
    compaction.run(spark, files, rows, str(folder), target_bytes=target)
    sizes = sorted(p.stat().st_size for p in folder.glob("data/run=*/*/*.parquet"))
    assert len(sizes) >= sum(sizes) / target / 2.5 and all(target / 2 <= s <= 2.5 * target for s in sizes[2:]), sizes
    assert compaction.stored_records(spark, str(folder)).count() == n - narrow + 5000
    of_all = compaction.row_bytes(compaction.contributions(files, rows))
    assert of_all == pytest.approx(sum(sizes) / (n - narrow + 5000), rel=0.2)


def test_bytes_of_a_row_do_not_hang_on_blocks(spark, monkeypatch):
    files, _ = make(spark, [(1, 1, at(1)), (2, 1, at(2))], [])
    rows = spark.range(0, 30_000, 1, 3).selectExpr("1 + id % 3 as file_id", "1 as dataset_id", "xxhash64(id) as id", *(f"cast(id >> {i} & 1 as int) as {c}" for i, c in enumerate(compaction.RECORD[2:])))
    by_file = {r["file_id"]: r for r in compaction.contributions(files, rows).collect()}
    # file 3 is not listed
    assert {f: r["rows_kept"] for f, r in by_file.items()} == {1: 10_000, 2: 10_000}
    one = [pa.RecordBatch.from_pylist([{"seq": i % 2, **{c: v for c, v in r.asDict().items() if c != "file_id"}} for i, r in enumerate(rows.limit(20_000).collect())])]
    small = [one[0].slice(i, 4000) for i in range(0, 20_000, 4000)]
    totals = []
    for batches, block in ((one, 16 << 20), (small, 16 << 20), (small, 1)):
        monkeypatch.setattr(compaction, "BLOCK_BYTES", block)
        made = pa.Table.from_batches(compaction._encoder(compaction.RECORD)(iter(batches)))
        assert made.num_rows == (10 if block == 1 else 2) and sum(made["rows_kept"].to_pylist()) == 20_000
        totals.append(sum(made["bytes_kept"].to_pylist()))
    assert totals[0] == totals[1] == pytest.approx(totals[2], rel=0.1)


@pytest.mark.parametrize("listed", [1000, 0])
def test_second_run_reads_only_its_keys(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(compaction, "LISTED_KEYS", listed)
    folder = str(tmp_path / "store")
    compaction.run(spark, *make(spark, [(i, i % 3, at(i)) for i in range(9)], [row(i, i, dataset=i % 3) for i in range(9)]), folder)
    files, rows = make(spark, [(30, 1, at(30)), (31, None, at(31))], [row(30, 1, dataset=1), row(30, 77, dataset=1), row(31, 5, dataset=None)])
    fresh = compaction._not_stored(spark, rows, folder, compaction.RECORD, "dataset_id")
    assert sorted(r["id"] for r in fresh.collect()) == [5, 77]
    if listed:
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "__gw_key" in plan.split("PartitionFilters", 1)[1].split("]")[0]
    compaction.run(spark, files, rows, folder)
    assert compaction.stored_records(spark, folder).count() == 11
    assert compaction.run(spark, files, rows, folder).isEmpty()


@pytest.mark.parametrize("fan_in", [2, 5])
def test_plan_repeats(spark, fan_in):
    files, rows = make(spark, [(i, 1 + i % 2, at(i)) for i in range(40)], [row(i, i, dataset=1 + i % 2) for i in range(40)])
    a, b = (sorted(map(str, compaction.compact(files.repartition(n), rows, fan_in=fan_in, target_bytes=16, bytes_per_row=1.0).collect())) for n in (1, 3))
    assert a == b
