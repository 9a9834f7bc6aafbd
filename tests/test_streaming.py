import datetime as dt

from gatewright.model.network import Network
from gatewright.streaming import monitor

NET = Network.of([(0, 1, 8)], 2, 1)
SCHEMA = "ts timestamp, x0 int, x1 int, y0 int"


def rows(hour, n, wrong):
    return [(dt.datetime(2026, 1, 1, hour, i % 60), 1, 1, 0 if i < wrong else 1) for i in range(n)]


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    batches = [rows(0, 10, 2), rows(1, 20, 5), rows(0, 5, 5), rows(6, 1, 0)]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = monitor.network_quality(stream, NET, at="ts", late="12 hours").writeStream.outputMode("update").format("memory").queryName("quality").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    table = monitor.network_quality(spark.createDataFrame([r for b in batches for r in b], SCHEMA), NET, at="ts")
    last = {r["start"]: r for r in spark.table("quality").orderBy("ne").collect()}
    assert {k: (r["ne"], round(r["err"], 9)) for k, r in last.items()} == {r["start"]: (r["ne"], round(r["err"], 9)) for r in table.collect()}
    assert sorted(r["ne"] for r in last.values()) == [1, 15, 20]


def test_results_counted_once(spark):
    at = dt.datetime(2026, 1, 1, 5)
    df = spark.createDataFrame([(1, "Split", at, 0.5), (1, "split", at, 0.5), (2, "SPLIT", at, 0.25), (3, "hc", at, None)], "result_id bigint, learner string, finished_at timestamp, test_err double")
    got = {r["learner"]: (r["n"], r["mean_err"]) for r in monitor.finished_tasks(df).collect()}
    assert got == {"split": (2, 0.375), "hc": (1, None)}
