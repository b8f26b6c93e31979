"""Metrics counted by the jobs that move the rows, against the histogram of a query."""

import time

from pyspark.sql import Observation
from weftline.operators import listing
from weftline.streaming import metrics

SF = "/root/testdata/sf0.001"
BOUNDS = [1, 5, 30, 120]


def want(rows):
    return {r.upper: r.n for r in listing.histogram(rows, "value", BOUNDS).collect()}


def test_batch_in_one_job(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "if(event_id % 11 = 0, null, value) AS value")
    seen = Observation("value")
    spark.sparkContext.setJobGroup("metrics", "")
    metrics.observed(e, seen, "value", BOUNDS).write.parquet(f"{tmp_path}/out")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("metrics")) == 1
    assert metrics.histogram(seen.get, BOUNDS) == want(e)
    assert abs(seen.get["total"] - e.agg({"value": "sum"}).first()[0]) < 1e-6


def test_stream_totals(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    totals = metrics.Totals()
    spark.streams.addListener(totals)
    try:
        read = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = metrics.observed(read, "value", "value", BOUNDS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        until = time.time() + 30
        while sum(v for k, v in totals.get("value").items() if k != "total") < e.count() and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(totals)
    assert metrics.histogram(totals.get("value"), BOUNDS) == want(e)


def test_a_repeated_batch_counts_once():
    t = metrics.Totals()
    for batch, n in [(0, 5), (1, 7), (1, 7), (0, 5), (2, 1)]:
        t.add("q", batch, "m", {"n0": n, "total": None})
    t.add("other", 0, "m", {"n0": 100, "total": 2.0})
    assert t.get("m") == {"n0": 113, "total": 2.0}
    assert t.get("none") == {}
