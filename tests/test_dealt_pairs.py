"""Joins whose rows outgrow their input are dealt by what they make."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from weftline.operators import links


def test_a_dense_time_is_met_in_slices(spark):
    r = random.Random(8)
    at = {i: datetime(2024, 1, 1) + timedelta(seconds=r.randrange(60) if i < 200 else r.randrange(400_000)) for i in range(300)}
    units = spark.createDataFrame([(i, i % 2, t) for i, t in at.items()] + [(900, 0, None)], "id long, p long, event_date timestamp_ntz")
    got = links.range_join(units, units, ["p"], 2, each=500)
    want = {(a, b): abs((at[a] - at[b]).total_seconds()) for a in at for b in at if a != b and a % 2 == b % 2 and abs((at[a] - at[b]).total_seconds()) <= 7200}
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == len(want) and {(x.from_id, x.to_id): x.seconds for x in rows} == want
    # Nearly all pairs are of one minute: 40 slices of a bucket share them.
    assert max(Counter(x.task for x in rows).values()) < len(rows) / 5
