"""The cache with pins: stream, batch and a plain walk over the commands agree; what a lookup may use."""

import random
from datetime import datetime, timedelta

from weftline.operators import stats
from weftline.streaming import cache

SCHEMA = "key string, seq long, kind string, command string, expires timestamp, at timestamp"
T0 = datetime(2024, 1, 1)


def micros(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def commands(n, seed):
    r, out, seq = random.Random(seed), [], 0
    for k in range(n):
        t = T0 + timedelta(seconds=r.randrange(60))
        for _ in range(r.randrange(1, 14)):
            kind = r.choice(["put", "pin", "release", "release"])
            expires = t + timedelta(seconds=r.choice([-5, 0, 10, 40, 90])) if kind == "put" and r.random() < 0.9 else None
            out.append((f"k{k}", seq, kind, None if kind == "put" else r.choice("ab"), expires, t))
            seq, t = seq + 1, t + timedelta(seconds=r.choice([0, 0, 1, 10, 40, 120]))
    return sorted(out, key=lambda x: (x[5], x[1]))


def walk(rows, until):
    """Second by second over what each key has: entry, pins, and what goes when."""
    gone = []
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        expires, there, pins = None, False, set()

        def go(at):
            nonlocal there
            if there and expires is not None and expires <= at and not pins:
                gone.append((key, micros(expires), micros(at)))  # noqa: B023
                there = False

        t = own[0][5] - timedelta(seconds=1)
        while t <= until:
            go(t)
            for _, _, kind, name, e, _ in (r for r in own if r[5] == t):
                if kind == "put":
                    there, expires = True, e
                elif kind == "pin":
                    pins.add(name)
                else:
                    pins.discard(name)
                go(t)
            t += timedelta(seconds=1)
    return sorted(gone)


def test_batch_equals_walk(spark):
    for seed in (1, 2):
        rows = commands(40, seed)
        until = rows[-1][5] + timedelta(seconds=200)
        got = sorted(map(tuple, cache.removals(spark.createDataFrame(rows, SCHEMA), str(until)).select("key", "expires", "removed_at").collect()))
        assert got == walk(rows, until) and len(got) > 20
    assert cache.removals(spark.createDataFrame([], SCHEMA), "2024-01-02").collect() == []


def test_stream_equals_batch(spark, tmp_path):
    rows = commands(40, 3)
    until = rows[-1][5] + timedelta(days=1)
    want = walk(rows, rows[-1][5] + timedelta(seconds=200))
    rows += [("z", 10**6, "pin", "a", None, until), ("z", 10**6 + 1, "release", "a", None, until + timedelta(days=1))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = [rows[k : k + 60] for k in range(0, len(rows) - 2, 60)]
    parts[-1] = [r for r in parts[-1] if r[0] != "z"]
    for k, part in enumerate([*parts, rows[-2:-1], rows[-1:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    seen = []
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = cache.removals_stream(read).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda d, i: seen.extend(d.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(200) and q.exception() is None
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.key, r.expires, r.removed_at) for r in seen) == want


def test_lookup(spark):
    t = lambda d: datetime(2024, 1, d)
    entries = spark.createDataFrame([("live", t(9)), ("old", t(1)), ("now", t(5)), ("ever", None)], "key string, expires_at timestamp_ntz")
    held = spark.createDataFrame([("old", "a", False), ("old", "b", True), ("old", "a", False), ("now", None, False)], "key string, command string, done boolean")
    asks = spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate([("live", "x"), ("old", "a"), ("old", "b"), ("old", None), ("now", "a"), ("ever", None), ("none", "a")])], "key string, command string, n int")
    got = {(r.key, r.command, r.pinned) for r in cache.lookup(asks, entries, held, "2024-01-05").collect()}
    assert got == {("live", "x", False), ("old", "a", True), ("ever", None, False)}
    purged = stats.purge_expired(entries, held.select("key", "done"), "2024-01-05", 10).collect()
    assert [r.key for r in purged] == []
    assert [r.key for r in stats.purge_expired(entries, held.where("key = 'old'").select("key", "done"), "2024-01-05", 10).collect()] == ["now"]
