"""The task queue as a stream against a replay of all commands, over batches of any size."""

import random
from datetime import datetime, timedelta

import pytest
from weftline.streaming import tasks

SCHEMA = "operation_id long, seq long, kind string, worker string, seconds long, at timestamp"
T0 = datetime(2024, 1, 1)


def micros(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def commands(n, seed):
    r, out, seq = random.Random(seed), [], 0
    for op in range(n):
        t = T0 + timedelta(seconds=r.randrange(100))
        for kind in ["submit", *r.choices(["claim", "done", "failed", "defer", "cancel"], [6, 1, 4, 2, 0.4], k=r.randrange(9))]:
            out.append((op, seq, kind, r.choice(["w1", "w1", "w2"]) if kind != "submit" else None, r.choice([None, 30]) if kind == "defer" else None, t))
            seq, t = seq + 1, t + timedelta(seconds=r.choice([1, 20, 61, 130]))
    return sorted(out, key=lambda x: x[5])


def test_rules():
    def c(kind, second, worker="w", seconds=None):
        c.seq += 1
        return {"kind": kind, "at": second * 10**6, "worker": worker, "seconds": seconds, "seq": c.seq}

    c.seq = 0
    last = lambda *x: tasks.replay(list(x))
    assert last(c("claim", 0)) is None
    assert last(c("submit", 0), c("claim", 1), c("done", 2))["status"] == "completed"
    assert last(c("submit", 0), c("claim", 1), c("done", 2, "other"))["status"] == "processing"
    again = last(c("submit", 0), c("claim", 1), c("failed", 2), c("claim", 30), c("claim", 62))
    assert (again["status"], again["attempts"]) == ("processing", 2)
    assert last(c("submit", 0), *[x for k in range(3) for x in (c("claim", 1000 * k), c("failed", 1000 * k + 1))])["status"] == "failed"
    put_off = last(c("submit", 0), c("claim", 1), c("defer", 2, seconds=10))
    assert (put_off["status"], put_off["attempts"], put_off["due"]) == ("deferred", 0, 12 * 10**6)
    assert last(c("submit", 0), c("cancel", 1), c("claim", 2))["status"] == "cancelled"


@pytest.mark.parametrize("size", [40])
def test_stream_equals_replay(spark, tmp_path, size):
    rows = commands(30, 4)
    end = rows[-1][5] + timedelta(days=2)
    rows.append((10_000, 10_000, "submit", None, None, end))  # moves the watermark past every timer
    rows.append((10_001, 10_001, "submit", None, None, end + timedelta(days=1)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = [rows[k : k + size] for k in range(0, len(rows) - 2, size)] + [rows[-2:-1], rows[-1:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    seen = []
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = tasks.states(read).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda d, i: seen.extend(d.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(200) and q.exception() is None
    key = lambda s: (s["status"], s["attempts"], s["worker"], s["due"], s["at"])
    ends = {}
    for r in seen:
        ends[r.operation_id] = key(r)
    by_op = {}
    for op, seq, kind, worker, seconds, at in rows:
        by_op.setdefault(op, []).append({"kind": kind, "at": micros(at), "worker": worker, "seconds": seconds, "seq": seq})
    want = {}
    for op, cs in by_op.items():
        s = tasks.replay(cs)
        want[op] = key(tasks.wake(s, micros(end))) if s else None
    assert ends == {k: v for k, v in want.items() if v}
    replayed = {r.operation_id: key(r) for r in tasks.replayed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert replayed == {op: key(tasks.replay(cs)) for op, cs in by_op.items()}
