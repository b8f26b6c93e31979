"""Choices in rounds against plain ones, one after the other, over all events."""

import random

import pytest
from pyspark.sql import functions as F
from weftline.operators import sampling

SCHEMA = "who long, t double, value double, id long"


def apart(rows, spacing):
    taken = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1], r[3])):
        if all(abs(r[1] - o[1]) >= spacing for o in taken):
            taken.append(r)
    return taken


def plain_spaced(rows, most, spacing):
    taken = apart(rows, spacing)[:most]
    while len(taken) < min(most, len(rows)):
        rest = [r for r in rows if r not in taken]
        taken.append(min(rest, key=lambda r: (-min(abs(r[1] - o[1]) for o in taken), r[1], r[3])))
    return {r[3] for r in taken}


def plain_scenes(rows, most, slots, spacing, threshold, novelty):
    rows = sorted(rows, key=lambda r: (r[1], r[3]))
    peaks = [r for p, r, n in zip(rows, rows[1:], [*rows[2:], None], strict=False) if r[2] >= threshold and r[2] > p[2] and r[2] >= (n[2] if n else -1)]
    scenes = {r[3] for r in apart(peaks, spacing)}
    length, taken = max(rows[-1][1], 0), {}
    for i in range(slots):
        low, high = length * i / slots, length * (i + 1) / slots
        free = [r for r in rows if r[3] not in taken]
        if not free:
            break
        inside = [r for r in free if r[1] >= low and (r[1] < high or i == slots - 1)]
        if i == 0 and inside:
            r = min(inside, key=lambda r: (r[1], r[3]))
        elif i == slots - 1 and inside:
            r = min(inside, key=lambda r: (-r[1], r[3]))
        else:
            r = min(inside or free, key=lambda r: (abs(r[1] - (low + high) / 2), r[1], r[3]))
        taken[r[3]] = (r, "both" if r[3] in scenes else "coverage")
    while len(taken) < min(most, len(rows)):
        free = [r for r in rows if r[3] not in taken]
        pool = [r for r in free if r[3] in scenes] or free
        gain = lambda r: round(novelty * r[2] + (1 - novelty) * min(1, min(abs(r[1] - o[0][1]) for o in taken.values()) / max(length, 1)), 12)
        r = min(pool, key=lambda r: (-gain(r), r[1], r[3]))
        taken[r[3]] = (r, "scene")
    return {i: why for i, (_, why) in taken.items()}


def by_part(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def random_rows(seed, n, parts):
    r = random.Random(seed)
    return [(r.choice([*range(parts), None]), float(r.choice([0, 5, r.randrange(400)])), r.choice([0.0, 0.5, r.random()]), i) for i in range(n)]


@pytest.mark.parametrize("rows", [random_rows(1, 200, 6), random_rows(2, 60, 20), [(1, float(i), float(i), i) for i in range(40)]])
def test_choices(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id for r in sampling.spaced_sample(df, "who", "t", "value", "id", 5, 30.0).collect()}
    assert got == set().union(*[plain_spaced(p, 5, 30.0) for p in by_part(rows).values()])
    got = {r.id: r.reason for r in sampling.scene_sample(df, "who", "t", "value", "id", most=7, slots=3, spacing=30.0, threshold=0.4).collect()}
    want = {}
    for p in by_part(rows).values():
        want |= plain_scenes(p, 7, 3, 30.0, 0.4, 0.7)
    assert got == want


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sampling.spaced_sample(none, "who", "t", "value", "id", 5, 30.0).collect() == []
    assert sampling.scene_sample(none, "who", "t", "value", "id", most=5, slots=2, spacing=1.0, threshold=0.1).collect() == []
    nulls = spark.createDataFrame([(1, 0.0, None, 1), (1, 5.0, 1.0, 2), (1, 9.0, None, 3)], SCHEMA)
    assert {r.id for r in sampling.spaced_sample(nulls, "who", "t", "value", "id", 1, 30.0).collect()} == {2}
    assert {r.id for r in sampling.spaced_sample(nulls, "who", "t", "value", "id", 9, 0.0).collect()} == {1, 2, 3}


def test_all_events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = e.select(F.col("user_id").cast("long").alias("who"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1000).alias("t"), (F.col("value") / 100).alias("value"), F.col("event_id").cast("long").alias("id"))
    rows = [tuple(r) for r in df.collect()]
    got = {r.id: r.reason for r in sampling.scene_sample(df, "who", "t", "value", "id", most=8, slots=3, spacing=86_400_000.0, threshold=0.3).collect()}
    want = {}
    for p in by_part(rows).values():
        want |= plain_scenes(p, 8, 3, 86_400_000.0, 0.3, 0.7)
    assert got == want
    got = {r.id for r in sampling.spaced_sample(df, "who", "t", "value", "id", 5, 86_400_000.0).collect()}
    assert got == set().union(*[plain_spaced(p, 5, 86_400_000.0) for p in by_part(rows).values()])
