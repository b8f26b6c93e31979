"""Rolling medians against sorted lists, over every way that chunks, halos and lanes can fall."""

import math
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from weftline.llm import rolling

CLICKS = "click_id long, ts timestamp_ntz, kind string, value double, n string, at string"
T0 = datetime(2024, 3, 10, 1, 50)
W = timedelta(minutes=15)


def middle(v):
    return v[(len(v) - 1) // 2] + v[len(v) // 2]


def brute(rows):
    first = {}
    for i, ts, kind, value, *_ in rows:
        cents = None if value is None or not math.isfinite(value) or abs(value) >= 4e15 else math.floor(100 * value + 0.5)
        key = (ts is None, ts or T0, kind is not None, kind or "", cents is not None, cents or 0)
        if i not in first or key < first[i][0]:
            first[i] = key, (ts, kind, cents)
    series = defaultdict(list)
    for _, (ts, kind, cents) in first.values():
        if ts is not None and cents is not None:
            series[kind].append((ts, cents))
    out = []
    for i, (_, (ts, kind, cents)) in first.items():
        if ts is None:
            continue
        v = sorted(c for t, c in series[kind] if ts - W < t <= ts)
        if not v:
            out.append((i, kind, 0, None, None, None))
            continue
        m = middle(v)
        d = middle(sorted(abs(2 * c - m) for c in v))
        out.append((i, kind, len(v), m, d, None if cents is None else 2 * abs(2 * cents - m) > 2 * d))
    return sorted(out, key=str)


def test_rolls_match_sorted_windows():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n, span = rng.integers(1, 200), rng.choice([5, 50, 2000])
        at, count = np.sort(rng.integers(0, span, n)), rng.integers(1, 4, n)
        cents = rng.integers(-rng.choice([2, 10, 1000]), rng.choice([3, 50, 10**6]), n)
        asked, w = np.unique(rng.integers(0, span + 30, rng.integers(1, 60))), int(rng.choice([1, 7, 100]))
        want = []
        for t in asked:
            inside = (at > t - w) & (at <= t)
            v = np.sort(np.repeat(cents[inside], count[inside]))
            want.append((len(v), middle(v), middle(np.sort(np.abs(2 * v - middle(v))))) if len(v) else (0, 0, 0))
        assert (np.array(rolling.roll(at, cents, count, asked, w)).T == np.array(want)).all(), trial


@pytest.mark.parametrize(("chunk_rows", "slot_rows", "most"), [(8192, 1_000_000, 4_000_000), (4, 1_000_000, 100), (1, 2, 1)])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_clicks(spark, monkeypatch, chunk_rows, slot_rows, most, zone):
    """The times lie about an hour that New York's clocks leave out, and about the end of a cell."""
    monkeypatch.setattr(rolling, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(rolling, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(rolling, "MOST_COUNTS", most)
    rng = np.random.default_rng(3)
    cell_end = datetime(1970, 1, 1) + timedelta(microseconds=(1 << rolling.CELL_BITS) * (1 + 1_710_040_000_000_000 // (1 << rolling.CELL_BITS)))
    rows = []
    for i in range(500):
        start = [T0, cell_end - W, datetime(1969, 12, 31, 23, 55)][i % 3]
        ts = start + timedelta(microseconds=int(rng.choice([0, 1, 10**6])) + int(rng.integers(0, 2200)) * 10**6)
        kind = [None, "", "view", "view", "view"][int(rng.integers(0, 5))]
        rows.append((i, ts, kind, [None, 0.005, -0.005, 1.115, float(rng.integers(-50, 50)), float(rng.lognormal(3, 1))][int(rng.integers(0, 6))], "x", "y"))
    rows += [(1000 + k, T0, "tie", float(k % 4), None, None) for k in range(60)] + rows[:50]
    rows += [(2000, T0 + W, "edge", 5.0, "", ""), (2001, T0, "edge", 1.0, "", ""), (2002, T0 + timedelta(microseconds=1), "edge", 3.0, "", "")]
    rows += [(None, T0, "view", 1.0, "", ""), (None, None, "view", 2.0, "", ""), (3000, None, "view", 1.0, "", ""), (3001, T0, "odd", math.nan, "", ""), (3002, T0, "odd", math.inf, "", ""), (3003, T0, "odd", -4e15, "", "")]
    rows += [(4000, T0, "view", 9.0, "", ""), (4000, T0, None, 9.0, "", ""), (4000, None, None, 9.0, "", "")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, CLICKS)
        got = rolling.rolling_medians(df).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_no_clicks(spark):
    assert rolling.rolling_medians(spark.createDataFrame([], CLICKS)).count() == 0
    only = spark.createDataFrame([(1, T0, None, None, None, None), (2, None, "a", 1.0, None, None)], CLICKS)
    assert [tuple(r) for r in rolling.rolling_medians(only).collect()] == [(1, None, 0, None, None, None)]
