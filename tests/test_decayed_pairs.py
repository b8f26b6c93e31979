"""Pairs of a table with itself in a range of time: all of them, both ways, dealt by pairs and in few bytes."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from weftline.operators import links
from weftline.plans.queries import QUERIES

START = datetime(2024, 1, 1)


def want_of(rows):
    out = []
    for i, p, t in rows:
        for j, q, u in rows:
            if None not in (i, j, p, q, t, u) and p == q and i != j and abs(t - u) <= timedelta(hours=2):
                out.append((i, j, round(math.exp(-abs((t - u) / timedelta(microseconds=1)) / 1e6 / 86400.0), 6)))
    return sorted(out)


@pytest.mark.parametrize(("bands", "run", "each"), [(1, 256, 20_000_000), (8, 2, 20_000_000), (3, 8, 200), (8, 16, 40)])
def test_every_pair_once_each_way(spark, monkeypatch, bands, run, each):
    for name, v in (("BANDS", bands), ("RUN", run), ("TURN", 4), ("PAIRS_AT_ONCE", 100)):
        monkeypatch.setattr(links, name, v)
    r = random.Random(bands)
    rows = [(k, r.choice("ab"), START + timedelta(seconds=r.choice([0, 60, r.randrange(90), r.randrange(20_000)]), microseconds=r.choice([0, 0, 1]))) for k in range(150)]
    # The ends of the range and just over them, equal times, one id at two times, and nulls.
    rows += [(200, "c", START), (201, "c", START + timedelta(hours=2)), (202, "c", START + timedelta(hours=2, microseconds=1)), (203, "c", START), (204, "c", START + timedelta(minutes=15))]
    rows += [(7, "a", START + timedelta(seconds=45)), (300, None, START), (301, "a", None), (None, "a", START)]
    units = spark.createDataFrame(rows, "id long, p string, event_date timestamp_ntz")
    got = links.decayed_pairs(units, ["p"], 2, each=each).collect()
    assert sorted(map(tuple, got)) == want_of(rows)


@pytest.mark.parametrize(("run", "first", "last"), [(8, 0, 40), (16, 30, 90), (256, 0, 1000)])
def test_runs_are_whole_eights_but_for_ends(monkeypatch, run, first, last):
    monkeypatch.setattr(links, "RUN", run)
    monkeypatch.setattr(links, "TURN", 4)
    rng = np.random.default_rng(run)
    ta, ia = np.sort(rng.integers(0, 200, 90)), np.arange(90)
    at, lo, hi = links._runs(ta, ia, ta, ia, first, last)
    size = hi - lo
    got = [(int(i), int(j)) for i, a, z in zip(at, lo, hi, strict=True) for j in range(a, z)]
    assert len(set(got)) == len(got)
    assert set(got) == {(i, j) for i in range(90) for j in range(90) if first <= ta[j] - ta[i] <= last and (ta[j] > ta[i] or j > i)}
    whole = np.flatnonzero(size % 8)[0]
    assert not (lo[:whole] % 8).any() and (size > 0).all() and (size <= run).all() and (size[whole:] < 16).all()
    rows = [x for b in links._both_ways(ta, ia, ta, ia, at, lo, hi, 86_400.0) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(x[:2] for x in rows) == sorted([*got, *((j, i) for i, j in got)])
    n = int(size[0])
    assert [x[:2] for x in rows[n : 2 * n]] == [x[1::-1] for x in rows[:n]]


def test_no_units_make_no_pairs(spark):
    none = spark.createDataFrame([], "id long, p string, event_date timestamp_ntz")
    assert links.decayed_pairs(none, ["p"], 2).collect() == []


def test_dense_pairs_are_few_bytes_and_dealt(spark, tmp_path):
    """4,000 errors of a bank within five hours: nine million rows, which took over three bytes each."""
    r = random.Random(2)
    events = [(k, START + timedelta(microseconds=r.randrange(18_000_000_000)), 5, "error", 1.0, "{}") for k in range(4000)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    QUERIES["range_join_window"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    at = sorted((t - START) / timedelta(microseconds=1) for _, t, *_ in events)
    rows = 2 * sum(1 for k, t in enumerate(at) for u in at[k + 1 :] if u - t <= 7.2e9)
    assert got.count() == rows == got.distinct().count()
    assert sum(f.stat().st_size for f in Path(tmp_path / "out").glob("*.parquet")) < 2 * rows
