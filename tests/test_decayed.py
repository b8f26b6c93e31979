"""Neighbours by decayed weight: against all pairs, with copies, ties by rounding, edges of cuts; and their work in dense times."""

import math
import random
from datetime import datetime, timedelta

import pytest
from weftline.operators import links

SCHEMA = "id long, event_date timestamp_ntz, p string"
START = datetime(2024, 1, 1)


def brute(units, seeds, hours, k):
    out = set()
    for i, t, p in seeds:
        if t is None or p is None:
            continue
        near = [(-round(math.exp(-abs((t - u).total_seconds()) / 86400), 6), j) for j, u, q in units if u is not None and q == p and j != i and abs((t - u).total_seconds()) <= hours * 3600]
        out |= {(i, j, -w, r + 1) for r, (w, j) in enumerate(sorted(near)[:k])}
    return out


@pytest.mark.parametrize(("rows", "hours"), [(1_000_000, 24), (40, 24), (7, 3), (1, 1)])
def test_against_all_pairs(spark, rows, hours):
    r = random.Random(rows)
    times = [START + timedelta(microseconds=int(r.random() ** 3 * 9 * 86_400_000_000)) for _ in range(150)]
    times += [times[0]] * 20 + [times[1] + timedelta(milliseconds=7 * i) for i in range(40)]
    units = [(i, t, r.choice("aab")) for i, t in enumerate(times)] + [(900, None, "a"), (901, START, None)]
    seeds = units[::3] + [(999, START + timedelta(days=4), "b"), (998, START, "none")]
    got = links.decayed_neighbours(spark.createDataFrame(units, SCHEMA), spark.createDataFrame(seeds, SCHEMA), ["p"], hours, 4, rows=rows)
    assert {(x.from_id, x.to_id, x.weight, x["rank"]) for x in got.collect()} == brute(units, seeds, hours, 4)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert links.decayed_neighbours(none, none, ["p"]).count() == 0


def test_pairs_of_a_dense_day_are_not_all_made(spark, monkeypatch):
    """20000 units of one day have 4e8 pairs; a join of ranges would make them all."""
    monkeypatch.setattr(links, "range_join", None)
    u = spark.range(20_000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 4) as event_date", "'x' as p")
    got = links.decayed_neighbours(u, u, ["p"], k=2).where("from_id = 10000").collect()
    assert {r.to_id for r in got} == {9999, 10001}
