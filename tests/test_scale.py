"""Plans that split large parts give what one window over the part gives."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from weftline.operators import consolidate, links, search
from weftline.operators.rows import min_max, prefix_budget
from weftline.sources import files


@pytest.fixture(scope="module")
def units(spark):
    """Two thirds in one part; runs of equal times, long gaps, null times and parts."""
    r = random.Random(5)
    at = datetime(2024, 1, 1)
    rows = []
    for k in range(700):
        when = None if k % 97 == 0 else at + timedelta(minutes=r.choice([0, 1, 5, 7]) if k % 3 else r.randrange(200_000))
        rows.append((k, r.choice(["a", "a", "b", None]), when, r.choice([0, 1, 4, 9]), ["x"] if k % 5 else None))
    return spark.createDataFrame(rows, "id long, part string, event_date timestamp_ntz, cost long, tags array<string>").cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("rows", [10, 50, 400])
def test_time_in_cuts(units, rows):
    whole = links.nearest_in_time(units, 3, ["part"], 4)
    assert rows_of(links.nearest_in_time(units, 3, ["part"], 4, rows=rows)) == rows_of(whole)


def test_time_without_rows(units):
    assert links.nearest_in_time(units.limit(0), 3, ["part"]).collect() == []


@pytest.mark.parametrize("most", [0, 30, 500, 10**6])
def test_budget_in_cuts(units, most):
    whole = prefix_budget(units, ["part"], [F.asc("id")], F.col("cost"), most)
    cut = prefix_budget(units, ["part"], [F.asc("id")], F.col("cost"), most, F.floor(F.col("id") / 16))
    assert rows_of(cut.select(*whole.columns)) == rows_of(whole)


def test_batches_in_cuts(units):
    w = Window.partitionBy(F.concat_ws(",", "tags")).orderBy("event_date", "id")
    want = units.select("id", F.floor((F.row_number().over(w) - 1) / 8).cast("long").alias("batch"))
    assert rows_of(consolidate.batches(units).select("id", "batch")) == rows_of(want)


def test_min_max_of_parts(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0), (3, "a", 5.0), (4, "b", None), (5, "b", 1.0), (6, "b", 3.0)], "id long, part string, v double")
    got = {r.id: r.s for r in min_max(df, "v", "s", ["part"]).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.5, 4: None, 5: 0.0, 6: 1.0}
    assert {r.id: r.s for r in min_max(df, "v", "s", []).collect()}[3] == 1.0
    assert min_max(df.limit(0), "v", "s", ["part"]).collect() == []


def vectors(spark, n, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(n)], "id long, embedding array<float>")


def test_buckets_find_most_neighbours(spark):
    u = vectors(spark, 400)
    exact = {(r.from_id, r.to_id): r.similarity for r in search.exact_neighbours(u, 5, 0.3).collect()}
    near = {(r.query_id, r.id): r.similarity for r in search.lsh_neighbours(u, u, 5, tables=24).where("similarity >= 0.3").collect()}
    found = [p for p in exact if p in near]
    assert len(found) >= 0.9 * len(exact)
    assert all(abs(exact[p] - near[p]) <= 2e-6 for p in found)


def test_index_follows_its_units(spark):
    planes = search.hyperplanes(8, 3, 2, 7)
    old, new = vectors(spark, 20), vectors(spark, 26, seed=4).where("id >= 15")
    index = search.lsh_update(search.lsh_buckets(old, planes), planes, new, spark.createDataFrame([(3,), (16,), (99,)], "id long"))
    rebuilt = search.lsh_buckets(old.where("id < 15").union(new).where("id not in (3, 16)"), planes)
    assert rows_of(index.select("table", "bucket", "id")) == rows_of(rebuilt.select("table", "bucket", "id"))


def test_blobs(spark, tmp_path):
    root = str(tmp_path)
    files.put_blob(spark, root, "a/b.txt", b"one")
    where = files.put_blob(spark, root, "a/b.txt", bytes(range(256)))
    assert where.endswith("/a/b.txt") and (tmp_path / "a" / "b.txt").read_bytes() == bytes(range(256))
    assert files.has_blob(spark, root, "a/b.txt") and not files.has_blob(spark, root, "a/c.txt")
    assert files.drop_blob(spark, root, "a/b.txt") and not files.drop_blob(spark, root, "a/b.txt")
    with pytest.raises(ValueError):
        files.put_blob(spark, root, "../b.txt", b"")


def test_neighbours_without_threshold_leave_k_rows_for_a_block(spark):
    """All pairs of 300 units are over a threshold of -1: few of them become rows, and the answer is that of numpy."""
    x = np.random.default_rng(3).standard_normal((300, 8)).astype("float32")
    u = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "id long, embedding array<float>")
    q = u.where("id % 20 = 0")
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(n @ n.T, 6)
    want = {(i, j) for i in range(0, 300, 20) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:4]}
    assert {(r.from_id, r.to_id) for r in search.exact_neighbours(u, 4, -1.0, block=64, queries=q).collect()} == want
    # Two planes of ten tables: nearly every pair shares a bucket, in pieces of 70 units.
    near = {(r.query_id, r.id) for r in search.lsh_neighbours(u, q, 4, bits=1, tables=40, rows=70).collect()}
    assert len(near) == len(want) and len(near & want) >= 0.95 * len(want)
