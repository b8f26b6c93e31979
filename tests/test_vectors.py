"""The index of cells against all pairs in numpy."""

import numpy as np
import pytest
from weftline.operators import vectors

SCHEMA = "id long, embedding array<float>"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(e) for e in v]) for i, v in zip(ids, x, strict=True)], SCHEMA)


def brute(x, k, threshold, asked=None, own=False):
    ids = [i for i, v in enumerate(x) if v is not None and np.any(v)]
    u = np.array([np.asarray(x[i], np.float32).astype(float) for i in ids])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for a, i in enumerate(ids):
        if asked is not None and i not in asked:
            continue
        near = sorted((-s[a, b], j) for b, j in enumerate(ids) if (own or j != i) and s[a, b] >= threshold)[:k]
        out |= {(i, j, -d) for d, j in near}
    return out


def clustered(n, groups, dim, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((groups, dim)) * 3
    return [c[i % groups] + rng.standard_normal(dim) for i in range(n)]


def triples(rows, a="from_id", b="to_id"):
    return {(r[a], r[b], r.similarity) for r in rows}


def same(got, want):
    assert {x[:2] for x in got} == {x[:2] for x in want}
    near = {x[:2]: x[2] for x in want}
    assert all(abs(s - near[i, j]) < 2e-6 for i, j, s in got)


@pytest.mark.parametrize(("per_cell", "block"), [(256, 512), (10, 4)])
def test_exact_with_copies_ties_nulls_and_zeros(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(vectors, "PER_CELL", per_cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = clustered(120, 6, 8)
    x += [x[3]] * 40 + [[0.0] * 8, None] + [[1.0, 0, 0, 0, 0, 0, 0, 0], [2.0, 0, 0, 0, 0, 0, 0, 0], [-1.0, 0, 0, 0, 0, 0, 0, 0]]
    df = frame(spark, x)
    for k, threshold in ((3, 0.3), (5, 0.9)):
        same(triples(vectors.neighbours(df, k, threshold).collect()), brute(x, k, threshold))
    index = vectors.build(df)
    asked = df.where("id % 20 = 0")
    want = brute(x, 4, -1.0, set(range(0, len(x), 20)), own=True)
    same(triples(vectors.search(index, asked, 4).collect(), "query", "id"), want)


def test_probes_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 25)
    x = clustered(1000, 40, 16, seed=2)
    df = frame(spark, x)
    index = vectors.build(df)
    p = vectors.probes_for(index, 10, 0.95)
    assert 1 <= p < len(index.centres) // 2
    want = {t[:2] for t in brute(x, 10, -1.0, set(range(0, 1000, 20)), own=True)}
    got = {t[:2] for t in triples(vectors.search(index, df.where("id % 20 = 0"), 10, probes=p).collect(), "query", "id")}
    assert len(got & want) >= 0.9 * len(want)


def test_update_and_nothing(spark):
    x = clustered(60, 3, 8, seed=4)
    index = vectors.build(frame(spark, x[:50]))
    moved = {7: x[0], 55: x[55], 9: None}
    index = vectors.update(index, frame(spark, list(moved.values()), list(moved)), spark.createDataFrame([(1,), (99,)], "id long"))
    now = [moved.get(i, v) if i in moved else (None if i == 1 or i >= 50 else v) for i, v in enumerate(x)]
    got = vectors.search(index, frame(spark, x), 3).collect()
    live = {i for i, v in enumerate(now) if v is not None}
    assert {r.id for r in got} <= live and {r.query for r in got} == set(range(60))
    assert {r.id for r in got if r["query"] == 0 and r.similarity == 1.0} == {0, 7}
    none = frame(spark, [])
    assert vectors.neighbours(none, 3, 0.3).count() == 0
    empty = vectors.build(none)
    assert vectors.search(empty, none, 3).count() == 0 and vectors.probes_for(empty) == 1


def test_blocks_are_dealt_to_groups(spark, monkeypatch):
    """Groups of both sides meet, and no join sends a block to each cell that it is compared with."""
    monkeypatch.setattr(vectors, "PER_CELL", 10)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "GROUPS", 3)
    x = clustered(90, 5, 8, seed=9) + [[1.0] * 8] * 9
    got = vectors.neighbours(frame(spark, x), 4, 0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "q_cell" not in plan
    same(triples(got.collect()), brute(x, 4, 0.2))


def test_probing_copies_no_query_and_groups_are_bounded(spark, monkeypatch):
    """A query that reads nearly all cells travels once for each group, and what a task holds does not follow the input."""
    monkeypatch.setattr(vectors, "PER_CELL", 5)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "GROUPS", 2)
    monkeypatch.setattr(vectors, "HELD", 40 * 8)
    monkeypatch.setattr(vectors, "AT_ONCE", 16)
    x = clustered(300, 6, 8, seed=5) + [[2.0] * 8] * 3 + [[0.0] * 8, None]
    df, asked_of = frame(spark, x), set(range(0, 301, 20))
    index, asked = vectors.build(df), df.where("id % 20 = 0")
    probes = len(index.centres) - 3
    placed = []
    of = vectors._placed
    monkeypatch.setattr(vectors, "_placed", lambda units, centres, probes=1: placed.append(probes) or of(units, centres, probes))
    found = vectors.search(index, asked, 4, probes=probes)
    assert placed == [1]
    blocks = vectors._blocks(vectors._classes(index.rows, 4), "cell", "embedding", "ids")
    assert vectors._groups(blocks, 8) == 8 and blocks.agg({"n": "sum"}).first()[0] == 301
    # In numpy: the nearest cells of each query, and the best of all that are in them.
    rows = {r.id: r.cell for r in index.rows.collect()}
    unit = {i: np.asarray(x[i], np.float32).astype(float) / np.linalg.norm(np.asarray(x[i], np.float32).astype(float)) for i in rows}
    want = set()
    for q in asked_of & set(rows):
        near = set(np.argsort(-(index.centres @ unit[q]), kind="stable")[:probes])
        best = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i, cell in rows.items() if cell in near)[:4]
        want |= {(q, i, -s) for s, i in best}
    same(triples(found.collect(), "query", "id"), want)
    assert {r["query"] for r in vectors.search(index, asked, 4, probes=len(index.centres) + 1).collect()} == asked_of
