"""Recall with every causal strategy, with and without entities, and with budgets."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from weftline.functions import scores
from weftline.operators.rows import ranked_by_cuts
from weftline.plans import recall as plan
from weftline.plans.registry import SearchConfig, names

NOW = datetime(2024, 1, 9)


@pytest.fixture(scope="module")
def world(spark):
    units = [(i, f"fact number {i}", [1.0, float(i)], "world", None, datetime(2024, 1, 1, i), 1, i // 3) for i in range(9)]
    u = spark.createDataFrame(units, "id long, text string, embedding array<float>, fact_type string, tags array<string>, event_date timestamp_ntz, proof_count int, document_id long")
    rows = [(0, 4, "causes", 0.9), (0, 5, "semantic", 0.8), (0, 6, "semantic", 0.45), (0, 1, "semantic", 0.4), (3, 0, "temporal", 0.2), (0, 99, "causes", 1.0)]
    links = spark.createDataFrame(rows, "from_id long, to_id long, link_type string, weight double")
    entities = spark.createDataFrame([(0, 1), (8, 1)], "unit_id long, entity_id long")
    return u, links, entities


@pytest.mark.parametrize(("name", "want"), [("memory_links", {4}), ("hybrid_causal", {4}), ("llm_dynamic", {5}), ("temporal_causal", {3}), ("session_causal", {1, 5, 6}), ("document_graph", {1})])
def test_causes(spark, world, name, want):
    u, links, entities = world
    seeds = u.where("id = 0").select("id")
    assert {r.id for r in plan.causes(name, seeds, links, u).collect()} == want
    got = plan.recall(u, "nothing known", [1.0, 0.0], NOW, config=SearchConfig(causal=name), links=links, unit_entities=entities, limit=1)
    reached = {r.id for r in got.collect()}
    assert reached and set(names("causal")) >= {name}


def test_entity_part_can_be_left_out(spark, world):
    u, links, entities = world
    none = links.limit(0)
    arm = lambda **how: {r.id for r in plan.recall(u, "nothing known", [1.0, 0.0], NOW, links=none, limit=9, **how).collect()}
    semantic = {r.id for r in plan.recall(u, "nothing known", [1.0, 0.0], NOW, limit=9).collect()}
    assert arm(unit_entities=entities) == semantic | {8}
    assert arm(unit_entities=entities, use_entities=False) == arm() == semantic


def test_budgets(spark, world):
    assert [scores.budget(b, 4096) for b in ("low", "mid", "high", None, "bad")] == [100, 300, 1000, 300, 300]
    assert [scores.budget(b, 4000, "adaptive") for b in ("low", "mid", "high")] == [100, 300, 1000]
    assert scores.budget("low", 10, "adaptive") == 20 and scores.budget("high", 10**6, "adaptive") == 2000
    assert scores.budget("low", 4000, "no such rule") == 100
    u, _, _ = world
    assert plan.recall(u, "fact", [1.0, 0.0], NOW, budget="low").count() > 0


def test_similar_facts_have_no_cap_by_type(spark, world):
    """Four facts of one type are over the threshold, more than the limit of the other arms."""
    u, _, _ = world
    assert {r.id for r in plan.recall(u, "nothing known", [1.0, 0.0], NOW, limit=2).collect()} == {0, 1, 2, 3}


def test_ranks_by_cuts_are_those_of_one_window(spark):
    rows = spark.range(200).selectExpr("id", "cast(id * 7 % 5 as double) as similarity")
    got = [(r.id, r["rank"]) for r in ranked_by_cuts(rows, -F.col("similarity"), [F.asc("id")]).orderBy("rank").collect()]
    want = sorted(range(200), key=lambda i: (-(i * 7 % 5), i))
    assert got == [(i, n + 1) for n, i in enumerate(want)]
