"""Hand-checkable values of the scoring and time formulae, tag truth tables, periods."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from weftline.functions import scores, tags, temporal, text
from weftline.functions.vector import cosine
from weftline.operators import activation, consolidate, entities, graph, ingest, links, rerank, search
from weftline.operators.rows import keyset_page, round_robin
from weftline.plans import registry


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: scores.rrf(F.lit(1)) + scores.rrf(F.lit(3)), 1 / 61 + 1 / 63),
        (lambda: scores.weighted(F.lit(1), F.lit("semantic")) + scores.weighted(F.lit(2), F.lit("bm25")), 0.4 / 61 + 0.2 / 62),
        (lambda: scores.weighted(F.lit(1), F.lit("other")), 1 / 61),
        (lambda: scores.rank_score(F.lit(1), F.lit(4)), 0.7),
        (lambda: scores.rank_score(F.lit(0), F.lit(1)), 1.0),
        (lambda: scores.proof(F.lit(1)), 0.5),
        (lambda: scores.proof(F.lit(150)), 1.0),
        (lambda: scores.proof(F.lit(0)), 0.5),
        (lambda: scores.proof(F.lit(None).cast("int")), 0.5),
        (lambda: scores.idf_weight(F.lit(1)), 1 / math.log(3.718281828)),
        (lambda: scores.idf_weight(F.lit(5000)), 1 / math.log(5002.718281828)),
        (lambda: temporal.link_weight(F.lit(2.0)), 1 - 2 / 24),
        (lambda: temporal.link_weight(F.lit(18.0)), 0.3),
        (lambda: temporal.decay_weight(F.lit(86_400.0)), math.exp(-1)),
        (lambda: F.tanh(F.lit(3) * 0.5), 0.9051482536448664),
        (lambda: cosine(F.array(F.lit(3.0), F.lit(4.0)), [6.0, 8.0]), 1.0),
    ],
)
def test_formula(spark, column, want):
    assert value(spark, column()) == pytest.approx(want, abs=1e-9)


def test_combined_score_and_recency(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    now = t("2024-06-01")
    assert value(spark, scores.combined(F.lit(0.5), now, now, F.lit(1.0), F.lit(None).cast("int"))) == pytest.approx(0.605)
    assert value(spark, temporal.recency(t("2023-04-28"), now)) == pytest.approx(0.1)
    assert value(spark, temporal.recency(F.lit(None).cast("timestamp_ntz"), now)) == 0.5


def test_proximity(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    low, high = t("2024-01-01"), t("2024-01-11")
    best = temporal.best_micros(t("2024-01-03 12:00:00"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))
    assert value(spark, temporal.proximity(best, low, high)) == pytest.approx(1 - 3.5 / 5 + 1 / 5)
    assert value(spark, temporal.proximity(best, low, low)) == 1.0
    assert value(spark, temporal.proximity(F.lit(None).cast("double"), low, high, 0.3)) == 0.3


@pytest.mark.parametrize(("level", "tokens", "how", "want"), [("mid", 4096, "adaptive", 307), ("mid", 8192, "adaptive", 614), ("low", 100, "adaptive", 20), ("high", 100_000, "adaptive", 2000), (None, 1, "fixed", 300), ("high", 1, "?", 1000)])
def test_budget(level, tokens, how, want):
    assert scores.budget(level, tokens, how) == want


def test_tag_modes(spark):
    rows = [(1, None), (2, []), (3, ["a"]), (4, ["b"]), (5, ["a", "b"]), (6, [None, "c"])]
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    pick = lambda c: sorted(r.id for r in df.where(c).collect())
    t = F.col("tags")
    assert pick(tags.tag_filter(t, ["a"], "any")) == [1, 2, 3, 5]
    assert pick(tags.tag_filter(t, ["a", "b"], "all")) == [1, 2, 5]
    assert pick(tags.tag_filter(t, ["a"], "any_strict")) == [3, 5]
    assert pick(tags.tag_filter(t, ["a", "b"], "all_strict")) == [5]
    assert pick(tags.tag_filter(t, [], "any_strict")) == [1, 2, 3, 4, 5, 6]
    assert pick(~tags.compile_groups(t, [tags.Tagged(("a",))])) == [1, 2, 4, 6]
    with pytest.raises(ValueError):
        tags.visible(t, ["a"], groups=[tags.Tagged(("b",))])
    with pytest.raises(ValueError):
        tags.tag_filter(t, ["a"], "some")


def test_wildcards(spark):
    df = spark.createDataFrame([(x,) for x in ("user:alice", "USER:bob", "role-admin", "env_prod", "envXprod", "100%")], "t string")
    pick = lambda p: sorted(r.t for r in df.where(text.wildcard(F.col("t"), p)).collect())
    assert pick("user:*") == ["USER:bob", "user:alice"] and pick("*-admin") == ["role-admin"]
    assert pick("env_*") == ["env_prod"] and pick("*%") == ["100%"]


def test_periods():
    now = datetime(2024, 6, 12, 15)
    day = lambda a: (a[0].date().isoformat(), a[1].date().isoformat())
    assert day(temporal.period("what did we say last week?", now)) == ("2024-06-03", "2024-06-09")
    assert day(temporal.period("last weekend", now)) == ("2024-06-08", "2024-06-09")
    assert day(temporal.period("in March 2023", now)) == ("2023-03-01", "2023-03-31")
    assert day(temporal.period("a couple of days ago", now)) == ("2024-06-09", "2024-06-11")
    assert day(temporal.period("last month", now)) == ("2024-05-01", "2024-05-31")
    for said in ("la semaine dernière", "La semana  pasada", "letzte Woche", "la settimana scorsa"):
        assert day(temporal.period(said, now)) == ("2024-06-03", "2024-06-09")
    assert day(temporal.period("el año pasado", now)) == day(temporal.period("l'année dernière", now)) == ("2023-01-01", "2023-12-31")
    assert day(temporal.period("im März 2023", now)) == day(temporal.period("marzo 2023", now)) == ("2023-03-01", "2023-03-31")
    assert day(temporal.period("in dicembre 2023", now)) == ("2023-12-01", "2023-12-31")
    assert day(temporal.period("a few weeks ago", now)) == ("2024-05-08", "2024-05-29")
    assert [day(temporal.period("last weekend", datetime(2024, 6, d)))[0] for d in range(7, 11)] == ["2024-06-01", "2024-06-01", "2024-06-08", "2024-06-08"]
    assert day(temporal.period("last month", datetime(2024, 1, 9))) == ("2023-12-01", "2023-12-31")
    assert temporal.period("anything", now) is None


def test_chunks_and_exchanges(spark):
    assert ingest.split_text("a" * 10, 4) == ["aaaa", "aaaa", "aa"]
    assert ingest.split_text("one. two. three", 9) == ["one. two.", "three"] or all(len(c) <= 9 for c in ingest.split_text("one. two. three", 9))
    long = "\n\n".join("word " * n for n in (5, 80, 3))
    parts = ingest.split_text(long, 100)
    assert all(0 < len(p) <= 100 for p in parts) and "".join(parts).replace(" ", "").replace("\n", "") == long.replace(" ", "").replace("\n", "")
    turns = '[{"a": "xxxx"}, {"a": "yyyy"}, {"a": "z"}]'
    assert len(ingest.split_conversation(turns, 20)) == 3 and ingest.split_conversation("[1") is None
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q" * 100), (1, 2, "assistant", "a" * 100), (1, 3, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [r.exchange for r in ingest.exchanges(df).orderBy("turn").collect()] == [1, 1, 1, 2]
    segs = ingest.segments(df, 80).orderBy("segment").collect()
    assert [(s["first"], s["last"], s.oversized) for s in segs] == [(1, 1, True), (2, 2, False)]


def test_trend(spark):
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    rows = [(k, d) for k, ds in {"strengthening": [1] * 10 + [50] * 5, "weakening": [1] + [50] * 5, "stable": [1] + [50] * 2, "new": [3], "stale": [40]}.items() for d in ds]
    df = spark.createDataFrame(rows, "k string, d int").withColumn("t", now - F.make_dt_interval("d"))
    assert all(r.k == r.trend for r in consolidate.trend(df, "k", F.col("t"), now).collect())


def test_jaro_winkler():
    assert entities.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert entities.jaro_winkler("", "a") == 0.0 and entities.jaro_winkler("a", "a") == 1.0


def test_entity_score_accepts_over_the_bound(spark):
    d = "timestamp_ntz'2024-01-08 00:00:00'"
    m = spark.createDataFrame([(1, "Dana"), (2, "Dana")], "mention_id long, name string").withColumn("seen", F.expr(d) + F.make_dt_interval(F.when(F.col("mention_id") == 2, 8).otherwise(0))).withColumn("nearby", F.array().cast("array<string>"))
    e = spark.createDataFrame([(7, "Dana")], "entity_id long, name string").withColumn("last_seen", F.expr(d))
    got = {r.mention_id: (r.entity_id, r.score) for r in entities.resolve(m, e).collect()}
    assert got == {1: (7, 0.7), 2: (None, None)}


def test_hub_is_capped(spark):
    ue = spark.createDataFrame([(0, 1), (0, 2)] + [(i, 2) for i in range(1, 31)], "unit_id long, entity_id long")
    got = graph.entity_expansion(spark.createDataFrame([(0,)], "id long"), ue, 100, per_entity=5)
    assert sorted(r.id for r in got.collect()) == [26, 27, 28, 29, 30]


def test_spreading(spark):
    edges = spark.createDataFrame([(1, 2, "temporal", 0.9), (1, 3, "causes", 1.0), (3, 4, "temporal", 0.1), (2, 5, "temporal", 0.05)], "from_id long, to_id long, link_type string, weight double")
    units = spark.createDataFrame([(i, [1.0, 0.0], 0.2) for i in range(1, 6)], "id long, embedding array<float>, proximity double")
    got = {r.id: (round(r.score, 4), r.hop) for r in activation.spread(spark.createDataFrame([(0, 1)], "question long, id long"), spark.createDataFrame([(0, [1.0, 0.0])], "question long, embedding array<double>"), edges, units, 10).collect()}
    assert got == {1: (1.0, 0), 2: (0.63, 1), 3: (1.4, 1), 4: (0.2, 2)}


def test_range_join_matches_all_pairs(spark):
    df = spark.createDataFrame([(i, i * 37 % 50) for i in range(40)], "id long, h int").withColumn("event_date", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), "h")).withColumn("p", F.col("id") % 2)
    h = {i: i * 37 % 50 for i in range(40)}
    want = {(a, b) for a in h for b in h if a != b and a % 2 == b % 2 and abs(h[a] - h[b]) <= 5}
    assert {(r.from_id, r.to_id) for r in links.range_join(df, df, ["p"], 5).collect()} == want


def test_pages_and_turns(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(9)], "id long, k long")
    first = [r.id for r in keyset_page(df, "k", "id", None, 4).orderBy("n").collect()]
    last = [r.id for r in keyset_page(df, "k", "id", (first[-1] // 3, first[-1]), 4).orderBy("n").collect()]
    assert first + last == [8, 7, 6, 5, 4, 3, 2, 1]
    assert [r.id for r in round_robin(df, "k", F.asc("k"), [F.asc("id")]).collect()] == [0, 3, 6, 1, 4, 7, 2, 5, 8]


def test_registry():
    import weftline.plans.recall  # noqa: F401

    assert registry.names("fusion") == ["rrf", "simple", "weighted"] and registry.names("reranking") == ["cross_encoder", "passthrough", "rrf_only"]
    assert set(registry.names("causal")) == {"memory_links", "temporal_causal", "llm_dynamic", "hybrid_causal", "session_causal", "document_graph"}
    assert registry.SearchConfig().override(fusion="simple").fusion == "simple"
    for bad in ({"fusion": "x"}, {"nothing": "rrf"}):
        with pytest.raises((ValueError, TypeError)):
            registry.SearchConfig().override(**bad)


def test_pair_text_and_unknown_fusion(spark):
    got = value(spark, rerank.pair_text(F.lit("t"), F.lit("c"), F.lit("2024-03-05").cast("timestamp_ntz")))
    assert got == "[Date: March 05, 2024 (2024-03-05)] c: t"
    with pytest.raises(ValueError):
        rerank.fuse(spark.range(1), "other")
