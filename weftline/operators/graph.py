"""Expansion over entities, links and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scores import idf_weight
from weftline.operators.rows import dealt, top_per
from weftline.sources.stored import written

CAUSAL = ("causes", "caused_by", "enables", "prevents")


def entity_expansion(seeds: DataFrame, unit_entities: DataFrame, limit: int, per_entity: int = 200, fact_counts: DataFrame | None = None, max_facts: int = 5000) -> DataFrame:
    """Units that share entities with the seeds: (id, score). The newest units of each entity count (by id),
    up to per_entity, so a hub never multiplies. Scores: shared entities, or with fact_counts(entity_id,
    fact_count) the sum of their weights, entities with too many facts left out."""
    ids = seeds.select(F.col("id").alias("unit_id"))
    named = unit_entities.join(ids, "unit_id", "left_semi").select("entity_id").distinct()
    if fact_counts is not None:
        named = named.join(fact_counts.where(F.col("fact_count") <= max_facts), "entity_id")
    others = unit_entities.join(named, "entity_id").join(ids, "unit_id", "left_anti")
    capped = top_per(others, ["entity_id"], [F.desc("unit_id")], per_entity)
    score = F.count_distinct("entity_id") if fact_counts is None else F.sum(idf_weight(F.col("fact_count")))
    found = capped.groupBy(F.col("unit_id").alias("id")).agg(score.cast("double").alias("score"))
    return found.orderBy(F.desc(F.round("score", 6)), F.asc("id")).limit(limit)


def semantic_expansion(seeds: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """Neighbours of the seeds over semantic links in either direction, the heaviest link counts."""
    ids = seeds.select(F.col("id").alias("seed"))
    s = links.where("link_type = 'semantic'")
    both = s.select(F.col("from_id").alias("seed"), F.col("to_id").alias("id"), "weight").union(s.select("to_id", "from_id", "weight"))
    near = both.join(ids, "seed", "left_semi").join(seeds.select("id"), "id", "left_anti")
    return near.groupBy("id").agg(F.max("weight").alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(limit)


def causal_expansion(seeds: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """Targets of the seeds' causal links, each with its best link; seeds may be among them."""
    s = links.where(F.col("link_type").isin(*CAUSAL)).join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    best = top_per(s, ["to_id"], [F.desc("weight"), F.asc("link_type"), F.asc("from_id")], 1)
    return best.select(F.col("to_id").alias("id"), F.col("weight").alias("score"), "link_type").orderBy("id").limit(limit)


def observation_expansion(seeds: DataFrame, observations: DataFrame, unit_entities: DataFrame, limit: int, per_entity: int = 200) -> DataFrame:
    """Observations whose sources share an entity with the sources of the seed observations; the score is
    how many of their sources do. observations: (id, source_ids)."""
    mine = observations.join(seeds.select("id"), "id", "left_semi")
    src = mine.select(F.explode("source_ids").alias("unit_id")).distinct()
    ents = unit_entities.join(src, "unit_id", "left_semi").select("entity_id").distinct()
    reach = unit_entities.join(ents, "entity_id", "left_semi").join(src, "unit_id", "left_anti")
    connected = top_per(reach, ["entity_id"], [F.desc("unit_id")], per_entity).select("unit_id").distinct()
    flat = observations.join(seeds.select("id"), "id", "left_anti").select("id", F.explode(F.array_distinct("source_ids")).alias("unit_id"))
    hits = flat.join(connected, "unit_id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return hits.orderBy(F.desc("score"), F.asc("id")).limit(limit)


def merge(entity: DataFrame, semantic: DataFrame, causal: DataFrame, limit: int) -> DataFrame:
    """tanh(half the entity score) + best semantic + best causal, strongest first."""
    parts = [x.select("id", *[F.col("score").alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in ("entity", "semantic", "causal")]) for name, x in (("entity", entity), ("semantic", semantic), ("causal", causal))]
    every = parts[0].union(parts[1]).union(parts[2]).groupBy("id").agg(*[F.max(n).alias(n) for n in ("entity", "semantic", "causal")])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = zero(F.tanh(F.col("entity") * 0.5)) + zero(F.col("semantic")) + zero(F.col("causal"))
    return every.withColumn("activation", total).orderBy(F.desc(F.round("activation", 6)), F.asc("id")).limit(limit)


def hybrid_causal(seeds: DataFrame, links: DataFrame, per_seed: int, fallback_weight: float = 0.5) -> DataFrame:
    """Causal neighbours of each seed; for seeds without any, semantic ones at half weight."""
    out = links.join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    causal = out.where(F.col("link_type").isin(*CAUSAL))
    rest = out.where("link_type = 'semantic'").join(causal.select("from_id").distinct(), "from_id", "left_anti").withColumn("weight", F.col("weight") * fallback_weight)
    return top_per(causal.unionByName(rest), ["from_id"], [F.desc("weight"), F.asc("to_id"), F.asc("link_type")], per_seed)


def temporal_causal(seeds: DataFrame, links: DataFrame, units: DataFrame, per_seed: int, each: int = 1_000_000) -> DataFrame:
    """Neighbours over temporal links in either direction; weight: the larger of the link's and the closeness. A task
    holds about `each` links."""
    from weftline.functions.temporal import hours_between

    t = written(links.where("link_type = 'temporal'").select("from_id", "to_id", "weight"))
    rows = 2 * t.count()
    ways = F.explode(F.array(F.struct("from_id", "to_id", "weight"), F.struct(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "weight")))
    both = dealt(t.select(ways.alias("x")).select("x.*"), rows, ["from_id"], each).join(dealt(seeds.select(F.col("id").alias("from_id")), rows, ["from_id"], each), "from_id", "left_semi")
    both = both.groupBy("from_id", "to_id").agg(F.max("weight").alias("weight"))
    when = lambda end, out: dealt(units.select(F.col("id").alias(end), F.col("event_date").alias(out)), rows, [end], each)
    dated = dealt(both.join(when("from_id", "a"), "from_id"), rows, ["to_id"], each).join(when("to_id", "b"), "to_id")
    h = hours_between(F.col("a"), F.col("b"))
    near = F.when(h <= 24, F.greatest(F.lit(0.3), 1 - h / 24)).otherwise(0.0)
    out = dated.select("from_id", "to_id", F.round(F.greatest("weight", near), 6).alias("weight"))
    return top_per(dealt(out, rows, ["from_id"], each), ["from_id"], [F.desc("weight"), F.asc("to_id")], per_seed)


def session_causal(seeds: DataFrame, links: DataFrame, units: DataFrame, limit: int, threshold: float = 0.3) -> DataFrame:
    """Semantic links with an end in a seed's document: the other ends, with their best similarity."""
    docs = units.join(seeds.select("id"), "id", "left_semi").select("document_id").distinct()
    members = units.join(docs, "document_id", "left_semi").select("id")
    s = links.where((F.col("link_type") == "semantic") & (F.col("weight") >= threshold))
    both = s.select("from_id", "to_id", "weight").union(s.select("to_id", "from_id", "weight"))
    near = both.join(members.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(seeds.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return near.groupBy(F.col("to_id").alias("id")).agg(F.max("weight").alias("similarity")).orderBy(F.desc("similarity"), F.asc("id")).limit(limit)


def document_causal(seeds: DataFrame, links: DataFrame, units: DataFrame, per_seed: int, threshold: float = 0.3) -> DataFrame:
    """Later units of a seed's own document over semantic links, a little discounted."""
    u = units.select("id", "document_id", "event_date")
    s = links.where((F.col("link_type") == "semantic") & (F.col("weight") >= threshold)).join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    pair = s.join(u.withColumnsRenamed({"id": "from_id", "document_id": "d1", "event_date": "t1"}), "from_id").join(u.withColumnsRenamed({"id": "to_id", "document_id": "d2", "event_date": "t2"}), "to_id")
    later = pair.where("d1 = d2 and t2 > t1").withColumn("weight", F.round(F.col("weight") * F.lit(0.95), 6))
    return top_per(later.select("from_id", "to_id", "weight"), ["from_id"], [F.desc("weight"), F.asc("to_id")], per_seed)


def fact_counts(unit_entities: DataFrame) -> DataFrame:
    return unit_entities.groupBy("entity_id").agg(F.count_distinct("unit_id").alias("fact_count"))


def cooccurrence(unit_entities: DataFrame, dates: DataFrame | None = None, each: int = 1_000_000) -> DataFrame:
    """(e1, e2, n): unordered pairs of entities and the units that hold both; with dates(unit_id, event_date)
    also when last. Pairs form inside one unit, whose entities are few. A task holds about `each` rows or pairs."""
    stored = written(unit_entities.select("unit_id", "entity_id"))
    rows = stored.count()
    u = dealt(stored, rows, ["unit_id"], each)
    a = u if dates is None else u.join(dealt(dates, rows, ["unit_id"], each), "unit_id", "left")
    date = [] if dates is None else ["event_date"]
    pairs = a.alias("a").join(u.alias("b"), F.expr("a.unit_id = b.unit_id and a.entity_id < b.entity_id"))
    pairs = pairs.select(F.col("a.entity_id").alias("e1"), F.col("b.entity_id").alias("e2"), *date)
    return dealt(pairs, 2 * rows, ["e1", "e2"], each).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"), *[F.max(d).alias("last") for d in date])


def entity_graph(pairs: DataFrame, least: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the strongest co-occurrences."""
    edges = pairs.where(F.col("n") >= least).orderBy(F.desc("n"), "e1", "e2").limit(limit)
    nodes = edges.select(F.col("e1").alias("entity_id")).union(edges.select("e2")).distinct()
    return nodes, edges
