"""Hybrid recall: arms, fusion, rescoring and a budget, as one plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scores
from weftline.functions.tags import visible
from weftline.functions.temporal import best_micros, overlaps, period, proximity
from weftline.functions.text import words
from weftline.operators import graph, postings, rerank, search
from weftline.operators.rows import prefix_budget, ranked, ranked_by_cuts
from weftline.plans.registry import SearchConfig, get, register


def bounds(window: tuple[datetime, datetime]) -> tuple[Column, Column]:
    low, high = (F.lit(t).cast("timestamp_ntz") for t in window)
    return low, high


def timed(units: DataFrame) -> DataFrame:
    """Units with the three times; those that are missing are null, but for the mention, which is the event's date."""
    none = F.lit(None).cast("timestamp_ntz")
    missing = {"occurred_start": none, "occurred_end": none, "mentioned_at": F.col("event_date")}
    return units.withColumns({c: v for c, v in missing.items() if c not in units.columns})


@register("retrieval", "semantic_bm25")
def semantic_bm25(units: DataFrame, query: list[float], terms: list[str], limit: int, window: tuple[datetime, datetime] | None = None, index: postings.Postings | None = None) -> DataFrame:
    """(source, id, rank) of the semantic and the lexical arm; with an index that reads its postings, and words weigh as in all it
    holds. All that is similar enough has its rank in the semantic arm, so that a match by words is helped by it from any place;
    the limit is the lexical arm's."""
    s = ranked_by_cuts(search.similar(units, query), -F.col("similarity"), [F.asc("id")])
    b = postings.bm25(index, terms, limit, keep=units) if index else search.bm25(units, terms).orderBy(F.desc(F.round("bm25", 6)), F.asc("id")).limit(limit)
    b = ranked(b.withColumn("all", F.lit(1)), ["all"], [F.desc(F.round("bm25", 6)), F.asc("id")])
    return s.select(F.lit("semantic").alias("source"), "id", "rank").union(b.select(F.lit("bm25"), "id", "rank"))


@register("retrieval", "temporal")
def temporal(units: DataFrame, query: list[float], terms: list[str], limit: int, window: tuple[datetime, datetime] | None = None, index: postings.Postings | None = None) -> DataFrame:
    """(source, id, rank) of the entry points in a time window; none without one."""
    low, high = bounds(window or (datetime.min, datetime.min))
    e = search.temporal_entries(units if window else units.limit(0), query, low, high).withColumn("proximity", F.round("proximity", 9))
    r = ranked(e.drop("rank").withColumn("all", F.lit(1)), ["all"], [F.desc("proximity"), F.desc("similarity"), F.asc("id")]).where(F.col("rank") <= limit)
    return r.select(F.lit("temporal").alias("source"), "id", "rank")


@register("graph_retrieval", "link_expansion")
def link_expansion(seeds: DataFrame, links: DataFrame, unit_entities: DataFrame | None, limit: int, use_entities: bool = True, causal: DataFrame | None = None) -> DataFrame:
    """Expansions of the seeds, merged: over shared entities (unless they are left out), semantic links, and causes (id, score), those
    of the causal links if no others are given."""
    none = seeds.select("id", F.lit(0.0).alias("score")).limit(0)
    e = graph.entity_expansion(seeds, unit_entities, limit) if use_entities else none
    c = graph.causal_expansion(seeds, links, limit) if causal is None else causal
    return graph.merge(e, graph.semantic_expansion(seeds, links, limit), c, limit)


for _name in ("rrf", "weighted", "simple"):
    register("fusion", _name)(lambda lists, how=_name: rerank.fuse(lists, how))


@register("reranking", "passthrough")
def passthrough(fused: DataFrame, query: str) -> DataFrame:
    return rerank.unranked(fused)


@register("reranking", "rrf_only")
def rrf_only(fused: DataFrame, query: str) -> DataFrame:
    return rerank.rerank_by_rank(fused)


@register("reranking", "cross_encoder")
def cross_encoder(fused: DataFrame, query: str) -> DataFrame:
    text = rerank.pair_text(F.col("text"), F.lit(""), F.col("event_date"))
    return rerank.cross_encode(fused, text, rerank.lexical_scorer(query))


@register("query_rewriting", "noop")
def noop(query: str) -> list[str]:
    return [query]


register("causal", "memory_links")(lambda seeds, links, units, k: graph.hybrid_causal(seeds, links.where("link_type <> 'semantic'"), k))
register("causal", "hybrid_causal")(lambda seeds, links, units, k: graph.hybrid_causal(seeds, links, k))
register("causal", "temporal_causal")(graph.temporal_causal)
register("causal", "session_causal")(graph.session_causal)
register("causal", "document_graph")(graph.document_causal)


@register("causal", "llm_dynamic")
def chosen_by_similarity(seeds: DataFrame, links: DataFrame, units: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """Without a model that picks, the most similar candidates over a threshold."""
    from weftline.operators.rows import top_per

    s = links.where((F.col("link_type") == "semantic") & (F.col("weight") >= threshold)).join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return top_per(s, ["from_id"], [F.desc("weight"), F.asc("to_id")], k)


#: Fixed value: neighbours of one seed that a causal strategy may name.
CAUSES_PER_SEED = 20


def causes(name: str, seeds: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """(id, score): the facts that a causal strategy reaches from the seeds, each by its strongest link. Strategies of sessions and
    documents need document_id in the units."""
    found = get("causal", name)(seeds, links, units, CAUSES_PER_SEED)
    found = found.select(F.col("to_id").alias("id"), "weight") if "to_id" in found.columns else found.select("id", F.col("similarity").alias("weight"))
    return found.join(units.select("id"), "id", "left_semi").groupBy("id").agg(F.max("weight").alias("score"))


def recall(
    units: DataFrame,
    query: str,
    vector: list[float],
    now: datetime,
    *,
    config: SearchConfig = SearchConfig(),  # noqa: B008  frozen
    limit: int = 100,
    max_tokens: int = 4096,
    candidates: int = 300,
    tags: list[str] | None = None,
    tags_match: str = "any",
    tag_groups: list | None = None,
    links: DataFrame | None = None,
    unit_entities: DataFrame | None = None,
    window: tuple[datetime, datetime] | None = None,
    index: postings.Postings | None = None,
    budget: str | None = None,
    budget_by: str = "fixed",
    use_entities: bool = True,
) -> DataFrame:
    """Facts that answer a query, best first, within a budget of tokens: id, rank, score, tokens.

    units: id, text, embedding, fact_type, tags, event_date, proof_count, and the times of what they tell where they
    are known. Filters hold in every arm. A time window, given or else named by the query, adds an arm of its entry
    points and boosts the facts inside. The candidates are the best 300 of the fusion, so the windows after it see
    few rows. A budget (low, mid, high; fixed numbers, or a share of max_tokens if budget_by is "adaptive") sets how
    many facts each arm may give in place of `limit`. With links an arm of the graph is added, whose causes come from
    the configured strategy; without entities, or where they are not to be used, it has no entity part.
    """
    limit = scores.budget(budget, max_tokens, budget_by) if budget else limit
    terms = sorted({w for q in get("query_rewriting", config.query_rewriting)(query) for w in words(q)})
    if not words(query) or max(len(words(query)), -(-len(query) // 4)) > 500:
        raise ValueError("a query has 1 to 500 tokens")
    window = window or period(query, now)
    seen = timed(units.where(visible(F.col("tags"), tags, tags_match, tag_groups)))
    lists = get("retrieval", config.retrieval)(seen, vector, terms, limit, window, index)
    if window and config.retrieval != "temporal":
        lists = lists.union(get("retrieval", "temporal")(seen, vector, terms, limit, window, index))
    if links is not None:
        seeds = search.semantic_arm(seen, vector, 20).orderBy(F.desc("similarity"), "id").limit(20).select("id")
        entities = use_entities and unit_entities is not None
        g = get("graph_retrieval", config.graph_retrieval)(seeds, links, unit_entities, limit, entities, causes(config.causal, seeds, links, seen))
        r = ranked(g.withColumn("all", F.lit(1)), ["all"], [F.desc(F.round("activation", 6)), F.asc("id")])
        lists = lists.union(r.select(F.lit("graph"), "id", "rank"))
    fused = get("fusion", config.fusion)(lists).where(F.col("rank") <= candidates)
    timely = F.lit(None).cast("double")
    if window:
        when, (low, high) = [F.col(c) for c in ("occurred_start", "occurred_end", "mentioned_at")], bounds(window)
        timely = F.when(overlaps(*when, low, high), proximity(best_micros(*when), low, high))
    rows = fused.join(seen.select("id", "text", "event_date", "proof_count", timely.alias("timely")), "id")
    scored = get("reranking", config.reranking)(rows, query)
    score = scores.combined(F.col("ce"), F.col("event_date"), F.lit(now).cast("timestamp_ntz"), F.col("timely"), F.col("proof_count"))
    best = scored.withColumn("score", F.round(score, 6)).withColumn("tokens", scores.token_estimate(F.col("text"))).withColumn("all", F.lit(1))
    order = [F.desc("score"), F.asc("id")]
    kept = prefix_budget(best, ["all"], order, F.col("tokens"), max_tokens)
    return ranked(kept.drop("rank"), ["all"], order).select("id", "rank", "score", "tokens")
