"""Score arithmetic of fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.temporal import recency
from weftline.functions.vector import clamp

RRF_K = 60
FUSION_WEIGHTS = {"semantic": 0.4, "bm25": 0.2, "graph": 0.2, "temporal": 0.2}
#: Boosts of links in spreading activation.
BOOSTS = {"causes": 2.0, "caused_by": 2.0, "enables": 1.5, "prevents": 1.5}


def rrf(rank: Column) -> Column:
    return 1.0 / (F.lit(RRF_K) + rank)


def weighted(rank: Column, source: Column, weights: dict[str, float] = FUSION_WEIGHTS) -> Column:
    """Reciprocal rank times the weight of its source; unknown sources weigh 1."""
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(source == name, F.lit(x)).otherwise(w)
    return w / (F.lit(RRF_K) + rank)


def rank_score(rank0: Column, n: Column) -> Column:
    """1 down to 0.1 by rank; a single row scores 1."""
    return F.lit(1.0) - 0.9 * rank0 / F.greatest(n - 1, F.lit(1))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def proof(count: Column) -> Column:
    return F.when(count >= 1, clamp(0.5 + F.ln(count.cast("double")) / 10, 0, 1)).otherwise(F.lit(0.5))


def combined(ce: Column, when: Column, now: Column, temporal: Column, proofs: Column) -> Column:
    """The reranker's score with mild boosts for recent, timely and well-supported facts."""
    boost = lambda x, a: 1 + a * (x - 0.5)
    return ce * boost(recency(when, now), 0.2) * boost(F.coalesce(temporal, F.lit(0.5)), 0.2) * boost(proof(proofs), 0.1)


def idf_weight(fact_count: Column) -> Column:
    """How much a shared entity says: less the more facts it has."""
    return 1 / F.ln(F.lit(2.718281828) + F.greatest(fact_count, F.lit(1)))


def budget(level: str | None, max_tokens: int, how: str = "fixed") -> int:
    """How many candidates a recall may consider."""
    level = level if level in ("low", "mid", "high") else "mid"
    if how != "adaptive":
        return {"low": 100, "mid": 300, "high": 1000}[level]
    share = {"low": 0.025, "mid": 0.075, "high": 0.25}[level]
    return min(2000, max(20, round(max_tokens * share)))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


#: Token counts below each bound have its label.
TOKEN_BUCKETS = [(100, "0-100"), (500, "100-500"), (1_000, "500-1k"), (5_000, "1k-5k"), (10_000, "5k-10k"), (50_000, "10k-50k")]


def token_bucket(n: Column) -> Column:
    out = F.lit("50k+")
    for top, name in reversed(TOKEN_BUCKETS):
        out = F.when(n < top, name).otherwise(out)
    return out
