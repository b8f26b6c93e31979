"""Spreading activation for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scores import BOOSTS
from weftline.functions.vector import cosine
from weftline.operators.rows import top_per
from weftline.sources.stored import written


def spread(entries: DataFrame, questions: DataFrame, edges: DataFrame, units: DataFrame, limit: int, rounds: int = 5, per_source: int = 10, decay: float = 0.7, least: float = 0.2, min_similarity: float = 0.1) -> DataFrame:
    """Breadth-first activation along weighted links: (question, id, score, hop).

    entries: (question, id); questions: (question, embedding); edges: (from_id, to_id, link_type, weight). A neighbour over
    min_similarity to its question gets max(proximity, parent x weight x boost x decay); it spreads on if that is over
    `least`. A round takes the strongest links of each source, and the first round to reach a unit fixes its score. Each
    question has room for limit - entries new units, spent in the order (score, id). Entry points start with 1.

    A round is one plan over all questions: links are cut to the strongest of each source once, so a hub adds
    per_source rows wherever it stands, and the frontier is a table of at most limit rows for each question. The driver
    learns only whether a round found anything.
    """
    boost = F.lit(1.0)
    for kind, x in BOOSTS.items():
        boost = F.when(F.col("link_type") == kind, F.lit(x)).otherwise(boost)
    strongest = top_per(edges.where("weight >= 0.1"), ["from_id"], [F.desc("weight"), F.asc("to_id")], per_source)
    strongest = written(strongest.select("from_id", "to_id", (F.col("weight") * boost * decay).alias("passes")))
    near = units.select(F.col("id").alias("to_id"), F.col("embedding").alias("vector"), F.coalesce("proximity", F.lit(0.3)).alias("near") if "proximity" in units.columns else F.lit(0.3).alias("near"))
    seen = written(entries.select("question", "id").distinct().withColumns({"score": F.lit(1.0), "hop": F.lit(0)}))
    for hop in range(1, rounds + 1):
        front = seen.where((F.col("hop") == hop - 1) & ((F.col("score") > least) | (F.col("hop") == 0)))
        reached = front.select("question", F.col("id").alias("from_id"), "score").join(strongest, "from_id")
        reached = reached.join(seen.select("question", F.col("id").alias("to_id")), ["question", "to_id"], "left_anti")
        like = reached.join(near, "to_id").join(questions.select("question", "embedding"), "question").where(cosine(F.col("vector"), F.col("embedding")) >= min_similarity)
        scored = like.groupBy("question", F.col("to_id").alias("id")).agg(F.max(F.greatest("near", F.col("score") * F.col("passes"))).alias("score"))
        best = top_per(scored, ["question"], [F.desc("score"), F.asc("id")], limit)
        used = seen.groupBy("question").agg(F.count(F.lit(1)).alias("used"))
        new = written(best.join(used, "question").where(F.col("rank") + F.col("used") <= limit).select("question", "id", "score", F.lit(hop).alias("hop")))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen
