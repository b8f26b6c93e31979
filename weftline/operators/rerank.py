"""Fusion of ranked lists and reranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scores
from weftline.functions.text import words
from weftline.operators.rows import first_seen, ranked


def fuse(lists: DataFrame, how: str = "rrf", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score, rank) from ranked lists (source, id, rank): rrf, weighted, or simple (concatenated in
    source order without repeats, where the score is the number of rows so far). Ties go by id."""
    if how == "rrf":
        f = lists.groupBy("id").agg(F.sum(scores.rrf(F.col("rank"))).alias("score"))
    elif how == "weighted":
        f = lists.groupBy("id").agg(F.sum(scores.weighted(F.col("rank"), F.col("source"), weights or scores.FUSION_WEIGHTS)).alias("score"))
    elif how == "simple":
        once = first_seen(lists, ["id"], [F.asc("source"), F.asc("rank")]).withColumn("all", F.lit(1))
        r = ranked(once, ["all"], [F.asc("source"), F.asc("rank"), F.asc("id")], "n")
        return r.select("id", F.col("n").cast("double").alias("score"), (F.col("n") - 1).alias("rank"))
    else:
        raise ValueError(f"unknown fusion {how!r}")
    return ranked(f.withColumn("all", F.lit(1)), ["all"], [F.desc(F.round("score", 9)), F.asc("id")], "rank").drop("all")


def pair_text(text: Column, context: Column, when: Column) -> Column:
    """What a cross-encoder reads: the date, the context, the text."""
    body = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit(": "), text)).otherwise(text)
    day = F.concat(F.lit("[Date: "), F.date_format(when, "MMMM dd, yyyy"), F.lit(" ("), F.date_format(when, "yyyy-MM-dd"), F.lit(")] "))
    return F.when(when.isNotNull(), F.concat(day, body)).otherwise(body)


def lexical_scorer(query: str) -> Callable[[pd.Series], pd.Series]:
    """The scorer that needs no model: the share of the query's words that a text has, as a logit. Marks part words; a null
    text has none."""
    asked = set(words(query))

    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 4.0 * len(asked & set(words(t or ""))) / max(1, len(asked)) - 2.0)

    return score


def cross_encode(df: DataFrame, text: Column, scorer: Callable[[pd.Series], pd.Series], normalised: bool = False) -> DataFrame:
    """Adds ce: the scorer's output, through a sigmoid unless it is normalised; NaN counts 0."""

    @F.pandas_udf("double")
    def run(t: pd.Series) -> pd.Series:
        return scorer(t.where(t.notna(), None)).astype(float)

    raw = F.nanvl(run(text), F.lit(0.0))
    return df.withColumn("ce", raw if normalised else scores.sigmoid(raw))


def unranked(df: DataFrame) -> DataFrame:
    """The same ce for all: what follows decides."""
    return df.withColumn("ce", F.lit(0.5))


def rerank_by_rank(df: DataFrame) -> DataFrame:
    """ce from the fused rank alone, 1 down to 0.1 for the last of the candidates, which are few."""
    return df.withColumn("ce", scores.rank_score(F.col("rank") - 1, F.count(F.lit(1)).over(Window.partitionBy())))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): how many places each row rose; a row missing from one list counts as behind its end."""
    b, a = before.select("id", F.col("rank").alias("b")), after.select("id", F.col("rank").alias("a"))
    n = F.greatest(F.lit(before.count()), F.lit(after.count())) + 1
    return b.join(a, "id", "full").select("id", (F.coalesce("b", n) - F.coalesce("a", n)).alias("change"))
