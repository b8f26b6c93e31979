"""Observations over facts: batches, scopes, inheritance, trends, cascades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.tags import tag_filter
from weftline.operators.rows import join_same, ranked, starts_of


def batches(units: DataFrame, size: int = 8) -> DataFrame:
    """Units with tag_key and batch: in time order, only units of exactly equal tags go together.

    Places are counted within days, and days by their totals, so that units of one tag spread over many tasks.
    """
    key = F.concat_ws(",", F.sort_array(F.coalesce("tags", F.array().cast("array<string>"))))
    keyed = units.withColumn("tag_key", key).withColumn("__day", F.to_date("event_date"))
    r = ranked(keyed, ["tag_key", "__day"], [F.asc("event_date"), F.asc("id")], "__n")
    totals = keyed.groupBy("tag_key", "__day").agg(F.count(F.lit(1)).alias("__total"))
    starts = starts_of(totals, ["tag_key"], "__day", "__total", "__start").drop("__total")
    place = F.col("__start") + F.col("__n") - 1
    return join_same(r, starts, ["tag_key", "__day"]).withColumn("batch", F.floor(place / size).cast("long")).drop("__day", "__n", "__start")


#: Tags of a unit whose subsets are scopes.
MOST_TAGS = 20


def scopes(units: DataFrame, how: str) -> DataFrame:
    """One row per scope of a unit's tags: combined, per_tag, or all_combinations (the non-empty subsets). Over
    MOST_TAGS distinct tags are an error there, for their subsets would be a million rows of one unit."""
    tags = F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))))
    if how == "combined":
        return units.select("id", tags.alias("scope"))
    if how == "per_tag":
        return units.select("id", F.explode_outer(F.transform(tags, lambda t: F.array(t))).alias("scope"))
    if how != "all_combinations":
        raise ValueError(f"unknown scopes {how!r}")
    few = F.when(F.size(tags) <= MOST_TAGS, tags).otherwise(F.raise_error(F.concat(F.lit("too many tags for all combinations: "), F.size(tags).cast("string"))))
    return units.select("id", few.alias("ts")).where("size(ts) > 0").select("id", F.explode(F.expr("transform(sequence(1, shiftleft(1, size(ts)) - 1), m -> filter(ts, (t, i) -> getbit(m, i) = 1))")).alias("scope"))


def inherited(sources: DataFrame) -> DataFrame:
    """Fields of an observation (observation_id) from its source facts, nulls ignored."""
    return sources.groupBy("observation_id").agg(
        F.min("event_date").alias("event_date"), F.min("occurred_start").alias("occurred_start"), F.max("occurred_end").alias("occurred_end"), F.max("mentioned_at").alias("mentioned_at")
    )


def update_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Observations (id, tags, source_ids, occurred_start, occurred_end, mentioned_at) joined with what is new of
    them. Sources are appended as they come; the proof count is how many there are."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.id") == F.col("n.id"), "left")
    none = F.array().cast("array<string>")
    srcs = F.concat(F.col("o.source_ids"), F.coalesce(F.col("n.source_ids"), F.array().cast("array<bigint>")))
    return j.select(
        F.col("o.id").alias("id"),
        F.array_sort(F.array_union(F.coalesce(F.col("o.tags"), none), F.coalesce(F.col("n.tags"), none))).alias("tags"),
        srcs.alias("source_ids"),
        F.size(srcs).alias("proof_count"),
        F.least(F.col("o.occurred_start"), F.col("n.occurred_start")).alias("occurred_start"),
        F.greatest(F.col("o.occurred_end"), F.col("n.occurred_end")).alias("occurred_end"),
        F.greatest(F.col("o.mentioned_at"), F.col("n.mentioned_at")).alias("mentioned_at"),
    )


def trend(evidence: DataFrame, key: str, when: Column, now: Column) -> DataFrame:
    """How an observation's evidence develops: recent (30 days) against older, older than 90 days old.

    The first case counts: no recent evidence is stale, only recent is new, then a ratio of densities over
    1.5 strengthens, under 0.5 weakens, else stable.
    """
    days = F.timestamp_diff("SECOND", when, now) / 86_400.0
    g = evidence.groupBy(key).agg(
        F.count_if(days < 30).alias("recent"), F.count_if(days > 90).alias("old"), F.count_if((days >= 30) & (days <= 90)).alias("middle"),
        F.min(when).alias("first"), F.max(when).alias("last"), F.count(F.lit(1)).alias("n"),
    )
    earlier = F.col("old") + F.col("middle")
    ratio = (F.col("recent") / 30.0) / (F.nullif(earlier, F.lit(0)) / 60.0)
    kind = F.when(F.col("recent") == 0, "stale").when(earlier == 0, "new").when(ratio > 1.5, "strengthening").when(ratio < 0.5, "weakening").otherwise("stable")
    return g.withColumn("trend", kind)


def stale_cascade(observations: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations to delete, surviving facts to consolidate again) after facts (id) were deleted."""
    flat = observations.select("id", F.explode("source_ids").alias("source_id"))
    gone = flat.join(deleted.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id").distinct()
    again = flat.join(gone, "id", "left_semi").select(F.col("source_id").alias("id")).distinct().join(deleted.select("id"), "id", "left_anti")
    return gone, again


def live_sources(observations: DataFrame, units: DataFrame) -> DataFrame:
    """Observations with the sources that still exist; those without any are left out."""
    flat = observations.select("id", F.posexplode("source_ids").alias("at", "source_id"))
    live = flat.join(units.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return live.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_id"))), lambda x: x["source_id"]).alias("source_ids"))


def valid_actions(actions: DataFrame, recalled: DataFrame) -> DataFrame:
    """Actions (action, target_id, fact_id, position) that may run: deletes of anything recalled, updates of
    what that fact recalled, all creates; in the order delete, update, create."""
    every, own = recalled.select(F.col("id").alias("target_id")).distinct(), recalled.select("fact_id", F.col("id").alias("target_id")).distinct()
    deletes = actions.where("action = 'delete'").join(every, "target_id", "left_semi")
    updates = actions.where("action = 'update'").join(own, ["fact_id", "target_id"], "left_semi").select(*actions.columns)
    creates = actions.where("action = 'create'")
    step = F.when(F.col("action") == "delete", 0).when(F.col("action") == "update", 1).otherwise(2)
    return deletes.select(*actions.columns).union(updates).union(creates).orderBy(step, "position")


def slots_left(observations: DataFrame, scope: list[str], most: int) -> DataFrame:
    """How many observations a scope may still get."""
    n = observations.where(tag_filter(F.col("tags"), scope, "all_strict")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.greatest(F.lit(most) - F.col("n"), F.lit(0)).cast("long").alias("left"))


def stale_models(models: DataFrame, units: DataFrame) -> DataFrame:
    """Mental models (model_id, tag, fact_type, refreshed_at) with is_stale: a unit in scope came after the last
    refresh. A model without tag takes every unit."""
    newest = units.select("fact_type", "event_date", F.explode(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("tag"))
    newest = newest.groupBy("fact_type", "tag").agg(F.max("event_date").alias("newest"))
    j = models.join(newest, models["tag"].eqNullSafe(newest["tag"]) & (models["fact_type"] == newest["fact_type"]), "left")
    return j.select("model_id", F.coalesce(newest["newest"] > models["refreshed_at"], F.lit(False)).alias("is_stale"))


def freshness(pending: Column) -> Column:
    return F.when(pending == 0, "up_to_date").when(pending < 10, "slightly_stale").otherwise("stale")


def rounds(units: DataFrame, part: list[str], order: list, size: int, most: int) -> DataFrame:
    """Units with the round that takes them, `size` of each part in a round; those beyond `most` rounds wait for the
    next run: round is null and requeued is true."""
    r = ranked(units, part, order, "place")
    n = F.ceil(F.col("place") / size).cast("long")
    return r.withColumn("round", F.when(n <= most, n)).withColumn("requeued", n > most).drop("place")


def halving(batch: list, work: Callable[[list], list]) -> tuple[list, list]:
    """(results, failed): work on a batch; where it raises, on its halves, down to single items, which fail."""
    results, failed, open_batches = [], [], [list(batch)]
    while open_batches:
        now = open_batches.pop()
        if not now:
            continue
        try:
            results += work(now)
        except Exception:  # noqa: BLE001  whatever a model or store raises
            if len(now) == 1:
                failed += now
            else:
                open_batches += [now[len(now) // 2 :], now[: len(now) // 2]]
    return results, failed
