"""Entity names: candidates, similarity, resolution, merging."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions.text import trigrams
from weftline.operators.rows import dealt, first_seen, join_same, top_per
from weftline.sources.stored import written


def trigram_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(a, b, similarity): names whose trigram sets overlap by Jaccard.

    An equi-join on the rarer trigrams of each name: two sets of this overlap cannot differ in all of them, so the
    commonest are never joined. A pair is taken where its rarest common trigram joins it, hence once, without a
    shuffle of pairs.
    """
    a, b = left.select("name").distinct(), right.select("name").distinct()
    seen = a.union(b).select(F.explode(trigrams(F.col("name"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    def rare_first(names: DataFrame, name: str, grams: str) -> DataFrame:
        flat = names.select("name", F.explode(trigrams(F.col("name"))).alias("g")).join(seen, "g")
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"])
        sets = flat.groupBy(F.col("name").alias(name)).agg(in_order.alias(grams))
        # The margin of 1e-6 covers the rounding of similarities.
        needed = F.ceil(F.lit(threshold - 1e-6) * F.size(grams)).cast("int")
        return sets.select(name, grams, F.explode(F.slice(grams, F.lit(1), F.size(grams) - F.greatest(needed, F.lit(1)) + 1)).alias("g"))

    common = F.array_intersect("ga", "gb")
    met = rare_first(a, "a", "ga").join(rare_first(b, "b", "gb"), "g").withColumn("common", common).where(F.element_at("common", 1) == F.col("g"))
    n = F.size("common")
    return met.withColumn("similarity", F.round(n / (F.size("ga") + F.size("gb") - n), 6)).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity with a bonus for up to four leading characters that agree (over 0.7)."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    same = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                same.append(ch)
                break
    if not same:
        return 0.0
    other = [b[j] for j, u in enumerate(used) if u]
    m, swaps = len(same), sum(x != y for x, y in zip(same, other, strict=True)) // 2  # whole swaps
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    lead = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        lead += 1
    return jaro + lead * scale * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def jaro_winkler_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity) over a threshold, of names in lower case; those that differ in case only are alike.

    Jaro is at most (m/|a| + m/|b| + 1) / 3 for m letters in common, each as often as both have it. For two lengths that
    says how many a pair needs, and two names that share so many of their letters (numbered: the second e is not
    the first) also share one of the rarest few of each. So names meet under both lengths and a rare letter, once, at the
    rarest they share; only what still can pass is compared. Names of no letters match nothing.
    """
    # Four letters in front add 0.4 of what is missing at most, and nothing up to 0.7.
    jaro = max(0.7, (threshold - 0.4) / 0.6) if threshold >= 0.7 else threshold
    names = left.select("name").union(right.select("name")).distinct().select("name", F.lower("name").alias("low")).where("low <> ''")
    letter = names.select("name", F.posexplode(F.split("low", "")).alias("at", "c")).where("c <> ''")
    nth = F.row_number().over(Window.partitionBy("name", "c").orderBy("at"))
    numbered = letter.select("name", F.concat("c", nth.cast("string")).alias("g"))
    df = numbered.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"])
    bags = numbered.join(df, "g").groupBy("name").agg(in_order.alias("bag")).join(names, "name").withColumn("n", F.size("bag"))
    lengths = bags.groupBy("n").agg(F.lit(1).alias("one")).select(F.col("n").alias("m"))  # as many rows as lengths
    needed = F.floor((3 * jaro - 1) * F.col("n") * F.col("m") / (F.col("n") + F.col("m")) - 1e-9).cast("int") + 1
    needed = F.greatest(F.lit(1), needed)

    def placed(side: DataFrame, as_: str) -> DataFrame:
        own = bags.join(side.select("name").distinct(), "name", "left_semi").join(lengths, F.lit(True)).withColumn("needed", needed)
        own = own.where(F.col("needed") <= F.least("n", "m"))
        rare = F.explode(F.slice("bag", F.lit(1), F.col("n") - F.col("needed") + 1)).alias("g")
        return own.select(F.col("name").alias(as_), F.col("low").alias(f"low_{as_}"), F.col("bag").alias(f"bag_{as_}"), F.col("n").alias(f"n_{as_}"), F.col("m").alias(f"m_{as_}"), "needed", rare)

    a, b = placed(left, "a"), placed(right, "b").drop("needed")
    met = a.join(b, (a["g"] == b["g"]) & (F.col("n_a") == F.col("m_b")) & (F.col("n_b") == F.col("m_a"))).withColumn("common", F.array_intersect("bag_a", "bag_b"))
    may = met.where((F.element_at("common", 1) == a["g"]) & (F.size("common") >= F.col("needed")))
    return may.withColumn("similarity", F.round(jaro_winkler_column("low_a", "low_b"), 4)).where(F.col("similarity") > threshold).select("a", "b", "similarity")


@F.pandas_udf(DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two names, in lower case."""
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)])


def resolve(mentions: DataFrame, entities: DataFrame, cooccurring: DataFrame | None = None, accept: float = 0.6, candidates: float = 0.15, each: int = 1_000_000) -> DataFrame:
    """Each mention (mention_id, name, seen, nearby: names) with the entity it means, or null for a new one.

    entities: (entity_id, name, last_seen). Score: half the likeness of names, 0.3 times the share of nearby
    names that co-occur with the entity (cooccurring: entity_id, name), 0.2 less with each day since it was
    last seen, for a week. Accepted over `accept`; of equal scores the smallest entity_id.

    Two names are likened once, and mentions that agree in name, time and nearby names are resolved as one. These are dealt
    by how many candidates they have, `each` to a task.
    """
    same = ["name", "seen", "nearby"]
    pairs = written(trigram_pairs(mentions, entities, candidates).select("a", "b", matcher_ratio("a", "b").alias("alike")))
    kinds = written(mentions.select(*same).distinct())
    named = lambda df, c: df.groupBy(F.col("name").alias(c)).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    total = pairs.join(named(kinds, "a"), "a").join(named(entities, "b"), "b").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
    m = dealt(kinds, total, same, each).withColumn("a", F.col("name"))
    e = entities.withColumnRenamed("name", "b")
    c = m.join(pairs, "a").join(e, "b")
    if cooccurring is None:
        c = c.withColumn("together", F.lit(0.0))
    else:
        known = cooccurring.groupBy("entity_id").agg(F.collect_set(F.lower("name")).alias("known"))
        c = c.join(known, "entity_id", "left")
        near = F.transform("nearby", lambda x: F.lower(x))
        c = c.withColumn("together", F.coalesce(F.size(F.array_intersect(near, "known")) / F.nullif(F.size(F.array_distinct(near)), F.lit(0)), F.lit(0.0)))
    days = F.abs(F.timestamp_diff("SECOND", "last_seen", "seen")) / 86_400.0
    fresh = F.when(days < 7, F.greatest(F.lit(0.0), 1 - days / 7)).otherwise(0.0)
    score = F.round(0.5 * F.col("alike") + 0.3 * F.col("together") + 0.2 * F.coalesce(fresh, F.lit(0.0)), 6)
    good = c.select(*same, "entity_id", score.alias("score")).where(F.col("score") > accept)
    best = top_per(good, same, [F.desc("score"), F.asc("entity_id")], 1).drop("rank")
    return join_same(mentions, best, same, "left").select("mention_id", "name", "entity_id", "score")


def new_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Names to insert: one per lower-case name, its first spelling and date, none that exists."""
    m = mentions.withColumn("key", F.lower("name"))
    first = first_seen(m, ["key"], [F.asc("seen"), F.asc("mention_id")])
    return first.join(entities.select(F.lower("name").alias("key")), "key", "left_anti").select("key", "name", "seen")


def merge_names(extracted: DataFrame, declared: DataFrame) -> DataFrame:
    """(id, position, name): extracted names first, then declared ones, the first of each lower-case name stays.
    Both: (id, names array)."""
    def flat(df: DataFrame, block: int) -> DataFrame:
        return df.select("id", F.lit(block).alias("block"), F.posexplode("names").alias("at", "name"))

    rows = flat(extracted, 0).union(flat(declared, 1)).where(F.trim("name") != "").withColumn("key", F.lower("name"))
    kept = first_seen(rows, ["id", "key"], [F.asc("block"), F.asc("at")])
    from weftline.operators.rows import ranked

    return ranked(kept, ["id"], [F.asc("block"), F.asc("at")], "position").select("id", "position", "name")


def fold_mentions(known: DataFrame, mentions: DataFrame) -> DataFrame:
    """known (entity_id, mention_count, last_seen) with mentions (entity_id, event_date) added: counts grow, the last
    date never goes back. Null counts are 0 and null dates give way; mentions of unknown entities are left out."""
    m = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("more"), F.max("event_date").alias("latest"))
    j = known.join(m, "entity_id", "left")
    return j.select("entity_id", (F.coalesce("mention_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("mention_count"), F.greatest("last_seen", "latest").alias("last_seen"))
