"""Sampling a series by change: local peaks apart from each other, even coverage, then what is new and far from the rest.

Choices that depend on earlier ones are made in rounds for all parts at once. A round is an aggregate by part, which tasks
begin before the shuffle, so a part of a third of all rows is never one group. Rows are told apart by a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.rows import join_same, top_per
from weftline.sources.stored import written


def local_peaks(series: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Rows whose value is above the row before and not below the row after; ends compare with nothing."""
    w = Window.partitionBy(part).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    peak = (before.isNull() | (F.col(value) > before)) & (after.isNull() | (F.col(value) >= after))
    return series.withColumn("peak", peak).where("peak").drop("peak")


def spaced(rows: DataFrame, spacing: float) -> DataFrame:
    """Of rows (part, position, value, id) those that a choice of the highest first takes, none nearer than `spacing` to one taken.

    Time is in buckets as wide as the spacing. The best row left of three neighbouring buckets is taken whatever else is
    left, so each round takes all such rows and drops what is near them; a bucket takes part in few. A null value is the lowest.
    """
    key = F.struct((-F.coalesce("value", F.lit(float("-inf")))).alias("low"), "position", "id")
    if spacing <= 0:
        return rows.select("part", "position", "id")
    left = rows.select("part", F.floor(F.col("position") / spacing).alias("bucket"), key.alias("key"))
    left, taken = written(left), None
    around = F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)]))
    while not left.isEmpty():
        best = left.groupBy("part", "bucket").agg(F.min("key").alias("key"))
        first = best.select("part", around.alias("bucket"), F.col("key").alias("first")).groupBy("part", "bucket").agg(F.min("first").alias("first"))
        won = written(join_same(best, first, ["part", "bucket"]).where("key = first").drop("first"))
        taken = won if taken is None else taken.union(won)
        # Rows taken in one round lie in different buckets, so a list has three positions at most.
        near = won.select("part", around.alias("bucket"), F.col("key.position").alias("at")).groupBy("part", "bucket").agg(F.collect_list("at").alias("near"))
        clear = F.col("near").isNull() | F.forall("near", lambda x: F.abs(F.col("key.position") - x) >= spacing)
        left = written(join_same(left, near, ["part", "bucket"], "left").where(clear).drop("near"))
    return rows.select("part", "position", "id").limit(0) if taken is None else taken.select("part", "key.position", "key.id")


def _one_more(rows: DataFrame, chosen: DataFrame, most: int, order: list[Column], reason: Column) -> DataFrame:
    """chosen (part, picked, others) after one more choice for each part with fewer than `most`: its first row by `order` that is not
    picked. order and reason may use the columns of both."""
    open_parts = join_same(rows, chosen.where(F.size("picked") < most), ["part"])
    free = open_parts.where(~F.exists("picked", lambda x: x["id"] == F.col("id")))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], "position", "id", reason.alias("reason"))
    new = free.groupBy("part").agg(F.min(key).alias("new"))
    pick = F.struct("new.position", "new.id", "new.reason")
    more = F.when(F.col("new").isNull(), F.col("picked")).otherwise(F.array_append("picked", pick))
    return written(join_same(chosen, new, ["part"], "left").withColumn("picked", more).drop("new"))


def _gap() -> Column:
    """How far a row is from the nearest one that is picked."""
    return F.array_min(F.transform("picked", lambda x: F.abs(F.col("position") - x["position"])))


def _named(series: DataFrame, part: str, position: str, value: str, tie: str) -> DataFrame:
    return series.select(F.col(part).alias("part"), F.col(position).cast("double").alias("position"), F.col(value).cast("double").alias("value"), F.col(tie).alias("id"))


def _type(rows: DataFrame) -> str:
    return f"array<struct<position:double,id:{rows.schema['id'].dataType.simpleString()},reason:string>>"


def spaced_sample(series: DataFrame, part: str, position: str, value: str, tie: str, most: int, spacing: float) -> DataFrame:
    """Up to `most` rows of each part: the highest first, none nearer than `spacing` to a chosen one; what
    is left of the number covers the widest gaps."""
    rows = written(_named(series, part, position, value, tie))
    apart = rows.join(spaced(rows, spacing).select("id"), "id", "left_semi")
    high = top_per(apart, ["part"], [F.desc_nulls_last("value"), F.asc("position"), F.asc("id")], most)
    pick = F.struct("position", "id", F.lit("high").alias("reason"))
    chosen = written(high.groupBy("part").agg(F.collect_list(pick).cast(_type(rows)).alias("picked")))
    fewest = chosen.agg(F.min(F.size("picked"))).first()[0]
    for _ in range(most - (most if fewest is None else fewest)):
        chosen = _one_more(rows, chosen, most, [-_gap()], F.lit("gap"))
    ids = chosen.select(F.explode("picked.id").alias(tie))
    return series.join(ids, tie, "left_semi")


def scene_sample(series: DataFrame, part: str, position: str, value: str, tie: str, *, most: int, slots: int, spacing: float, threshold: float, novelty: float = 0.7) -> DataFrame:
    """Up to `most` rows of each part of a series of changes, in time from zero: (part, position, tie, value, reason).

    First one row for each of `slots` equal spans of time: the first of the first span, the last of the last, else the nearest to the
    span's middle, from elsewhere if the span is empty. Then scenes: peaks of at least `threshold`, chosen highest first
    and `spacing` apart; of these, and after them of all rows, the one whose weighed value and distance from what is chosen
    are together the largest. A row of a span that is a scene is "both". Null values are no change.
    """
    rows = written(_named(series, part, position, value, tie).withColumn("value", F.coalesce("value", F.lit(0.0))))
    w = Window.partitionBy("part").orderBy("position", "id")
    before, after = F.lag("value").over(w), F.coalesce(F.lead("value").over(w), F.lit(-1.0))
    peaks = rows.withColumns({"before": before, "after": after}).where((F.col("value") >= threshold) & (F.col("value") > F.col("before")) & (F.col("value") >= F.col("after")))
    scenes = spaced(peaks.select("part", "position", "value", "id"), spacing).select("id", F.lit(True).alias("scene"))
    rows = written(rows.join(scenes, "id", "left").withColumn("scene", F.coalesce("scene", F.lit(False))))
    chosen = written(rows.groupBy("part").agg(F.greatest(F.max("position"), F.lit(0.0)).alias("length")).withColumn("picked", F.array().cast(_type(rows))))
    at, length = F.col("position"), F.col("length")
    for i in range(slots):
        low, high, last = length * i / slots, length * (i + 1) / slots, i == slots - 1
        inside = (at >= low) & (F.lit(True) if last else at < high)
        middle = F.abs(at - (low + high) / 2)
        by = F.when(inside, at if i == 0 else -at).otherwise(middle) if i == 0 or last else middle
        chosen = _one_more(rows, chosen, slots, [~inside, by], F.when(F.col("scene"), "both").otherwise("coverage"))
    far = F.least(F.lit(1.0), F.coalesce(_gap() / F.greatest(length, F.lit(1.0)), F.lit(1.0)))
    for _ in range(most - slots):
        chosen = _one_more(rows, chosen, most, [~F.col("scene"), -F.round(F.col("value") * novelty + far * (1 - novelty), 12)], F.lit("scene"))
    picks = chosen.select(F.explode("picked").alias("p")).select(F.col("p.id").alias("id"), F.col("p.reason").alias("reason"))
    return rows.join(picks, "id").select(F.col("part").alias(part), F.col("position").alias(position), F.col("id").alias(tie), F.col("value").alias(value), "reason")
