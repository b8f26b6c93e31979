"""Ranks, caps, budgets and pages: windows that always have a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, part: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("long"))


def top_per(df: DataFrame, part: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each part. Spark limits each task's rows of a part to k before the shuffle."""
    return ranked(df, part, order, out).where(F.col(out) <= k)


def dealt(df: DataFrame, rows: int, keys: list[str], each: int = 1_000_000) -> DataFrame:
    """df, which has about so many rows, dealt by keys so that a task holds `each` of them in the mean, at every size."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of a with those of b that agree in all keys, nulls with nulls. Without keys b is one row of totals."""
    other = b.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return a.join(other, on, how).drop(*[f"__of_{k}" for k in keys])


def starts_of(totals: DataFrame, part: list[str], cut: str, size: str, out: str) -> DataFrame:
    """totals (part, cut, size) with out: the sum of size over the earlier cuts of the part."""
    before = Window.partitionBy(*part).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)))


def ranked_by_cuts(df: DataFrame, cut: Column, order: list[Column], out: str = "rank") -> DataFrame:
    """All rows ranked without one window over them: places within each cut, behind the totals of the cuts before. cut grows with
    the order."""
    tagged = df.withColumn("__cut", cut)
    totals = tagged.groupBy(F.lit(1).alias("__all"), "__cut").agg(F.count(F.lit(1)).alias("__total"))
    starts = starts_of(totals, ["__all"], "__cut", "__total", "__start").select("__cut", "__start")
    placed = ranked(tagged.join(starts, "__cut"), ["__cut"], order, out)
    return placed.withColumn(out, F.col(out) + F.col("__start")).drop("__cut", "__start")


def prefix_budget(df: DataFrame, part: list[str], order: list[Column], cost: Column, most: int, cut: Column | None = None) -> DataFrame:
    """Rows in order until their running cost exceeds a budget; the first row over ends the list. Costs are not negative.

    cut is a coarse key that grows with the order (nulls first). Cuts that begin beyond the budget are then found by
    their totals, and their rows never reach the window, however large a part is.
    """
    if cut is not None:
        tagged = df.withColumn("__cut", cut)
        totals = tagged.groupBy(*part, "__cut").agg(F.sum(cost).alias("__total"))
        near = starts_of(totals, part, "__cut", "__total", "__start").where(F.col("__start") <= most).drop("__total", "__start")
        df = join_same(tagged, near, [*part, "__cut"], "left_semi").drop("__cut")
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= most)


def round_robin(df: DataFrame, group: str, group_order: Column, order: list[Column]) -> DataFrame:
    """The first row of each group, then the second of each, and so on: adds turn and is ordered by it."""
    return ranked(df, [group], order, "turn").orderBy("turn", group_order)


def keyset_page(df: DataFrame, key: str, tie: str, after: tuple | None, size: int) -> DataFrame:
    """A page in descending key order that starts behind a row, and whether more follow (has_more)."""
    if after is not None:
        k, t = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(key) < k) | ((F.col(key) == k) & (F.col(tie) < t)))
    page = df.orderBy(F.desc(key), F.desc(tie)).limit(size + 1)
    n = F.row_number().over(Window.orderBy(F.desc(key), F.desc(tie)))  # of a page only
    return page.withColumn("n", n.cast("long")).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size).where(F.col("n") <= size)


def first_seen(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order."""
    return top_per(df, key, order, 1, "__n").drop("__n")


def min_max(df: DataFrame, score: str, out: str, part: list[str]) -> DataFrame:
    """Scores scaled to 0..1 within each part; equal scores give 0.5, null scores null."""
    ends = df.groupBy(*part).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    scaled = F.when(high == low, F.when(F.col(score).isNotNull(), F.lit(0.5))).otherwise((F.col(score) - low) / (high - low))
    return join_same(df, ends, part, "left").withColumn(out, scaled).drop("__low", "__high")


def classify_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged, by a digest of each key's row."""
    o, n = old.select(F.col(key), F.col(digest).alias("o")), new.select(F.col(key), F.col(digest).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, kind.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with those of new in their place; columns in keep stay as they were. Of several new rows
    of one key the last by all columns counts."""
    rest = [c for c in old.columns if c not in key]
    fresh = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__n"))
    was = old.select(*key, F.struct(*rest).alias("__o"))
    both = was.join(fresh, key, "full")
    pick = lambda c: F.coalesce(F.col(f"__o.{c}"), F.col(f"__n.{c}")) if c in keep else F.when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(f"__o.{c}"))
    return both.select(*key, *[pick(c).alias(c) for c in rest]).select(*old.columns)


def unzip(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from arrays side by side: the k-th of each array make a row; shorter arrays end in nulls. Other columns
    are repeated."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.arrays_zip(*columns)))
