"""Counts, series and roll-ups over facts, tasks and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import wildcard
from weftline.operators.rows import top_per

#: Buckets of each period: unit and how many.
PERIODS = {"1h": ("minute", 60), "12h": ("hour", 12), "1d": ("hour", 24), "7d": ("day", 7), "30d": ("day", 30), "90d": ("day", 90)}


def bank_list(banks: DataFrame, documents: DataFrame) -> DataFrame:
    """Banks with how many documents they have and when the last came, the busiest lately first."""
    d = documents.groupBy("bank_id").agg(F.count(F.lit(1)).alias("documents"), F.max("event_date").alias("last"))
    return banks.join(d, "bank_id", "left").select("bank_id", F.coalesce("documents", F.lit(0)).alias("documents"), "last").orderBy(F.desc_nulls_last("last"), "bank_id")


def link_breakdown(links: DataFrame, units: DataFrame) -> DataFrame:
    """Links by type, by fact type of their source, and by both, from one pass (grouping sets)."""
    j = links.join(units.select(F.col("id").alias("from_id"), "fact_type"), "from_id")
    g = j.groupingSets([["link_type"], ["fact_type"], ["link_type", "fact_type"]], "link_type", "fact_type").agg(F.count(F.lit(1)).alias("n"))
    return g


def bank_stats(units: DataFrame) -> DataFrame:
    """Per bank: facts of each type, tagged and all."""
    kinds = ["world", "experience", "observation"]
    return units.groupBy("bank_id").agg(*[F.count_if(F.col("fact_type") == k).alias(k) for k in kinds], F.count_if(F.col("tags").isNotNull()).alias("tagged"), F.count(F.lit(1)).alias("total"))


def time_series(rows: DataFrame, when: Column, kind: str, period: str, now: str) -> DataFrame:
    """(bucket, kind, n): every bucket of the period up to now's, zeros filled in; unknown periods mean 7d."""
    unit, n = PERIODS.get(period, PERIODS["7d"])
    spark = rows.sparkSession
    last = F.date_trunc(unit, F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")
    step = F.expr(f"interval 1 {unit}")
    first = last - F.expr(f"interval {n - 1} {unit}")
    spine = spark.range(1).select(F.explode(F.sequence(first, last, step)).alias("bucket"))
    kinds = rows.select(F.col(kind).alias("kind")).distinct()
    got = rows.where((when >= first) & (when < last + step)).groupBy(F.date_trunc(unit, when).cast("timestamp_ntz").alias("bucket"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    # The spine has at most 90 rows, the kinds are few.
    return spine.crossJoin(F.broadcast(kinds)).join(got, ["bucket", "kind"], "left").select("bucket", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def audit_stats(log: DataFrame, when: Column, action: str, low: str, high: str) -> DataFrame:
    """Daily counts of each action in [low, high)."""
    inside = log.where((when >= F.lit(low).cast("timestamp_ntz")) & (when < F.lit(high).cast("timestamp_ntz")))
    return inside.groupBy(F.date_format(F.date_trunc("day", when), "yyyy-MM-dd").alias("day"), F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def retained(log: DataFrame, when: Column, now: str, days: int) -> DataFrame:
    return log.where(when >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} day"))


def pending_breakdown(tasks: DataFrame) -> DataFrame:
    """Tasks (operation, status, retry_count) by operation: all, pending, running, to be tried again."""
    return tasks.groupBy("operation").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "processing").alias("processing"), F.count_if((F.col("status") == "pending") & (F.col("retry_count") > 0)).alias("retrying"),
    )


def in_flight(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'processing'").groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"))


def worker_status(tasks: DataFrame, now: str) -> DataFrame:
    """Per worker: tasks in hand, for how long the oldest runs, how long ago the last changed (seconds)."""
    t = F.lit(now).cast("timestamp_ntz")
    ago = lambda c: F.timestamp_diff("SECOND", c, t)
    return tasks.where("status = 'processing'").groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"), ago(F.min("claimed_at")).alias("running_for"), ago(F.max("updated_at")).alias("last_update_ago"))


def parent_status(children: DataFrame) -> DataFrame:
    """Parents whose children are all done: failed if any failed, else cancelled if any was, else completed."""
    done = F.col("status").isin("completed", "failed", "cancelled")
    g = children.groupBy("parent_id").agg(F.bool_and(done).alias("done"), F.bool_or(F.col("status") == "failed").alias("f"), F.bool_or(F.col("status") == "cancelled").alias("c"))
    status = F.when(~F.col("done"), "processing").when(F.col("f"), "failed").when(F.col("c"), "cancelled").otherwise("completed")
    return g.select("parent_id", status.alias("status"))


def common_error(children: DataFrame) -> DataFrame:
    """The most frequent error of each parent's failed children; of equal counts the first seen."""
    g = children.where("status = 'failed'").groupBy("parent_id", "error").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("first"))
    return top_per(g, ["parent_id"], [F.desc("n"), F.asc("first")], 1).select("parent_id", "error", "n")


def tag_counts(units: DataFrame, pattern: str | None = None) -> DataFrame:
    t = units.select(F.explode("tags").alias("tag"))
    t = t if pattern is None else t.where(wildcard(F.col("tag"), pattern))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tag_page(units: DataFrame, pattern: str | None, offset: int, size: int) -> DataFrame:
    """A page of tags, the most frequent first, with the number of all that match."""
    t = tag_counts(units, pattern)
    page = t.orderBy(F.desc("n"), "tag").offset(offset).limit(size)
    return page.join(F.broadcast(t.agg(F.count(F.lit(1)).alias("total")))).orderBy(F.desc("n"), "tag")  # the total is one row


def audit_rows(log: DataFrame, when: Column, low: str | None = None, high: str | None = None, **equal: str | None) -> DataFrame:
    """Log rows in [low, high) whose columns have given values, such as action and transport; None asks nothing."""
    if low is not None:
        log = log.where(when >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        log = log.where(when < F.lit(high).cast("timestamp_ntz"))
    for c, v in equal.items():
        log = log if v is None else log.where(F.col(c) == v)
    return log


def operation_states(tasks: DataFrame) -> DataFrame:
    """Per bank: tasks of each state, consolidations that wait or failed, and when the last one was done."""
    states = ["pending", "processing", "completed", "failed", "cancelled"]
    c, s = F.col("operation") == "consolidation", F.col("status")
    return tasks.groupBy("bank_id").agg(
        *[F.count_if(s == k).alias(k) for k in states], F.count_if(c & (s == "pending")).alias("pending_consolidation"),
        F.count_if(c & (s == "failed")).alias("failed_consolidation"), F.max(F.when(c & (s == "completed"), F.col("created_at"))).alias("last_consolidated_at"),
    )


def accuracy(results: DataFrame, category: str) -> DataFrame:
    """Results (correct, invalid) by category: an invalid answer counts as wrong; valid_accuracy leaves it out."""
    valid = ~F.col("invalid")
    return results.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("invalid")).alias("invalid"),
        F.round(F.avg((F.col("correct") & valid).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.when(valid, F.col("correct").cast("double"))), 6).alias("valid_accuracy"),
    )


def claim_tasks(tasks: DataFrame, reserved: dict[str, int], shared: int) -> DataFrame:
    """Tasks to start, oldest first: up to the reserved number of each operation, then from what is left the
    shared number; of consolidations one per bank. Deterministic, for a single scheduler."""
    one = F.row_number().over(Window.partitionBy("operation", F.when(F.col("operation") == "consolidation", F.col("bank_id")).otherwise(F.col("id").cast("string"))).orderBy("created_at", "id"))
    free = tasks.where("status = 'pending'").withColumn("n", one).where("n = 1")
    quota = F.lit(0)
    for op, k in reserved.items():
        quota = F.when(F.col("operation") == op, F.lit(k)).otherwise(quota)
    most = max([shared, *reserved.values()], default=shared) + sum(reserved.values())
    r = top_per(free, ["operation"], [F.asc("created_at"), F.asc("id")], most, "place").withColumn("pool", F.when(F.col("place") <= quota, "reserved"))
    rest = r.where("pool is null").orderBy("created_at", "id").limit(shared).withColumn("pool", F.lit("shared"))
    return r.where("pool is not null").unionByName(rest).select("id", "operation", "bank_id", "pool")


def purge_expired(cache: DataFrame, commands: DataFrame, now: str, limit: int) -> DataFrame:
    """Expired cache rows (key, expires_at) that no unfinished command (key, done) holds, the oldest first."""
    held = commands.where(~F.col("done")).select("key").distinct()
    return cache.where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")).join(held, "key", "left_anti").orderBy("expires_at", "key").limit(limit)


def select_by_manifest(units: DataFrame, path: str, value: str) -> DataFrame:
    """Counts of units, documents and units without document whose manifest (JSON) has a value at a path."""
    import re

    if not re.fullmatch(r"[A-Za-z_][\w]*(\.[A-Za-z_][\w]*)*", path):
        raise ValueError(f"unsafe path {path!r}")
    hit = units.where(F.get_json_object("manifest", f"$.{path}") == value)
    return hit.agg(F.count(F.lit(1)).alias("units"), F.count_distinct("document_id").alias("documents"), F.count_if(F.col("document_id").isNull()).alias("skipped"))
