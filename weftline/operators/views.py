"""What changes and views of documents lead to: tag cascades, filtered graphs, chunk pages, wide series, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tags import tag_filter
from weftline.operators.consolidate import stale_cascade
from weftline.operators.listing import propagate_tags
from weftline.operators.stats import PERIODS


def tag_cascade(units: DataFrame, observations: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units with their tags and consolidated_at, observations to delete, units to consolidate again) after documents got new
    tags (document_id, tags).

    The documents' own units take the tags. Observations with a source among them go, and all sources of these, units of
    other documents too, are to be consolidated again: consolidated_at is null. Documents that did not change and
    units without one are left alone.
    """
    own = units.join(changed.select("document_id"), "document_id", "left_semi").select("id")
    gone, others = stale_cascade(observations, own)
    again = own.union(others).distinct()
    reset = again.withColumn("__again", F.lit(True))
    tagged = propagate_tags(units, changed).join(reset, "id", "left")
    out = tagged.withColumn("consolidated_at", F.when(F.col("__again").isNull(), F.col("consolidated_at"))).select(*units.columns)
    return out, gone, again


def graph_view(units: DataFrame, edges: DataFrame, document: Column | None = None, text: str | None = None, tags: list[str] | None = None, match: str = "all_strict") -> tuple[DataFrame, DataFrame]:
    """(units, edges) that a filter shows: of a document, with a text (in any case), with tags; edges between two of these."""
    shown = units
    if document is not None:
        shown = shown.where(document)
    if text:
        shown = shown.where(F.contains(F.lower("text"), F.lit(text.lower())))
    if tags:
        shown = shown.where(tag_filter(F.col("tags"), tags, match))
    ids = shown.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return shown, kept


def chunk_page(chunks: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of each document's chunks (doc_id, chunk_index): the rows of its places offset to offset + limit, with the
    document's total. A document's chunks are ranked by their own index, so only the page reaches a window's end."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    paged = chunks.withColumns({"total": total, "place": place})
    return paged.where((F.col("place") >= offset) & (F.col("place") < offset + limit)).drop("place")


def wide_series(rows: DataFrame, fields: list[str], kind: str, kinds: list[str], period: str, now: str) -> DataFrame:
    """(bucket, a column of counts for each kind, total): each row counts at the first of its time fields that is not null. Buckets
    without rows are zero; kinds that are not asked for count in the total only."""
    unit, n = PERIODS.get(period, PERIODS["7d"])
    when = F.coalesce(*fields)
    last = F.date_trunc(unit, F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")
    first = last - F.expr(f"interval {n - 1} {unit}")
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(f"interval 1 {unit}"))).alias("bucket"))
    inside = rows.where((when >= first) & (when < last + F.expr(f"interval 1 {unit}")))
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    got = inside.groupBy(F.date_trunc(unit, when).cast("timestamp_ntz").alias("bucket")).agg(*counts, F.count(F.lit(1)).alias("total"))
    return spine.join(got, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*kinds, "total"]])


def with_template(existing: DataFrame, template: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields, action): the rows after the template, each with what it did to it, null where it names none. A key that
    exists takes the fields that the template gives, null fields are not given; others are created; keys that the
    template has not stay as they are. A key that the template has twice is a row for each."""
    mark = lambda df, side: df.select(key, F.struct(*fields).alias(side))
    both = mark(existing, "was").join(mark(template, "new"), key, "full")
    pick = [F.coalesce(F.col(f"new.{f}"), F.col(f"was.{f}")).alias(f) for f in fields]
    same = F.lit(True)
    for f in fields:
        same = same & F.coalesce(F.col(f"new.{f}"), F.col(f"was.{f}")).eqNullSafe(F.col(f"was.{f}"))
    what = F.when(F.col("new").isNull(), F.lit(None)).when(F.col("was").isNull(), "create").when(same, "keep").otherwise("update")
    return both.select(key, *pick, what.alias("action"))


def apply_template(existing: DataFrame, template: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after the template, what it did to each of its keys), as in with_template()."""
    both = with_template(existing, template, key, fields)
    return both.drop("action"), both.where("action is not null").select(key, "action")


def documents_by_manifest(units: DataFrame, path: str, value: str) -> DataFrame:
    """(document_id, units): each document to process again once, with how many of its units have the value at a path of their
    manifest (JSON). Units without document are one row of null, for they are skipped."""
    if not re.fullmatch(r"[A-Za-z_][\w]*(\.[A-Za-z_][\w]*)*", path):
        raise ValueError(f"unsafe path {path!r}")
    return units.where(F.get_json_object("manifest", f"$.{path}") == value).groupBy("document_id").agg(F.count(F.lit(1)).alias("units"))
