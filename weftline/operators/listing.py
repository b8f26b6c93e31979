"""Listings, details and views over the stores, and small state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scores import token_estimate
from weftline.functions.tags import tag_filter
from weftline.operators.rows import prefix_budget, ranked, top_per


def name_candidates(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose name is the query, contains it, or starts the query; with how it matched."""
    low, q = F.lower("name"), query.lower()
    exact, inside, reverse = low == q, low.contains(q), F.lit(q).startswith(low)
    how = F.when(exact, "exact").when(low.startswith(q), "prefix").when(inside, "contains").otherwise("reverse")
    return entities.where(exact | inside | reverse).withColumn("match", how)


def consolidation_state(units: DataFrame) -> DataFrame:
    """Units with state: done, failed or pending; observations have none."""
    state = F.when(F.col("consolidated_at").isNotNull(), "done").when(F.col("failed_at").isNotNull(), "failed").otherwise("pending")
    return units.withColumn("state", F.when(F.col("fact_type") != "observation", state))


def list_documents(docs: DataFrame, part_of_id: str | None, wanted: list[str] | None, mode: str, offset: int, limit: int) -> DataFrame:
    """A page of documents by id, whose id contains a text and whose tags fit, with the total."""
    hit = docs.where(tag_filter(F.col("tags"), wanted, mode))
    if part_of_id:
        hit = hit.where(F.lower(F.col("id").cast("string")).contains(part_of_id.lower()))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy("id").offset(offset).limit(limit).select("id").crossJoin(F.broadcast(total))  # one row


def memory_graph(units: DataFrame, links: DataFrame, limit: int, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The first `limit` units by newest date and the links with both ends among them."""
    rows = units if keep is None else units.where(keep)
    nodes = rows.orderBy(F.desc("event_date"), "id").limit(limit)
    ids = nodes.select("id")
    edges = links.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes, edges


def missing_arms(hits: DataFrame, fallback: DataFrame) -> DataFrame:
    """Hits of an external index, and the fallback's rows for fact types of which it has none."""
    none = fallback.join(hits.select("fact_type").distinct(), "fact_type", "left_anti")
    return hits.unionByName(none)


def source_facts(observations: DataFrame, units: DataFrame, per_observation: int, overall: int) -> DataFrame:
    """Source facts of ranked observations (id, rank, source_ids): within a token budget for each observation,
    and one for all, in (rank, position) order. A fact counts once, at its first observation."""
    flat = observations.select("id", "rank", F.posexplode("source_ids").alias("at", "source_id"))
    once = top_per(flat, ["source_id"], [F.asc("rank"), F.asc("at")], 1, "n").drop("n")
    j = once.join(units.select(F.col("id").alias("source_id"), token_estimate(F.col("text")).alias("tokens")), "source_id")
    own = prefix_budget(j, ["id"], [F.asc("at")], F.col("tokens"), per_observation).drop("spent").withColumn("all", F.lit(1))
    return prefix_budget(own, ["all"], [F.asc("rank"), F.asc("at")], F.col("tokens"), overall).drop("all")


def entity_state(mentions: DataFrame, budget: int) -> DataFrame:
    """(entity_id, id, rank, text): what recalled entities' observations say, newest first, a budget each."""
    rows = mentions.withColumn("tokens", token_estimate(F.col("text")))
    days_back = F.coalesce(-F.unix_date(F.to_date("event_date")), F.lit(2**31 - 1))
    kept = prefix_budget(rows, ["entity_id"], [F.desc("event_date"), F.asc("id")], F.col("tokens"), budget, days_back)
    return ranked(kept, ["entity_id"], [F.desc("event_date"), F.asc("id")])


def refresh_candidates(models: DataFrame, touched: list[str]) -> DataFrame:
    """Mental models (trigger JSON) that refresh after a consolidation of these tags: those that ask for it and
    are untagged or share one."""
    asks = F.coalesce(F.get_json_object("trigger", "$.refresh_after_consolidation").try_cast("boolean"), F.lit(False))
    return models.where(asks & tag_filter(F.col("tags"), touched, "any"))


def document_detail(units: DataFrame) -> DataFrame:
    """Units of each document by fact type."""
    return units.groupBy("document_id").agg(*[F.count_if(F.col("fact_type") == k).alias(k) for k in ("world", "experience", "observation")])


def release_tasks(tasks: DataFrame, worker: str | None) -> DataFrame:
    """Tasks in hand of one worker, or of all, are pending again."""
    mine = (F.col("status") == "processing") & (F.lit(True) if worker is None else F.col("worker_id") == worker)
    return tasks.withColumns({"worker_id": F.when(~mine, F.col("worker_id")), "status": F.when(mine, "pending").otherwise(F.col("status"))})


def propagate_tags(units: DataFrame, changed: DataFrame) -> DataFrame:
    """Units take the new tags of their documents (document_id, tags)."""
    new = changed.select("document_id", F.col("tags").alias("__t"), F.lit(True).alias("__hit"))
    return units.join(new, "document_id", "left").withColumn("tags", F.when(F.col("__hit"), F.col("__t")).otherwise(F.col("tags"))).select(*units.columns)


def label_values(units: DataFrame, vocabulary: DataFrame, prefix: str) -> DataFrame:
    """(id, label): entity labels `key:value` of a key whose value is in the vocabulary (key, value)."""
    flat = units.select("id", F.explode("labels").alias("label")).where(F.col("label").startswith(prefix + ":"))
    parts = flat.withColumn("key", F.lit(prefix)).withColumn("value", F.substring("label", len(prefix) + 2, 1_000))
    return parts.join(vocabulary, ["key", "value"], "left_semi").select("id", "label")


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(upper, n): how many values fall at or under each bound and over the one before; null is over all."""
    out = F.lit(None).cast("double")
    for b in reversed(bounds):
        out = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(out)
    return rows.groupBy(out.alias("upper")).agg(F.count(F.lit(1)).alias("n"))


def fact_identity(parts: list[Column]) -> Column:
    """A digest of a canonical JSON list of strings."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def normalise_items(items: DataFrame, batch_tags: list[str]) -> DataFrame:
    """Items (timestamp as text, tags) with date_state, event_date (explicit times only; UTC without a zone) and
    tags: the item's, then the batch's, each once."""
    t = F.try_to_timestamp("timestamp").cast("timestamp_ntz")
    state = F.when(F.lower(F.trim("timestamp")) == "unset", "timeless").when(t.isNotNull(), "explicit").otherwise("defaulted")
    tags = F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, batch_tags)).cast("array<string>")))
    return items.withColumns({"date_state": state, "event_date": t, "tags": tags})


def with_existing(items: DataFrame, existing: DataFrame) -> DataFrame:
    """For appends: the stored text of a document comes first, at position 0 and without an item."""
    first = existing.join(items.select("document_id").distinct(), "document_id", "left_semi").select("document_id", F.lit(None).cast("long").alias("item"), "text", F.lit(0).cast("long").alias("position"))
    rest = ranked(items, ["document_id"], [F.asc("item")], "position").select("document_id", "item", "text", "position")
    return first.union(rest)


def passthrough_facts(chunks: DataFrame) -> DataFrame:
    """One world fact per chunk."""
    return chunks.select("chunk_id", F.col("chunk_text").alias("text"), F.lit("world").alias("fact_type"))


def chunk_ordinals(chunks: DataFrame) -> DataFrame:
    """Chunks (batch, document_id, chunk_index) with their place in the whole batch and in the document."""
    r = ranked(chunks, ["batch", "document_id"], [F.asc("chunk_index")], "local_index")
    return ranked(r, ["batch"], [F.asc("document_id"), F.asc("chunk_index")], "global_index").withColumns({"local_index": F.col("local_index") - 1, "global_index": F.col("global_index") - 1})


def json_rows(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of objects as rows."""
    return rows.select("id", F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("r")).select("id", "r.*")


def chinese_share(text: Column) -> Column:
    """The share of Han characters among all that are not white space."""
    n = F.length(F.regexp_replace(text, r"\s", ""))
    return F.regexp_count(text, F.lit(r"\p{IsHan}")) / F.nullif(n, F.lit(0))


def clear_observations(units: DataFrame, observations: DataFrame, bank: str) -> tuple[DataFrame, DataFrame]:
    """(observations of the bank, which go; facts to consolidate again)."""
    gone = observations.where(F.col("bank_id") == bank)
    again = units.join(gone.select(F.explode("source_ids").alias("id")).distinct(), "id", "left_semi").select("id")
    return gone.select("id"), again
