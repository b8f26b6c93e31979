"""Canonical tables over the driver's tables: units (facts), links, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(n: Column) -> Column:
    return F.element_at(F.array(F.lit("world"), F.lit("experience"), F.lit("observation")), (F.pmod(n, F.lit(3)) + 1).cast("int"))


def _hours_after(n: Column) -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), n.cast("int"))


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts: id, text, fact_type, tags (some untagged), bank_id, event_date."""
    d = table(spark, sf_dir, "documents")
    tags = F.when(F.col("doc_id") % 7 != 0, F.array("lang", "source"))
    return d.select(F.col("doc_id").alias("id"), "text", _kind(F.col("doc_id")).alias("fact_type"), tags.alias("tags"), F.col("source").alias("bank_id"), _hours_after(F.col("doc_id")).alias("event_date"), "lang", "n_chars")


def vector_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as facts: id, embedding, fact_type, document_id, event_date."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", _kind(F.col("label")).alias("fact_type"), F.floor(F.col("vec_id") / 10).alias("document_id"), _hours_after(F.col("vec_id")).alias("event_date"), F.col("label").cast("long").alias("label"))


def time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts with times: id, event_date, fact_type, bank_id, document_id, value, props."""
    e = table(spark, sf_dir, "events")
    bank = F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string"))
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("event_date"), F.col("event_type").alias("fact_type"), bank.alias("bank_id"), F.col("user_id").alias("document_id"), "value", "props")


def unit_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units, parts as their entities."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_partkey").alias("entity_id")).distinct()


#: The same tables for DuckDB.
SQL = {
    "text_units": """text_units AS (SELECT doc_id AS id, text, ['world','experience','observation'][(doc_id % 3) + 1] AS fact_type,
        CASE WHEN doc_id % 7 <> 0 THEN [lang, source] END AS tags, source AS bank_id,
        TIMESTAMP '2024-01-01' + to_hours(doc_id) AS event_date, lang, n_chars FROM documents)""",
    "vector_units": """vector_units AS (SELECT vec_id AS id, embedding, ['world','experience','observation'][(label % 3) + 1] AS fact_type,
        vec_id // 10 AS document_id, TIMESTAMP '2024-01-01' + to_hours(vec_id) AS event_date, label FROM embeddings)""",
    "time_units": """time_units AS (SELECT event_id AS id, ts AS event_date, event_type AS fact_type, 'b' || (user_id % 5) AS bank_id,
        user_id AS document_id, value, props FROM events)""",
    "unit_entities": "unit_entities AS (SELECT DISTINCT l_orderkey AS unit_id, l_partkey AS entity_id FROM lineitem)",
}


def with_tables(*names: str, rest: str) -> str:
    """A SQL text over canonical tables."""
    return "WITH " + ", ".join(SQL[n] for n in names) + (", " if not rest.lstrip().upper().startswith("SELECT") else " ") + rest
