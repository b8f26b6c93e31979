"""Whole stores: backup with a manifest, restore, versions of a table, signed event deliveries."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of tables for a restore: what others point to comes first.
TABLE_ORDER = ["banks", "documents", "chunks", "memory_units", "entities", "unit_entities", "entity_cooccurrences", "memory_links", "mental_models", "directives", "async_operations", "audit_log"]


def _order(names: list[str]) -> list[str]:
    return sorted(names, key=lambda n: (TABLE_ORDER.index(n) if n in TABLE_ORDER else len(TABLE_ORDER), n))


def _publish(spark: SparkSession, text: str, path: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    half, whole = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    fs = whole.getFileSystem(conf)
    out = fs.create(half, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(whole, False)
    if not fs.rename(half, whole):
        raise OSError(f"{path} was not published")


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as Parquet and a manifest (table_name, row_count); returns the manifest.

    All tables are of one state: a frame over files knows them from when it was made, and the lists of all are taken
    before the first is copied, so what is written meanwhile is in none. The copies go to a folder of their own;
    the manifest, published last, says which, so that a backup that breaks off leaves the one before as it was.
    """
    spark = next(iter(tables.values())).sparkSession
    names = _order(list(tables))
    pinned = {n: set(tables[n].inputFiles()) for n in names}
    folder, rows = uuid.uuid4().hex, []
    for name in names:
        if set(tables[name].inputFiles()) != pinned[name]:
            raise ValueError(f"{name} changed while it was backed up")
        tables[name].write.parquet(f"{path}/{folder}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{folder}/{name}").count()))
    _publish(spark, json.dumps({"folder": folder, "tables": rows}), f"{path}/manifest.json")
    return spark.createDataFrame(rows, "table_name string, row_count long")


def restore(spark: SparkSession, path: str, into: str | None = None) -> dict[str, DataFrame]:
    """The tables of a backup, what others point to first; fails if one has not as many rows as its manifest says. With `into` they
    are written to a fresh folder there, and a manifest is published once all are complete."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    counts, out = dict(manifest["tables"]), {}
    for name in _order(list(counts)):
        out[name] = spark.read.parquet(f"{path}/{manifest['folder']}/{name}")
        if (n := out[name].count()) != counts[name]:
            raise ValueError(f"{name} has {n} rows, the manifest says {counts[name]}")
    if into is None:
        return out
    backup(out, into)
    return restore(spark, into)


def sign(secret: str, payload: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()


def _pad(secret: Column, byte: int) -> Column:
    """The key block of HMAC: the secret (or, over 64 bytes, its digest) filled up to 64 bytes, each combined with a fixed byte."""
    raw = F.coalesce(secret, F.lit("")).cast("binary")
    digits = F.rpad(F.when(F.length(raw) > 64, F.sha2(raw, 256)).otherwise(F.hex(raw)), 128, "0")
    one = lambda i: F.lpad(F.hex(F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), one), ""))


def deliveries(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Event deliveries to make: each event (event_id, event_type, bank_id, payload) for each enabled hook
    (hook_id, bank_id, event_types, secret) that asks for its type, with a signature (HMAC-SHA256 of the payload; nulls are empty)."""
    h = hooks.where("enabled").select("hook_id", "bank_id", F.explode(F.array_distinct("event_types")).alias("event_type"), _pad(F.col("secret"), 0x36).alias("inner"), _pad(F.col("secret"), 0x5C).alias("outer"))
    inner = F.sha2(F.concat("inner", F.coalesce("payload", F.lit("")).cast("binary")), 256)
    signature = F.concat(F.lit("sha256="), F.sha2(F.concat("outer", F.unhex(inner)), 256))
    return events.join(h, ["bank_id", "event_type"]).select("event_id", "hook_id", "event_type", "payload", signature.alias("signature"))


def fingerprint(provider: str, model: str, dimension: int) -> str:
    return hashlib.sha256(json.dumps([provider, model, dimension]).encode()).hexdigest()


def check_fingerprint(stored: str | None, provider: str, model: str, dimension: int) -> None:
    """Vectors of different embedders must not meet in one store."""
    if stored is not None and stored != fingerprint(provider, model, dimension):
        raise ValueError("the store holds vectors of another embedder")


def tenant_key(namespace: Column, bank: Column) -> Column:
    return F.sha2(F.concat(namespace, F.char(F.lit(0)), bank), 256)
