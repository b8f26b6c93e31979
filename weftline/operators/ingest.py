"""From documents and conversations to facts: chunks, identities, changes, exchanges, segments."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import chunk_key
from weftline.operators.rows import ranked

#: Where a text is split, the first that occurs and makes pieces small enough.
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]


def split_text(text: str, most: int = 3000, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `most` characters: paragraphs, then lines, sentences, clauses, words. Neighbouring
    pieces are joined again while they fit."""
    if len(text) <= most:
        return [text] if text.strip() else []
    k = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[k], separators[k + 1 :]
    if sep == "":
        return [text[i : i + most] for i in range(0, len(text), most)]
    parts = text.split(sep)
    parts = [p + sep for p in parts[:-1]] + [parts[-1]]
    out: list[str] = []
    buf = ""
    for p in parts:
        if len(buf) + len(p) <= most:
            buf += p
            continue
        if buf:
            out.append(buf)
            buf = ""
        if len(p) <= most:
            buf = p
        else:
            *full, buf = split_text(p, most, rest) or [""]
            out += full
    if buf:
        out.append(buf)
    return [s for c in out if (s := c.strip())]


def split_conversation(text: str, most: int = 3000) -> list[str] | None:
    """A JSON list of turns as lists of whole turns of at most `most` characters; None if it is none."""
    try:
        turns = json.loads(text)
    except ValueError:
        return None
    if not isinstance(turns, list) or not all(isinstance(t, dict) for t in turns):
        return None
    out, buf, size = [], [], 2
    for t in turns:
        n = len(json.dumps(t, ensure_ascii=False)) + 1
        if buf and size + n > most:
            out.append(json.dumps(buf, ensure_ascii=False))
            buf, size = [], 2
        buf.append(t)
        size += n
    if buf:
        out.append(json.dumps(buf, ensure_ascii=False))
    return out


def chunk_documents(docs: DataFrame, most: int = 3000) -> DataFrame:
    """(doc_id, chunk_index, chunk_text, chunk_id, content_hash): greedy packing is sequential within a text,
    so it runs in Arrow batches; the rest is columns. A text that fits is one chunk as it is, an empty one too; null has none."""

    def cut(x: str | None) -> list[str]:
        if x is None:
            return []
        if len(x) <= most:
            return [x]
        return (split_conversation(x, most) if x.lstrip().startswith("[") else None) or split_text(x, most)

    @F.pandas_udf("array<string>")
    def chunks(t: pd.Series) -> pd.Series:
        return t.map(cut)

    c = docs.select("doc_id", F.posexplode(chunks("text")).alias("chunk_index", "chunk_text"))
    return c.withColumn("chunk_id", chunk_key(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_text"))).withColumn("content_hash", F.sha2("chunk_text", 256))


def fixed_chunks(docs: DataFrame, size: int) -> DataFrame:
    """Chunks of a fixed number of characters, as columns only."""
    n = F.ceil(F.length("text") / size).cast("int")
    c = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    c = c.withColumn("chunk_text", F.substr("text", F.col("chunk_index") * size + 1, F.lit(size))).drop("text")
    return c.withColumn("chunk_id", chunk_key(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_text"))).withColumn("content_hash", F.sha2("chunk_text", 256))


def change_kind(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, kind, reason, unchanged, changed): how a document changed, from its chunks (doc_id, chunk_index,
    content_hash): full, delta or metadata_only. Documents missing from new are left out."""
    o = old.select("doc_id", "chunk_index", F.col("content_hash").alias("o"))
    n = new.select("doc_id", "chunk_index", F.col("content_hash").alias("n"))
    j = o.join(n, ["doc_id", "chunk_index"], "full").groupBy("doc_id").agg(
        F.count_if(F.col("o") == F.col("n")).alias("unchanged"),
        F.count_if(~F.coalesce(F.col("o") == F.col("n"), F.lit(False))).alias("changed"),
        F.count("o").alias("before"),
        F.count("n").alias("after"),
    )
    first = F.col("before") == 0
    kind = F.when(first | (F.col("unchanged") == 0), "full").when(F.col("changed") == 0, "metadata_only").otherwise("delta")
    reason = F.when(first, "new_document").when(F.col("unchanged") == 0, "no_unchanged_chunks").when(F.col("changed") == 0, "same_chunks").otherwise("some_chunks_changed")
    return j.where("after > 0").select("doc_id", kind.alias("kind"), reason.alias("reason"), "unchanged", "changed")


def document_changes(docs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, kind, reason, unchanged, changed, added, removed) for each row of docs (doc_id, document_exists,
    updated_at, requested_at, policy_compatible, old_hash, new_hash), from its chunks (doc_id, chunk_index,
    content_hash). Stored state that is unsafe or ambiguous means full; a delta needs an unchanged chunk."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")

    def shape(chunks: DataFrame, side: str) -> DataFrame:
        return chunks.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias(f"{side}_n"), (F.count(F.lit(1)) > F.count_distinct("chunk_index")).alias(f"{side}_twice"), F.bool_or(missing("content_hash")).alias(f"{side}_bare")
        )

    one = lambda c, name: c.groupBy("doc_id", "chunk_index").agg(F.min("content_hash").alias(name), F.lit(True).alias(f"{name}_in"))
    both = F.col("o_in") & F.col("n_in")
    same = F.coalesce(F.col("o") == F.col("n"), F.lit(False))
    j = one(old, "o").join(one(new, "n"), ["doc_id", "chunk_index"], "full").groupBy("doc_id").agg(
        F.count_if(same).alias("unchanged"), F.count_if(both & ~same).alias("changed"), F.count_if(F.col("o_in").isNull()).alias("added"), F.count_if(F.col("n_in").isNull()).alias("removed")
    )
    d = docs.join(shape(old, "o"), "doc_id", "left").join(shape(new, "n"), "doc_id", "left").join(j, "doc_id", "left").na.fill(0, ["unchanged", "changed", "added", "removed"])
    moved = F.col("changed") + F.col("added") + F.col("removed")
    # The reasons, in the order in which they are looked for.
    reasons = [
        ("full", "document_not_found", ~F.col("document_exists")),
        ("stale_skip", "document_updated_after_request_started", F.col("updated_at") > F.col("requested_at")),
        ("full", "chunk_policy_incompatible", ~F.col("policy_compatible")),
        ("full", "missing_document_content_hash", missing("old_hash") | missing("new_hash")),
        ("full", "no_existing_chunks", F.col("o_n").isNull()),
        ("full", "duplicate_existing_chunk_index", F.col("o_twice")),
        ("full", "missing_existing_chunk_hash", F.col("o_bare")),
        ("full", "duplicate_new_chunk_index", F.col("n_twice")),
        ("full", "missing_new_chunk_hash", F.col("n_bare")),
        ("full", "document_hash_mismatch_without_chunk_changes", (moved == 0) & (F.col("old_hash") != F.col("new_hash"))),
        ("metadata_only", "same_chunks", moved == 0),
        ("full", "no_unchanged_chunks", F.col("unchanged") == 0),
    ]
    found = F.lit(None)
    for kind, reason, test in reasons:
        hit = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))
        found = F.coalesce(found, hit) if kind != "full" or reason != "document_not_found" else hit
    found = F.coalesce(found, F.struct(F.lit("delta").alias("kind"), F.lit("some_chunks_changed").alias("reason")))
    return d.withColumn("found", found).select("doc_id", "found.kind", "found.reason", "unchanged", "changed", "added", "removed")


def stale_requests(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Requests older than their document's last update are skipped: adds stale."""
    d = docs.select("doc_id", "updated_at")
    return requests.join(d, "doc_id", "left").withColumn("stale", F.coalesce(F.col("updated_at") > F.col("requested_at"), F.lit(False))).drop("updated_at")


def exchanges(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their exchange: a new one at each user turn after the first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("role") == "user").cast("long")).over(w)
    return turns.withColumn("exchange", F.greatest(n, F.lit(1)))


def segments(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, segment, first, last, n_chars, oversized): whole exchanges packed greedily to at most `most`
    characters; a longer exchange stands alone. Conversations are short, so each is one group."""
    e = exchanges(turns).groupBy("conv_id", "exchange").agg(F.sum(F.length("text")).alias("n"))

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("exchange")
        rows, start, size, last = [], None, 0, None
        for x, n in zip(t["exchange"], t["n"], strict=True):
            if start is not None and size + n > most:
                rows.append((start, last, size))
                start, size = None, 0
            start = x if start is None else start
            size, last = size + n, x
        rows.append((start, last, size))
        return pd.DataFrame([(t["conv_id"].iloc[0], k + 1, a, b, s, s > most) for k, (a, b, s) in enumerate(rows)], columns=["conv_id", "segment", "first", "last", "n_chars", "oversized"])

    return e.groupBy("conv_id").applyInPandas(pack, "conv_id long, segment long, first long, last long, n_chars long, oversized boolean")


def write_windows(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks with the window they are written in: `size` chunks of a document each, 0 means one window."""
    w = F.lit(0).cast("long") if size <= 0 else F.floor(F.col("chunk_index") / size).cast("long")
    return chunks.withColumn("write_window", w)


def spread_times(facts: DataFrame, order: list[Column], base: Column) -> DataFrame:
    """Facts get times 10 ms apart in order within a document, so that their order is unique."""
    r = ranked(facts, ["document_id"], order, "n")
    return r.withColumn("event_date", base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("n") - 1) * F.lit(0.01).cast("decimal(18,6)"))).drop("n")


def group_items(items: DataFrame, batch_document: str | None = None) -> DataFrame:
    """Which document each item (batch_id, item, document_id) of a batch belongs to: the batch's own, the only
    explicit one of the batch, or a generated one per item."""
    if batch_document is not None:
        return items.withColumn("target", F.lit(batch_document))
    w = Window.partitionBy("batch_id")
    n = F.size(F.collect_set("document_id").over(w))
    only = F.max("document_id").over(w)
    made = F.concat_ws("-", F.lit("doc"), F.col("batch_id").cast("string"), F.col("item").cast("string"))
    return items.withColumn("target", F.coalesce("document_id", F.when(n == 1, only), made))


def group_modes(grouped: DataFrame) -> DataFrame:
    """(batch_id, target, items, update_mode) of grouped items: the one mode of each document, replace where none is named. Items of a
    document that ask for different modes are an error when the rows are read."""
    mode = F.coalesce("update_mode", F.lit("replace"))
    g = grouped.groupBy("batch_id", "target").agg(F.count(F.lit(1)).alias("items"), F.min(mode).alias("least"), F.max(mode).alias("most"))
    wrong = F.raise_error(F.concat(F.lit("conflicting update modes for document "), F.col("target"), F.lit(": "), F.col("least"), F.lit(", "), F.col("most")))
    return g.select("batch_id", "target", "items", F.when(F.col("least") != F.col("most"), wrong).otherwise(F.col("least")).alias("update_mode"))


def collapse_verbatim(facts: DataFrame) -> DataFrame:
    """One fact per chunk: the first fact's text, all entities of its facts once."""
    g = facts.groupBy("chunk_id").agg(F.min_by("text", F.struct("position", "text")).alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"))
    return g


def parse_facts(raw: DataFrame, schema: str = "facts array<struct<what:string,when:string,who:string,why:string,fact_kind:string,fact_type:string,occurred_start:string,occurred_end:string>>") -> DataFrame:
    """Facts from extractor output (id, json, event_date), leniently: rows that do not parse give none, facts
    without `what` go. Events have a start (given or told by the text) and an end; others only the mention."""
    from weftline.functions.temporal import relative_day
    from weftline.functions.text import fact_text, present

    f = raw.select("id", "event_date", F.explode(F.from_json("json", schema)["facts"]).alias("f")).select("id", "event_date", "f.*")
    f = f.where(present(F.col("what")).isNotNull())
    kind = F.when(F.col("fact_type") == "assistant", "experience").when(F.col("fact_type") == "world", "world").when(F.col("fact_kind") == "conversation", "experience").otherwise("world")
    event = F.coalesce(F.col("fact_kind") == "event", F.lit(False))
    told = relative_day(F.col("what"), F.col("event_date")).cast("timestamp_ntz")
    start = F.when(event, F.coalesce(F.try_to_timestamp("occurred_start").cast("timestamp_ntz"), told))
    end = F.when(event, F.coalesce(F.try_to_timestamp("occurred_end").cast("timestamp_ntz"), start))
    text = fact_text(F.col("what"), F.col("when"), F.col("who"), F.col("why"))
    return f.select("id", kind.alias("fact_type"), text.alias("text"), start.alias("occurred_start"), end.alias("occurred_end"), F.col("event_date").alias("mentioned_at"))


def sentence_facts(chunks: DataFrame) -> DataFrame:
    """The extractor that needs no model: a world fact per sentence."""
    s = F.filter(F.split("chunk_text", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    return chunks.select("chunk_id", F.posexplode(s).alias("position", "text")).withColumn("fact_type", F.lit("world"))


def embed(units: DataFrame, dim: int = 64) -> DataFrame:
    """The embedder that needs no model: hashed words, unit length. Any function of this shape can replace it."""
    import zlib

    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                v = np.zeros(dim)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h & 0x10000 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.DataFrame({"id": b["id"], "embedding": out})

    return units.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def plan_digests(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, digest): a digest of a document's chunks (chunk_index, content_hash) in order."""
    each = F.struct("chunk_index", F.concat_ws(":", F.col("chunk_index").cast("string"), "content_hash").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["line"])
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def policy_fingerprint(**settings: object) -> str:
    """A digest of the settings that chunks depend on, whatever order they come in."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def manifests(plans: DataFrame, policy: str) -> DataFrame:
    """(doc_id, manifest): the JSON that a projection of a document is stored with."""
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(policy).alias("policy"), F.col("doc_id").cast("string").alias("document"), "chunks", "digest"))
    return plans.select("doc_id", body.alias("manifest"))


def units_of_items(items: DataFrame, units: DataFrame) -> DataFrame:
    """(item, unit_ids, status) for each item: the units (unit_id, item, synthetic) that come from it, in order, without
    synthetic ones. status: ok, missing (no unit), or duplicate (a unit that stands twice)."""
    own = units.where(~F.coalesce("synthetic", F.lit(False))).groupBy("item", "unit_id").agg(F.count(F.lit(1)).alias("times"))
    g = own.groupBy("item").agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"), F.max("times").alias("times"))
    status = F.when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "duplicate").otherwise("ok")
    return items.select("item").distinct().join(g, "item", "left").select("item", F.coalesce("unit_ids", F.array().cast("array<long>")).alias("unit_ids"), status.alias("status"))
