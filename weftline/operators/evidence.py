"""What an answer is made from: bundles, snippets, appendices, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scores import token_estimate
from weftline.functions.text import normalise, tokens
from weftline.operators.rows import first_seen, prefix_budget, top_per


def overlap(text: Column, terms: list[str]) -> Column:
    return F.size(F.array_intersect(F.array_distinct(tokens(text)), F.array(*[F.lit(t) for t in sorted(set(terms))]))).cast("long")


def bundles(facts: DataFrame, terms: list[str], per_bundle: int = 2, most: int = 96) -> DataFrame:
    """Facts (id, rank, text, chunk_id, document_id, signal) in bundles: one per chunk, else document, else
    fact, in the order of their first fact; of each the best facts by 4 x overlap + 2 x signal, then rank;
    facts of equal normalised text once."""
    key = F.coalesce(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")), F.concat(F.lit("doc:"), F.col("document_id").cast("string")), F.concat(F.lit("fact:"), F.col("id").cast("string")))
    f = facts.withColumn("bundle", key).withColumn("norm", normalise(F.col("text")))
    f = first_seen(f, ["bundle", "norm"], [F.asc("rank"), F.asc("id")]).withColumn("score", 4 * overlap(F.col("text"), terms) + 2 * F.col("signal"))
    heads = f.groupBy("bundle").agg(F.min(F.struct("rank", "id")).alias("head"))
    kept = heads.orderBy("head").limit(most)
    best = top_per(f, ["bundle"], [F.desc("score"), F.asc("rank"), F.asc("id")], per_bundle, "place")
    return best.join(kept.select("bundle", F.col("head.rank").alias("first_rank")), "bundle").select("bundle", "first_rank", "place", "id", "score")


def snippets(
    turns: DataFrame, terms: list[str], *, per_document: int = 2, most: int | None = 16, chars: int = 1800, total_chars: int | None = 18_000, least: int = 2,
    signal: str = "[0-9]", numeric: bool = False, covered: DataFrame | None = None, order: str = "conv_id",
) -> DataFrame:
    """Turns (conv_id, turn, text) that answer a question, each with its neighbours as one window: (conv_id, turn,
    place, score, body).

    A turn scores 5 for each term and 2 for a signal, and needs `least`. Where a conversation has turns with terms,
    only they count; turns with a signal alone are asked for by numeric questions, and only where no covered turn
    (conv_id, turn) has a term. Windows of equal words stand once. Of each conversation the best few are taken, and
    these in turns, first the best of every one, in its order, until there are `most` or their characters are spent;
    None sets no such end.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    body = F.substr(F.concat_ws("\n", F.lag("text").over(w), "text", F.lead("text").over(w)), F.lit(1), F.lit(chars))
    s = turns.withColumn("body", body).withColumn("overlap", overlap(F.col("text"), terms))
    s = s.withColumn("score", 5 * F.col("overlap") + 2 * F.col("text").rlike(signal).cast("long")).where(F.col("score") >= least)
    if covered is not None:
        s = s.join(covered.select("conv_id", "turn", F.lit(True).alias("seen")), ["conv_id", "turn"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    else:
        s = s.withColumn("seen", F.lit(False))
    said = F.max(F.col("overlap") > 0).over(Window.partitionBy("conv_id"))
    s = s.withColumn("said", said).where(~F.col("seen") & ((F.col("overlap") > 0) | (F.lit(numeric) & ~F.col("said"))))
    best = [F.desc("score"), F.desc("overlap"), F.asc("turn")]
    s = s.withColumn("norm", F.trim(F.regexp_replace(F.lower("body"), "[^A-Za-z0-9_]+", " "))).where("body <> ''")
    top = top_per(first_seen(s, ["conv_id", "norm"], best), ["conv_id"], best, per_document, "place")
    if most is not None:
        top = top.orderBy("place", order).limit(most)
    if total_chars is not None:
        top = prefix_budget(top.withColumn("all", F.lit(1)), ["all"], [F.asc("place"), F.asc(order)], F.length("body"), total_chars)
    return top.select("conv_id", "turn", "place", "score", "body")


def appendix(facts: DataFrame, sessions: int = 6, per_session: int = 3) -> DataFrame:
    """Facts of several sessions side by side: the best few of the first sessions. The session is the
    document's, or one that the text names."""
    named = F.nullif(F.regexp_extract("text", r"(?i)session[ _:#-]*(\d+)", 1), F.lit(""))
    key = F.coalesce(F.col("document_id").cast("string"), F.concat(F.lit("session-"), named))
    f = facts.withColumn("session", key).where("session is not null")
    heads = f.groupBy("session").agg(F.min("rank").alias("first_rank")).orderBy("first_rank", "session").limit(sessions)
    return top_per(f.join(heads, "session"), ["session"], [F.asc("rank"), F.asc("id")], per_session, "place").select("session", "first_rank", "place", "id")


def provenance(requested: DataFrame, units: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested ids (n, id) in order with their unit, chunk and document; ids that are not found keep a row
    with status missing."""
    u = units.select("id", "chunk_id", "document_id", F.lit(True).alias("known"))
    j = requested.join(u, "id", "left").join(chunks.select("chunk_id", "chunk_text"), "chunk_id", "left").join(documents.select("document_id", "lang"), "document_id", "left")
    return j.select("n", "id", F.when(F.col("known"), "found").otherwise("missing").alias("status"), "chunk_id", F.length("chunk_text").cast("long").alias("chunk_chars"), "lang")


def attach_chunks(facts: DataFrame, chunks: DataFrame, max_tokens: int) -> DataFrame:
    """The chunks of ranked facts, each at its best fact's rank, within a token budget of their own."""
    best = facts.where("chunk_id is not null").groupBy("chunk_id").agg(F.min("rank").alias("rank"))
    j = best.join(chunks, "chunk_id").withColumn("tokens", token_estimate(F.col("chunk_text"))).withColumn("all", F.lit(1))
    return prefix_budget(j, ["all"], [F.asc("rank"), F.asc("chunk_id")], F.col("tokens"), max_tokens, F.floor(F.col("rank") / 1_000)).select("chunk_id", "rank", "tokens", "spent")


def packet(facts: DataFrame, by: list[str]) -> DataFrame:
    """Ranked facts as one text for each answer (by): a numbered line each, with its date. An answer's facts are few."""
    when = F.date_format(F.coalesce("occurred_start", "occurred_end"), "yyyy-MM-dd")
    line = F.concat_ws(" ", F.concat(F.col("rank").cast("string"), F.lit(".")), F.concat(F.lit("["), when, F.lit("]")), "text")
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return facts.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("packet"))


def observation_entities(observations: DataFrame, unit_entities: DataFrame) -> DataFrame:
    """(id, entity_id): the entities that an observation has through its sources."""
    flat = observations.select("id", F.explode("source_ids").alias("unit_id"))
    return flat.join(unit_entities, "unit_id").select("id", "entity_id").distinct()


def observations_of_document(observations: DataFrame, units: DataFrame, document_id) -> DataFrame:
    """Observations that have a source in a document."""
    mine = units.where(F.col("document_id") == document_id).select(F.col("id").alias("source_id"))
    return observations.select("id", F.explode("source_ids").alias("source_id")).join(mine, "source_id", "left_semi").select("id").distinct()
