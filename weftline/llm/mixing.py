"""Mixing sources to target weights, in fixed-length blocks. SQL functions only.

The words of each source form one stream, cut into blocks of equal length. The mix has as many slots
as its targets need; they are dealt to output shards, each slot is mapped to a block through a
pseudorandom permutation of its source's block numbers, and blocks are joined by number.

Source counts per shard: independent multinomial draws would leave each source's total off its target
by the square root of its slots. The draws here are made without replacement from the exact quotas (a
pseudorandom permutation of all slots), which is the multinomial conditioned on those totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, materialize, running_offsets, spread

MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index: Column, n: Column, key: list[Column], seed: int, rounds: int = 12) -> Column:
    """A pseudorandom permutation of 0..n-1 applied to index, one for each value of key.

    Swap-or-not: in each round index i and its partner (k - i) mod n change places or not, as a hash
    of the larger of both says. Each round is a bijection for any n. The rounds are a fold, for nested
    columns would double in size with each round.
    """

    def step(i: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(*key, F.lit(seed), r), n) - i, n)
        return F.when(F.xxhash64(F.greatest(i, mate), *key, F.lit(seed), -1 - r) < 0, mate).otherwise(i)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, step)


def source_targets(sized: DataFrame, block_words: int) -> DataFrame:
    """One row per source: rank, source_size, target, n_blocks, n_slots.

    Weights 1, 2, 3 repeat in code point order of the sources, null last. A target above three times
    its source's size stops there and the excess is shared again by weight: that is min(3 size, lam x
    weight) for the lam that spends all words, found by one pass over the sources in order of 3 size /
    weight. The table has one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(MAX_REPEAT) * F.col("source_size")).withColumn("bend", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    earlier = Window.orderBy("bend", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    stopped, spent = F.coalesce(F.sum("weight").over(earlier), F.lit(0)), F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    s = s.withColumn("lam", (F.col("total") - spent) / (F.col("weights") - stopped))
    # The first source in this order that stays below its cap fixes lam for all that follow.
    s = s.withColumn("lam", F.min(F.when(F.col("lam") <= F.col("bend"), F.struct("bend", "rank", "lam"))).over(every)["lam"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("lam", F.lit(0.0)) * F.col("weight")))
    b = F.lit(block_words)
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / b).cast("long"))
    size = F.greatest("source_size", F.lit(1))
    full = F.floor(F.col("target") / size + F.lit(1e-12)).cast("long")
    extra = F.least(F.round((F.col("target") - full * size) / b).cast("long"), F.col("n_blocks"))
    extra = F.when(full >= MAX_REPEAT, F.lit(0)).otherwise(F.greatest(extra, F.lit(0)))
    s = s.withColumn("n_slots", full * F.col("n_blocks") + extra)
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))
    s = s.withColumn("all_slots", F.sum("n_slots").over(every))
    return s.select("source", "rank", "source_size", "target", "n_blocks", "n_slots", "first_slot", "all_slots")


def slots(sources: DataFrame, shard_slots: int, seed: int, run: int = 50_000, tasks: int = 8) -> DataFrame:
    """(shard, place, rank, block): one row per slot of the mix. Slots are numbered in runs that are
    dealt over the cluster before they are unrolled, for one source may own a third of them."""
    s = sources.where("n_slots > 0")
    runs = s.select("rank", "n_blocks", "n_slots", "first_slot", "all_slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / run).cast("int"))).alias("run"))
    runs = runs.repartition(tasks, "rank", "run")  # a number, for the optimizer would make one task of a few rows
    j = F.explode(F.sequence(F.col("run") * F.lit(run).cast("long"), F.least((F.col("run") + 1) * F.lit(run).cast("long"), F.col("n_slots")) - 1))
    t = runs.select("rank", "n_blocks", "first_slot", "all_slots", j.alias("j"))
    t = t.withColumn("epoch", F.floor(F.col("j") / F.col("n_blocks"))).withColumn("i", F.pmod(F.col("j"), F.col("n_blocks")))
    t = t.withColumn("block", permuted(F.col("i"), F.col("n_blocks"), [F.col("rank"), F.col("epoch")], seed))
    t = t.withColumn("slot", F.col("first_slot") + F.col("j"))
    t = t.withColumn("at", permuted(F.col("slot"), F.col("all_slots"), [], seed + 1))
    return t.select(F.floor(F.col("at") / shard_slots).alias("shard"), F.pmod(F.col("at"), F.lit(shard_slots)).alias("place"), "rank", "block")


def pieces(sized: DataFrame, sources: DataFrame, block_words: int, buckets: int) -> DataFrame:
    """One row per document and block that it lies in: rank, block, from_word, words (in the document)."""
    ranked = sized.where("size > 0").join(sources.select("source", "rank"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = running_offsets(ranked, ["rank"], ["id", "size"], "size", "begin", buckets)
    end = F.col("begin") + F.col("size")
    b = F.lit(block_words).cast("long")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((end - 1) / b))))
    lo, hi = F.greatest(F.col("block") * b, F.col("begin")), F.least((F.col("block") + 1) * b, end)
    return cut.withColumn("words", hi - lo).withColumn("from_word", lo - F.col("begin"))


class Mix:
    """A mix of documents: sources (targets), slots (shard, place, rank, block), pieces (document parts by block).

    Null and wordless texts have size 0 and are never taken; null is a source; rows of equal id are
    separate documents; no rows give empty tables. Reruns agree for one seed.
    """

    def __init__(self, docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 20_240_601):
        self.docs, self.block_words = docs, block_words
        self.sized = materialize(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")))
        self.sources = materialize(source_targets(self.sized, block_words))
        n = int(self.sources.agg(F.sum("n_slots")).first()[0] or 0)
        self.slots = slots(self.sources, shard_slots, seed, tasks=max(8, n // 100_000))
        self.pieces = pieces(self.sized, self.sources, block_words, spread(self.sized.count()))

    def _times(self) -> DataFrame:
        """How often the mix takes each block. The optimizer sees the few rows of sources behind it and
        would broadcast it, though it grows with the input."""
        return self.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).cast("int").alias("times")).hint("merge")

    def taken(self) -> DataFrame:
        """Every document with the words that the mix takes from it."""
        times = self._times()
        got = self.pieces.join(times, ["rank", "block"], "left").groupBy("rank", "id", "size", "begin")
        got = got.agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
        names = self.sources.select("source", "rank", "source_size", "target")
        full = got.join(names, "rank").select("id", "size", "source_size", "target", "taken")
        none = self.sized.where("size = 0").join(names, self.sized["source"].eqNullSafe(names["source"]))
        return full.union(none.select("id", "size", "source_size", "target", F.lit(0).cast("long")))

    def rows(self) -> DataFrame:
        """The mix as rows of the documents' own columns: up to three rows per document, the r-th with
        the words whose blocks are taken r times or more, in their order in the document. A document
        taken whole keeps its text to the byte; otherwise words are joined by one space."""
        times = self._times()
        got = self.pieces.join(times, ["rank", "block"]).groupBy("id", "source", "size", "begin")
        got = got.agg(F.sort_array(F.collect_list(F.struct("from_word", "words", "times"))).alias("parts"))
        got = got.withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max("parts.times"))))
        got = got.withColumn("parts", F.expr("filter(parts, p -> p.times >= copy)"))
        got = got.withColumn("whole", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size"))
        got = got.select("id", "source", "size", "copy", "parts", "whole", F.row_number().over(Window.partitionBy("id", "source", "size", "copy").orderBy("begin")).alias("nth"))
        d = self.docs.withColumns({"__id": F.col("doc_id").cast("long"), "__size": n_words(F.col("text").cast("string"))})
        d = d.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "source", "__size").orderBy("text")))
        on = d["__id"].eqNullSafe(got["id"]) & d["source"].eqNullSafe(got["source"]) & (d["__size"] == got["size"]) & (d["__nth"] == got["nth"])
        j = d.join(got, on)
        words = F.regexp_extract_all(d["text"], F.lit(WORD), F.lit(0))
        part = F.concat_ws(" ", F.flatten(F.transform(got["parts"], lambda p: F.slice(words, (p["from_word"] + 1).cast("int"), p["words"].cast("int")))))
        text = F.when(got["whole"], d["text"]).otherwise(part)
        cols = [text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else d[f"`{c}`"] for c in self.docs.columns]
        return j.select(*cols)
