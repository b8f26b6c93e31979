"""A stored index of words: postings in blocks with bounds, so that a question reads its terms and not the texts.

Documents are dealt to blocks by a hash of their id. A row of the index is a term in a block: the documents with their
term counts, lengths and positions, and beside these the largest count and the smallest length, from which no document
of the block can score more than a bound. Rows are partitioned by a hash of the term and sorted by it: a question
prunes to its partitions and row groups. Bounds are read first, without the postings; what the best blocks
reach is a floor, and only blocks whose bound is not under it are read.

The index is two tables in segments. An update writes a segment with the blocks it touches, their counts last, and
readers take each block from the newest segment that has its counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import tokens
from weftline.sources.stored import built_once, ship

#: Documents of a block, about; partitions of terms.
BLOCK_DOCS, BUCKETS = 1_000, 64
#: Blocks that a task of the build inverts, and blocks whose rows of a partition of terms one task sorts.
TASK_BLOCKS, SLICE_BLOCKS = 4, 250
SCHEMAS = {
    "postings": "term string, block int, most int, least int, df int, entries array<struct<id: long, tf: int, length: int, positions: array<int>>>, segment int, bucket int",
    "blocks": "block int, docs long, words long, parts int, segment int",
}
ROWS = "term string, block int, most int, least int, df int, entries array<struct<id: bigint, tf: int, length: int, positions: array<int>>>"
#: How the rows of a block travel: those of a partition of terms together, as Arrow writes a table.
PACKED = "bucket int, block int, packed binary"
#: Blocks that are scored for a floor before the others.
FIRST = 8
K1, B = 1.2, 0.75
#: What one occurrence weighs in cover density.
WEIGHT = 0.1


@dataclass(frozen=True)
class Postings:
    """An index in a folder."""

    spark: SparkSession
    path: str

    def _segments(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def blocks(self) -> DataFrame:
        """(block, segment, docs, words, parts) of the newest segment of each block; docs with words count."""
        newest = F.max(F.struct("segment", "docs", "words", "parts")).alias("x")
        return self._segments("blocks").groupBy("block").agg(newest).select("block", "x.*")

    def rows(self, terms: list[str]) -> DataFrame:
        """The rows of some terms, as they are now."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        mine = self._segments("postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return mine.join(self.blocks().select("block", "segment"), ["block", "segment"])


def _block(parts: Column) -> Column:
    return F.pmod(F.xxhash64("id"), parts).cast("int")


def _inverted() -> Callable:
    """From the documents of a block (id, block, words) the rows of its terms, packed by partition of terms."""
    import numpy as np
    import pyarrow as pa

    def invert(docs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        words, ids = (pa.concat_arrays(docs[c].chunks) for c in ("words", "id"))
        length = np.diff(words.offsets.to_numpy())
        parent = np.repeat(np.arange(len(length), dtype=np.int32), length)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(length) - length, length) + 1
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        # Words stand in order of document and place, and a stable sort by term keeps that.
        order = np.argsort(code, kind="stable")
        code, parent = code[order], parent[order]
        changes = lambda *x: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in x], axis=0)])) if len(x[0]) else np.zeros(0, np.int64)
        entry = changes(code, parent)
        tf, doc, own = np.diff(np.append(entry, len(code))), parent[entry], code[entry]
        term = changes(own)
        ints = lambda x: pa.array(x, pa.int32())
        places = pa.ListArray.from_arrays(ints(np.append(entry, len(code))), ints(at[order]))
        each = pa.StructArray.from_arrays([ids.take(pa.array(doc)), ints(tf), ints(length[doc]), places], ["id", "tf", "length", "positions"])
        ends = np.append(term, len(own))
        bounds = [ints(np.maximum.reduceat(tf, term)), ints(np.minimum.reduceat(length[doc], term))] if len(term) else [ints([]), ints([])]
        of = docs["block"][0].as_py()
        block, terms = ints(np.full(len(term), of)), coded.dictionary.take(pa.array(own[term]))
        columns = [terms, block, *bounds, ints(np.diff(ends)), pa.ListArray.from_arrays(ints(ends), each)]
        rows = pa.Table.from_arrays(columns, ["term", "block", "most", "least", "df", "entries"])
        bucket = np.array([zlib.crc32(x.encode()) % BUCKETS for x in terms.to_pylist()], np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows.take(pa.array(order)), bucket[order]
        start = changes(bucket)
        packed = [_pack(rows.slice(a, z - a)) for a, z in zip(start, np.append(start[1:], len(bucket)), strict=True)]
        return pa.Table.from_arrays([ints(bucket[start]), ints(np.full(len(start), of)), pa.array(packed, pa.binary())], ["bucket", "block", "packed"])

    return invert


def _pack(rows) -> bytes:
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows.combine_chunks())
    return out.getvalue().to_pybytes()


def _unpacked(batches: Iterator) -> Iterator:
    """The rows of packed ones, with their partitions of terms."""
    import pyarrow as pa

    for batch in batches:
        for bucket, packed in zip(batch["bucket"].to_pylist(), batch["packed"], strict=True):
            for rows in pa.ipc.open_stream(packed.as_buffer()):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([bucket] * len(rows), pa.int32())], [*rows.schema.names, "bucket"])


def _write(units: DataFrame, parts: int, path: str, segment: int, touched: DataFrame | None = None) -> None:
    """A segment of the blocks of units (id, text), and of those that were touched and may now be empty."""
    spark = units.sparkSession
    ship(spark)
    text = F.coalesce("text", F.lit(""))
    # Texts are dealt, a few blocks to a task, and cut into words where they arrive; no word travels alone.
    dealt = units.select("id", _block(F.lit(parts)).alias("block"), text.alias("text")).repartition(-(-parts // TASK_BLOCKS), "block").sortWithinPartitions("block")
    packed = dealt.select("id", "block", tokens(F.col("text")).alias("words")).groupBy("block").applyInArrow(_inverted(), PACKED)
    sliced = packed.withColumn("slice", F.col("block") % F.lit(slices := -(-parts // SLICE_BLOCKS)))
    out = sliced.repartition(BUCKETS * slices, "bucket", "slice").select("bucket", "packed").mapInArrow(_unpacked, f"{ROWS}, bucket int")
    out.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    placed = units.select(_block(F.lit(parts)).alias("block"), tokens(text).alias("words"))
    counts = placed.groupBy("block").agg(F.count_if(F.size("words") > 0).alias("docs"), F.sum(F.size("words")).alias("words"))
    every = spark.range(parts).select(F.col("id").cast("int").alias("block")) if touched is None else touched
    counts = every.join(counts, "block", "left").select("block", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("words", F.lit(0)).alias("words"), F.lit(parts).alias("parts"))
    counts.coalesce(1).write.parquet(f"{path}/blocks/segment={segment}")


def build(units: DataFrame, path: str) -> Postings:
    """Writes the index of units (id, text). Null texts have no words; ids are taken to be unique."""
    parts = max(1, -(-units.count() // BLOCK_DOCS))
    _write(units, parts, path, 0)
    return Postings(units.sparkSession, path)


def stored(units: DataFrame) -> Postings:
    """The index of units read from files; it is built anew when these change."""
    path = built_once(units, "postings", lambda p: build(units.select("id", "text"), p))
    return Postings(units.sparkSession, path)


def update(index: Postings, units: DataFrame, changed: DataFrame) -> Postings:
    """Writes a segment of the blocks that changed ids (id) fall into, from the units as they are now: ids that went are not
    among these, new ones are. Only the texts of those blocks are read into it."""
    known = index.blocks().agg(F.max("segment").alias("segment"), F.max("parts").alias("parts")).first()
    touched = changed.select(_block(F.lit(known.parts)).alias("block")).distinct()
    mine = units.select("id", "text", _block(F.lit(known.parts)).alias("block")).join(touched, "block", "left_semi")
    _write(mine.select("id", "text"), known.parts, index.path, known.segment + 1, touched)
    return index


def _impact(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(index: Postings, terms: list[str], k: int, every: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """(id, bm25) of the k best documents with a term, or with every one; ties by id. keep: ids that may answer.

    The driver learns a row for each term and the floor; the documents stay with Spark.
    """
    terms = sorted(set(terms))
    none = index.spark.createDataFrame([], "id long, bm25 double")
    totals = index.blocks().agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    if not terms or not totals.n:
        return none
    rows, n, mean = index.rows(terms), totals.n, totals.words / totals.n
    df = {r.term: r.df for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    if not df or every and len(df) < len(terms):
        return none
    idf = F.lit(0.0)
    for t, f in df.items():
        idf = F.when(F.col("term") == t, F.log1p(F.lit((n - f + 0.5) / (f + 0.5)))).otherwise(idf)
    bounds = rows.groupBy("block").agg(F.sum(idf * _impact(F.col("most"), F.col("least"), mean)).alias("bound"), F.count(F.lit(1)).alias("terms"))
    bounds = bounds.where(F.col("terms") == len(terms)) if every else bounds

    def scored(some: DataFrame) -> DataFrame:
        flat = rows.join(some.select("block"), "block", "left_semi").select("term", F.explode("entries").alias("e"))
        each = flat.select(F.col("e.id").alias("id"), (idf * _impact(F.col("e.tf"), F.col("e.length"), mean)).alias("part"))
        each = each if keep is None else each.join(keep.select("id"), "id", "left_semi")
        s = each.groupBy("id").agg(F.sum("part").alias("bm25"), F.count(F.lit(1)).alias("terms"))
        s = s.where(F.col("terms") == len(terms)) if every else s
        return s.select("id", "bm25").orderBy(F.desc(F.round("bm25", 6)), "id").limit(k)

    first = scored(bounds.orderBy(F.desc("bound"), "block").limit(FIRST)).agg(F.count(F.lit(1)).alias("n"), F.min("bm25").alias("floor")).first()
    floor = first.floor - 2e-6 if first.n == k else 0.0
    return scored(bounds.where(F.col("bound") >= floor))


def cover_density(index: Postings, terms: list[str], k: int, every: bool = True) -> DataFrame:
    """(id, density) of the k best documents: each shortest run of words that holds all terms counts WEIGHT, less for each
    other word in it. Without `every` any occurrence is such a run.

    Occurrences in order of place, with the last place of each term so far: the earliest of these begins the shortest
    run that ends here, and the run is new if it begins later than the one before.
    """
    from pyspark.sql import Window

    terms = sorted(set(terms))
    if not terms:
        return index.spark.createDataFrame([], "id long, density double")
    flat = index.rows(terms).select("term", F.explode("entries").alias("e")).select("term", F.col("e.id").alias("id"), F.explode("e.positions").alias("at"))
    if every and len(terms) > 1:
        so_far = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        flat = flat.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at")))
        last = [F.max(F.when(F.col("term") == t, F.struct("at", "n"))).over(so_far) for t in terms]
        runs = flat.withColumn("last", F.array(*last)).where(~F.exists("last", lambda x: x.isNull())).withColumn("from", F.array_min("last"))
        before = F.lag("from.at").over(Window.partitionBy("id").orderBy("at"))
        runs = runs.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") < F.col("from.at")))
        noise = (F.col("at") - F.col("from.at")) - (F.col("n") - F.col("from.n"))
        flat = runs.select("id", (WEIGHT / (1 + noise)).alias("part"))
    else:
        flat = flat.select("id", F.lit(WEIGHT).alias("part"))
    s = flat.groupBy("id").agg(F.sum("part").alias("density"))
    return s.orderBy(F.desc(F.round("density", 6)), "id").limit(k)
