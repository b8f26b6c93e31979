"""A corpus from raw documents to packed sequences, in five stages over the operators of weftline.llm.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet in the shared folder
and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from weftline.llm import simhash, suffix_dedup, toxicity
from weftline.llm.common import materialize, steady_reads, table
from weftline.llm.mixing import Mix
from weftline.llm.packing import pack

#: Words in a block of the mix: long, so that most documents are taken whole.
BLOCK_WORDS = 512
#: Bytes from which a passage that repeats goes: what nearly every passage of 51 words has. op2's contract says 400.
PASSAGE_BYTES = 200


#: Columns that the stages know; others may have any name.
_OWN = ("doc_id", "text")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with names for the other columns that clash with none of an operator's."""
    return docs.toDF(*[c if c in _OWN else f"__{k}" for k, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject; it is fitted on the labelled documents. Null and empty texts
    stay; equal rows are judged alike."""
    steady_reads(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts and near copies (five-word shingles, similarity 0.8 or more):
    that of the smallest doc_id, null last; of rows that repeat it, the first. Null texts count as empty; texts
    without words are copies of each other."""
    steady_reads(spark)
    d = materialize(_numbered(docs).withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    found = simhash.near_copies(d.select("row", "text"))
    rows = d.select("row", "doc_id").join(found, "row")
    keep = rows.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row"))["row"].alias("row"))
    return d.join(keep, "row", "left_semi").drop("row").toDF(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = suffix_dedup.LENGTH) -> DataFrame:
    """Documents without the passages of `length` bytes or more that repeat across them. What is cut inside a character loses it;
    a document of which nothing but white space is left goes. Null texts become empty; ids play no part, so a row that
    repeats another loses what it shares with it."""
    steady_reads(spark)
    kept = suffix_dedup.without_repeats(_numbered(docs), length, as_text=True).withColumnRenamed("kept", "text")
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    names = [(c if c in _OWN else f"__{k}", c) for k, c in enumerate(docs.columns)]
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(own).alias(c) for own, c in names])


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, taken as PASSAGE_BYTES, that repeat across them."""
    return drop_repeats(spark, docs, sf_dir, PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as their blocks are taken. A null source is one of its own, null ids and
    equal rows are documents like others, and texts without words are in no block and go."""
    steady_reads(spark)
    return Mix(docs, block_words=BLOCK_WORDS).rows()


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places. Every row has at least one piece, null and empty texts that of the
    end token; equal rows are packed each."""
    steady_reads(spark)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_passages),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express none of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
