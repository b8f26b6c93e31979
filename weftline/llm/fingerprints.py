"""Canonical exact digests: fold a text, hash it widely, compare bytes inside equal buckets. SQL functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize

#: ICU, which Spark ships for its collations, composes (NFKC) and folds case; reflect() runs it inside the JVM.
_COMPOSE = ("com.ibm.icu.text.Normalizer", "compose")
_FOLD = ("com.ibm.icu.lang.UCharacter", "foldCase")
_LOWEST = -(2**63)
#: Digests of two or more rows up to which their list (40 bytes each) is broadcast.
BROADCAST_GROUPS = 500_000
#: Ranges of ids: about this many rows in each, up to so many ranges.
RANGE_ROWS, MAX_RANGES = 1500, 65_536
#: Bounds that one tree of comparisons holds.
_LEAVES = 256
#: Size up to which the representatives' texts are broadcast.
BROADCAST_BYTES = 48_000_000


def _icu(method: tuple[str, str], c: Column) -> Column:
    return F.reflect(F.lit(method[0]), F.lit(method[1]), c, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC of what folding takes apart, every run of white space one space, no space at the ends. Null counts
    as empty. Texts of ASCII only need no ICU."""
    t = F.coalesce(text, F.lit(""))
    plain = F.octet_length(t) == F.length(t)
    t = F.when(plain, F.lower(t)).otherwise(_icu(_COMPOSE, _icu(_FOLD, _icu(_COMPOSE, t))))
    return F.trim(F.regexp_replace(t, r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def wide_digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: two xxHash64 chains that start from different states."""
    part = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("weftline"), F.length(canon), canon)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canon, digest) of every row."""
    d = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col).cast("string")).alias("canon"))
    return d.withColumn("digest", wide_digest(F.col("canon")))


def colliding(d: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Rows of digests() whose bytes differ from those of the first row of their bucket.

    Only digests that occur twice or more are compared, each row against one representative by an
    equi-join on the digest, so a bucket with a third of all rows is split by the skew join. Where the
    list of such digests is counted and short it is broadcast, and only their rows move; a longer list
    is joined by a shuffle. So are the representatives, by their measured size.
    """
    key = F.coalesce("id", F.lit(_LOWEST))
    buckets = d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("rep"))
    shared = materialize(buckets.where("n > 1").select("digest", "rep"))
    if shared.count() <= broadcast_groups:
        shared = F.broadcast(shared)
    rows = d.join(shared, "digest")
    first = materialize(rows.where(key == F.col("rep")).groupBy("digest").agg(F.min("canon").alias("first")))
    if (first.agg(F.sum(F.octet_length("first") + 48)).first()[0] or 0) <= BROADCAST_BYTES:
        first = F.broadcast(first)
    return rows.join(first, "digest").where("canon <> first").select("id", "canon", "digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id): group_id is the smallest id among rows of equal canonical bytes.

    The fingerprint is the digest; rows of one digest and different bytes, should they ever occur, get
    a longer one. Null texts count as empty; null ids group as the smallest; repeated rows are kept.
    """
    d = digests(docs, id_col, text_col)
    odd = colliding(d).select("digest", F.sha2("canon", 256).alias("sha")).distinct()
    own = d.select("id", "digest", F.sha2("canon", 256).alias("sha")).join(odd.withColumn("odd", F.lit(True)), ["digest", "sha"], "left")
    own = own.withColumn("fingerprint", F.when(F.col("odd"), F.concat_ws("-", "digest", "sha")).otherwise(F.col("digest")))
    groups = own.groupBy("fingerprint").agg(F.min("id").alias("group_id"))
    return own.join(groups, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "group_id")


def _longs(values: list, kind: str) -> Column:
    """An array as one constant, whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below key. A balanced tree of comparisons holds up to _LEAVES bounds; of more it
    finds the list that key falls into, whose members at or below key are counted."""
    if not bounds:
        return F.lit(0)
    step = -(-len(bounds) // _LEAVES)
    lists = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    firsts = bounds if step == 1 else [x[0] for x in lists[1:]]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < firsts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    at = tree(0, len(firsts))
    if step == 1:
        return at
    inside = F.element_at(_longs(lists, "array<array<bigint>>"), at + 1)
    return at * step + F.size(F.filter(inside, lambda x: x <= key))


def edited_pairs(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its successor in descending id order (after the last the first) and its
    edited text: the last half of its code points replaced by as many from the successor's start.

    Ids are cut into ranges at approximate quantiles, as many as the rows need (bounds of 8 bytes each); the
    first document of each range is also sent to the range before it. Thus the texts move once and
    no window spans more than a range. Rows of one id are ordered by text; null ids come last.
    """
    d = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("k"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("k"))
    if buckets is None:
        buckets = int(min(MAX_RANGES, max(16, ids.count() // RANGE_ROWS)))
    cuts = ids.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], max(20_000, 4 * buckets))).first()[0] or []
    cuts = sorted(set(cuts))
    tops = {r[0]: r[1] for r in ids.groupBy(_bucket(F.col("k"), cuts).alias("b")).agg(F.max("k")).collect()}
    order = sorted(tops, reverse=True)  # descending ids
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the range that ends where b begins
    home = _bucket(F.col("k"), cuts)
    if order:
        prior = F.element_at(_longs([before.get(i, -1) for i in range(len(cuts) + 1)], "array<int>"), F.col("b") + 1)
        is_top = F.col("k") == F.element_at(_longs([tops.get(i) for i in range(len(cuts) + 1)], "array<bigint>"), F.col("b") + 1)
        places = F.when(is_top, F.array(F.struct(F.col("b"), F.lit(0).alias("ghost")), F.struct(prior.alias("b"), F.lit(1).alias("ghost"))))
        places = places.otherwise(F.array(F.struct(F.col("b"), F.lit(0).alias("ghost"))))
        d = d.withColumn("b", home).select("id", "k", "text", F.explode(places).alias("at")).select("id", "k", "text", "at.b", "at.ghost")
    else:
        d = d.withColumn("b", F.lit(0)).withColumn("ghost", F.lit(0))
    w = Window.partitionBy("b").orderBy("ghost", F.desc("k"), "text")
    d = d.withColumn("next", F.lead("text").over(w)).where("ghost = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next", F.lit(1), half))
    return d.select("id", "text", "next", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The fingerprint of every document and of its edited text, and how alike they are.

    An exact digest is like another (1.0) when the digests are equal and the canonical bytes are too,
    else unlike (0.0). Null texts count as empty; an only document is its own successor.
    """
    p = edited_pairs(docs, buckets)
    p = p.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("e"), canonical(F.col("next")).alias("x"))
    p = p.withColumn("fingerprint", wide_digest(F.col("c"))).withColumn("edited_fingerprint", wide_digest(F.col("e")))
    out = p.select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("c") == F.col("e")).cast("double").alias("near_edited"),
        (F.col("c") == F.col("x")).cast("double").alias("near_next"),
    )
    odd = colliding(digests(docs)).select(F.col("id").alias("o_id"), F.col("digest").alias("o_digest"), F.sha2("canon", 256).alias("o_sha")).distinct()
    out = out.join(odd, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("fingerprint") == F.col("o_digest")), "left")
    fp = F.when(F.col("o_sha").isNotNull(), F.concat_ws("-", "fingerprint", "o_sha")).otherwise(F.col("fingerprint"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fp.alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next")
