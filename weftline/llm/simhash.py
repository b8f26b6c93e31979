"""SimHash near duplicates through pivot distance tables.

A document's fingerprint has one bit per majority among the hashes of its word shingles. Reference
fingerprints (pivots) come in pairs that differ exactly in one block of bits; the Hamming distances to
both give the distance to the pivot within the block. Two fingerprints that link (2 or fewer differing
bits) agree in two or more of the four blocks and so have the same distances to all pivots of two
blocks: that is the join key. Pairs with a coordinate that differs by more than 2 are discarded by the
triangle inequality, and survivors are verified by the Hamming distance itself.

A key that many fingerprints share is not paired up. Each of its fingerprints is put next to its
neighbours at one bit; two fingerprints link if and only if they share such a neighbour (or one is
it), and each links to the smallest there. That is exact and grows linearly with the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, steady_reads
from weftline.llm.graph import connected_components

SEED = 42
SHINGLE = 3
LINK = 2
BLOCKS, BLOCK_BITS = 4, 16
PIVOTS = 8  # pairs for each block
#: Fingerprints of a key that are compared pair by pair.
PAIRED = 32
FREE_BITS = {ij: [b for k in range(BLOCKS) if k not in ij for b in range(k * BLOCK_BITS, (k + 1) * BLOCK_BITS)] for ij in combinations(range(BLOCKS), 2)}


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, repeats included; a text of fewer words is one shingle, none has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits; 0 for a text without words."""
    h = shingle_hashes(text, shingle)
    return majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    steady_reads(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot_pairs(block: int) -> list[tuple[int, int]]:
    """Pseudorandom reference fingerprints and, for each, the one that differs in exactly this block."""
    mask = (2**BLOCK_BITS - 1) << (block * BLOCK_BITS)
    ps = [xxhash.xxh64_intdigest(f"pivot {block} {i}", SEED) for i in range(PIVOTS)]
    return [(_signed(p), _signed(p ^ mask)) for p in ps]


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot)))


def block_code(fp: Column, block: int) -> Column:
    """The distances within a block to its pivots, as one number."""
    code = F.lit(0).cast("long")
    for p, q in pivot_pairs(block):
        within = F.floor((distance(fp, p) - distance(fp, q) + BLOCK_BITS) / 2)
        code = code * (BLOCK_BITS + 1) + within
    return code


def largest_difference(a: Column, b: Column) -> Column:
    """The maximum coordinate difference of two rows of the distance table."""
    return F.greatest(*[F.abs(distance(a, p) - distance(b, p)) for k in range(BLOCKS) for p, _ in pivot_pairs(k)])


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at LINK or fewer bits, enough to connect all that link."""
    codes = fps.select("fp", *[block_code(F.col("fp"), k).alias(f"c{k}") for k in range(BLOCKS)])
    keys = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for n, (i, j) in enumerate(FREE_BITS)])
    rows = codes.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    # Written before the join: Spark splits a join only where both sides come straight from a shuffle.
    sizes = materialize(rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = materialize(rows.join(sizes, ["pair", "x", "y"]))
    few = shared.where(F.col("n") <= paired).select("pair", "x", "y", "fp")
    twos = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["pair", "x", "y"]).where("a < b")
    near = twos.where(largest_difference(F.col("a"), F.col("b")) <= LINK)
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK).select("a", "b")
    many = shared.where(F.col("n") > paired).select("pair", "x", "y", "fp")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in bits]) for bits in FREE_BITS.values()])
    around = many.select("fp", F.explode(F.element_at(flips, F.col("pair") + 1)).alias("flip"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).distinct()
    least = around.groupBy("at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "b")
    star = around.join(least, "at").where("fp <> b").select(F.col("fp").alias("a"), "b")
    star = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK)
    return near.union(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, paired: int = PAIRED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Documents of equal fingerprint link. Texts without words have fingerprint zero and link like any
    other; null texts count as empty; equal rows are kept; a null doc_id is never a component's name
    unless the whole component has none.
    """
    marked = materialize(fingerprints(docs, shingle))
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = connected_components(links(fps, paired), "a", "b")
    roots = fps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    names = materialize(roots.groupBy("root").agg(F.min("low").alias("component_id")))
    named = roots.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- near copies by shingle similarity -----------------------------------------------------------

#: Near copies share this part (Jaccard) or more of their sets of five-word shingles.
WORDS, SIMILAR = 5, 0.8
#: Bands of minima that propose pairs: a pair of similarity 0.8 shares one with probability 0.996.
BANDS, MINIMA = 14, 5
#: Bits in which fingerprints of near copies may differ: 27 degrees are 10 bits in the mean; 22 is four deviations more.
NEAR_BITS = 22
#: Members of a band's bucket that are paired with each other.
BUCKET = 48
#: Nodes and bytes of shingle hashes in a block of a larger bucket; blocks are compared two by two.
BLOCK_NODES, BLOCK_BYTES = 2_000, 8_000_000
#: Size up to which a list of pairs is broadcast to pick their texts.
PAIR_BYTES = 48_000_000
_FACTORS = np.random.default_rng(29).integers(1, 2**63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> list[int]:
    """One number for each band of minima of a set of hashes."""
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 8_192):
        low = np.minimum(low, (h[at : at + 8_192, None] * _FACTORS[None, :]).min(axis=0))
    rows = low.astype("<u8").reshape(BANDS, MINIMA)
    return [xxhash.xxh64_intdigest(r.tobytes(), SEED) - 2**63 for r in rows]


def similarity(a: str | None, b: str | None, shingle: int = WORDS) -> float:
    """Jaccard similarity of the sets of shingles; texts without words are alike."""
    x, y = set(shingle_hashes(a, shingle).tolist()), set(shingle_hashes(b, shingle).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def similar_links(sets: list[np.ndarray], group: np.ndarray, least: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs of places in sets (distinct hashes each), enough to connect all of similarity `least` or more
    where those of equal group are connected already. Exact: a pair is passed over only if it is connected.

    Sets with many common hashes come first: where they connect the rest, no others are looked at.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, ids, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(-np.bincount(owner, often[ids], n), kind="stable")
    # Common hashes are columns of a matrix, of at most eight cells for each hash of a set; rarer ones are listed.
    wide = np.flatnonzero(often > max(1, n // 8))
    column = np.full(len(often), -1)
    column[wide] = np.arange(len(wide))
    there = column[ids] >= 0
    dense = np.zeros((n, len(wide)), np.float32)
    dense[owner[there], column[ids[there]]] = 1.0
    rest = (often[ids] > 1) & ~there
    rare, by = ids[rest], owner[rest]
    own = np.split(rare, np.searchsorted(by, np.arange(1, n)))
    sort = np.argsort(rare, kind="stable")
    listed, ends = by[sort], np.cumsum(np.bincount(rare, minlength=len(often)))
    label, out = np.unique(group, return_inverse=True)[1], []
    for at in range(0, n, 128):
        tile = order[at : at + 128]
        common = dense[tile] @ dense.T
        for i, shared in zip(tile.tolist(), common, strict=True):
            if (label == label[0]).all():
                return out
            lists = [listed[ends[k - 1] if k else 0 : ends[k]] for k in own[i]]
            both = np.rint(shared).astype(np.int64) + (np.bincount(np.concatenate(lists), minlength=n) if lists else 0)
            either = sizes[i] + sizes - both
            near = np.flatnonzero(((either == 0) | (both / np.maximum(either, 1) >= least)) & (label != label[i]))
            _, first = np.unique(label[near], return_index=True)
            for j in near[first].tolist():
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _crowded_links(rows: DataFrame, crowded: DataFrame, comp: DataFrame, shingle: int, least: float, block_nodes: int = BLOCK_NODES, block_bytes: int = BLOCK_BYTES) -> DataFrame | None:
    """(a, b) that connect all similar nodes of the same large bucket which comp does not, or None where it
    connects every bucket.

    Nodes of the bucket's largest component are not compared with each other. The others fall into
    blocks of bounded size, as it does, and each of their blocks meets every block in one task, where
    all pairs are compared.
    """
    placed = materialize(crowded.join(comp, "node", "left").select("band", "value", "node", "size", F.coalesce("component", "node").alias("root")))
    parts = materialize(placed.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("size")).alias("bytes")))
    whole = parts.groupBy("band", "value").agg(F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block_nodes), F.ceil(size / block_bytes)).cast("int")
    split = whole.where("parts > 1").select("band", "value", F.col("top.root").alias("top"), blocks(F.col("top.n"), F.col("top.bytes")).alias("tops"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others"))
    split = materialize(split)
    if not split.count():
        return None
    met = materialize(placed.join(split, ["band", "value"]))
    is_top = F.col("root") == F.col("top")
    block = F.when(is_top, F.col("others") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(is_top, F.col("others") - 1).otherwise(F.col("others") + F.col("tops") - 1))
    dealt = met.withColumn("mine", block).withColumn("other", F.explode(meets)).where("mine <> other")
    dealt = dealt.select("band", "value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "root")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    asked = rows.withColumnRenamed("row", "node").join(met.select("node").distinct(), "node").select("node", "text")
    sets = materialize(asked.mapInArrow(hashed, "node long, hashes binary"))

    def compare(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        found = similar_links([np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")], t.column("root").to_numpy(), least)
        a, b = (node[np.array([x[k] for x in found], np.int64)] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(dealt.join(sets, "node").groupBy("band", "value", "i", "j").applyInArrow(compare, "a long, b long"))


def _texts_of(rows: DataFrame, pairs: DataFrame, side: str, name: str) -> DataFrame:
    """The pairs with the text of one side. A list of pairs that is short by its measured size goes to the
    texts; else both move."""
    asked = pairs.withColumnRenamed(side, "row")
    n = pairs.count()
    return rows.join(F.broadcast(asked) if n * 40 <= PAIR_BYTES else asked, "row").withColumnsRenamed({"row": side, "text": name})


def near_copies(docs: DataFrame, shingle: int = WORDS, least: float = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """(row, component): groups of texts that are equal or near copies, for docs (row unique, text).

    Equal texts are one node. Nodes that share a band propose pairs; in buckets of over `bucket` members
    every member is first paired with three representatives (smallest, largest, of the smallest fingerprint).
    Pairs go through the pivot table (a coordinate that differs by more than NEAR_BITS discards them), then
    the Hamming distance, and survivors are verified by the exact similarity of their shingle sets. Members of
    a large bucket that are not connected by then are compared exactly with all others of it, block by
    block. component is the smallest row of a group.
    """
    steady_reads(docs.sparkSession)
    rows = docs.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("weftline"), F.octet_length("text"), "text").alias("k2")]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, keys = [], [], []
            for t in b.column(3):
                h = np.unique(shingle_hashes(t.as_py(), shingle))  # the set that similarity is asked of
                fps.append(_signed(majority(h)) if len(h) else 0)
                sizes.append(len(h))
                keys.append(bands(h))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "k1", "k2", "fp", "size", "bands"])

    marked = materialize(rows.select("row", *key, "text").mapInArrow(sketch, "row long, k1 long, k2 long, fp long, size long, bands array<long>"))
    same = materialize(marked.groupBy("k1", "k2").agg(F.min("row").alias("node")))
    nodes = materialize(marked.join(same, ["k1", "k2"]).select("row", "node"))
    single = marked.join(same.select(F.col("node").alias("row")), "row", "left_semi")
    placed = single.select(F.col("row").alias("node"), "fp", "size", F.posexplode("bands").alias("band", "value"))
    groups = placed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp")).alias("r1"), F.max(F.struct("node", "fp")).alias("r2"), F.min(F.struct("fp", "node")).alias("r3"))
    shared = materialize(placed.join(materialize(groups.where("n > 1")), ["band", "value"]))
    few = shared.where(F.col("n") <= bucket).select("band", "value", "node", "fp")
    twos = few.withColumnsRenamed({"node": "a", "fp": "fa"}).join(few.withColumnsRenamed({"node": "b", "fp": "fb"}), ["band", "value"]).where("a < b").select("a", "fa", "b", "fb")
    reps = F.array(*[F.struct(F.col(f"{r}.node").alias("node"), F.col(f"{r}.fp").alias("fp")) for r in ("r1", "r2", "r3")])
    star = shared.where(F.col("n") > bucket).select("node", "fp", F.explode(F.array_distinct(reps)).alias("r")).where("node <> r.node")
    star = star.select(F.least("node", "r.node").alias("a"), F.when(F.col("node") < F.col("r.node"), F.col("fp")).otherwise(F.col("r.fp")).alias("fa"), F.greatest("node", "r.node").alias("b"), F.when(F.col("node") < F.col("r.node"), F.col("r.fp")).otherwise(F.col("fp")).alias("fb"))
    pairs = twos.union(star).where(largest_difference(F.col("fa"), F.col("fb")) <= NEAR_BITS)
    pairs = pairs.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= NEAR_BITS)
    pairs = materialize(pairs.select("a", "b").distinct())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similarity(x.as_py(), y.as_py(), shingle) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = _texts_of(rows, pairs, "a", "ta").join(_texts_of(rows, pairs, "b", "tb"), ["a", "b"]).select("a", "b", "ta", "tb")
    comp = materialize(connected_components(both.mapInArrow(verify, "a long, b long"), "a", "b"))
    more = _crowded_links(rows, shared.where(F.col("n") > bucket), comp, shingle, least)
    if more is not None:
        comp = connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b")
    return nodes.join(comp.withColumnRenamed("node", "root"), F.col("node") == F.col("root"), "left").select("row", F.coalesce("component", "node").alias("component"))
