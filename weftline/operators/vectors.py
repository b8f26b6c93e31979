"""An index of vectors in cells around centres: approximate by probing cells, exact by bounds on angles.

Centres come from spherical k-means on a bounded sample; every vector is in the cell of its nearest centre. Cells are
cut into blocks that numpy multiplies. Probing compares a query with the nearest cells only. The exact answer reads a
block only if the angle between its centre and a query's, less the angles that both spread over, can reach the
threshold, or in a search the k-th similarity that probing found. That is one path at every size: what is skipped
cannot hold an answer. Vectors without any grouping leave little to skip, and the exact answer then costs all pairs
of blocks; probing costs what its recall asks for.

Equal vectors are one row of their cell with their smallest ids, so that many copies are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.rows import top_per
from weftline.sources.stored import ship, written

#: Vectors that centres are fitted on, for each centre, and centres at most: both bound what the driver holds.
FIT_EACH, MOST_CENTRES = 40, 2_048
#: Units of a cell, until there are centres enough.
PER_CELL = 256
#: Distinct vectors of a block.
BLOCK = 512
#: Groups of blocks at least: how often a block travels where all blocks are compared.
GROUPS = 16
#: Numbers in the vectors of a group, which a task holds of each side.
HELD = 4_194_304
#: Vectors that are compared with all centres at once.
AT_ONCE = 1_024
#: Cells that a query is compared with first.
PROBES = 8
#: Room for rounding in angles.
SLACK = 1e-5
#: Similarities are compared as they are shown.
PLACES = 6


@dataclass(frozen=True)
class Index:
    """centres: unit vectors, one for each cell; rows: (id, embedding, cell, angle) of every vector but null and zero ones."""

    centres: np.ndarray
    rows: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _known(units: DataFrame) -> DataFrame:
    """Rows with a direction."""
    some = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull())
    return units.select("id", "embedding").where(some)


def fit_centres(units: DataFrame, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """A centre for PER_CELL units, MOST_CENTRES at most, fitted on FIT_EACH units for each, those whose ids hash into that
    share of all hashes."""
    known = _known(units)
    n = known.count()
    if not n:
        return np.zeros((1, 1))
    centres = max(1, min(MOST_CENTRES, n // PER_CELL))
    share = min(1.0, centres * FIT_EACH / n)
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * centres * FIT_EACH)
    x = _unit(np.array([r.embedding for r in sample.select("embedding").collect()], float))
    rng = np.random.default_rng(seed)
    if not len(x):
        return _unit(np.array([known.first().embedding], float))
    x = x[np.lexsort(x.T)]  # the order that rows come in plays no part
    centre = x[rng.permutation(len(x))[:centres]]
    for _ in range(rounds):
        near = np.concatenate([(x[lo : lo + AT_ONCE] @ centre.T).argmax(1) for lo in range(0, len(x), AT_ONCE)])
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 0
        centre = np.where(full[:, None], _unit(sums), centre)
    return centre


def _nearest(s: np.ndarray, probes: int) -> np.ndarray:
    """The columns of the largest values of each row, the largest first, of equal ones the first."""
    return s.argmax(1)[:, None] if probes == 1 else np.argsort(-s, axis=1, kind="stable")[:, :probes]


def _placed(units: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(id, embedding, cell, angle, probe): the nearest cells of each vector, the nearest first."""
    probes = min(probes, len(centres))
    ship(units.sparkSession)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (batch[lo : lo + AT_ONCE] for batch in batches for lo in range(0, len(batch), AT_ONCE)):
            s = _unit(np.stack(b["embedding"].to_numpy()).astype(float)) @ centres.T
            near = _nearest(s, probes)
            angle = np.arccos(np.clip(np.take_along_axis(s, near, 1), -1, 1))
            at = np.repeat(np.arange(len(b)), probes)
            yield pd.DataFrame({"id": b["id"].to_numpy()[at], "embedding": b["embedding"].to_numpy()[at], "cell": near.ravel(), "angle": angle.ravel(), "probe": np.tile(np.arange(probes), len(b))})

    return _known(units).mapInPandas(place, "id long, embedding array<float>, cell int, angle double, probe int")


def build(units: DataFrame, centres: np.ndarray | None = None) -> Index:
    """An index of all units (id, embedding). It holds nothing that cannot be built again."""
    centres = fit_centres(units) if centres is None else centres
    return Index(centres, written(_placed(units, centres).drop("probe")))


def update(index: Index, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> Index:
    """The index after units changed or came (id, embedding) and others went (id). A changed unit whose vector is null leaves
    it; deletion wins over a change of the same id; ids that are not there are no error. Centres stay: a drift of
    the data costs time, and never an exact answer."""
    rows = index.rows
    for d in (changed, deleted):
        rows = rows if d is None else rows.join(d.select("id"), "id", "left_anti").select(*index.rows.columns)
    if changed is not None:
        fresh = changed if deleted is None else changed.join(deleted.select("id"), "id", "left_anti")
        rows = rows.unionByName(_placed(fresh, index.centres).drop("probe"))
    return Index(index.centres, rows)


def _classes(rows: DataFrame, ids: int) -> DataFrame:
    """(cell, embedding, angle, ids): distinct vectors with their smallest ids."""
    few = top_per(rows, ["cell", "embedding"], [F.asc("id")], ids)
    return few.groupBy("cell", "embedding").agg(F.min("angle").alias("angle"), F.array_sort(F.collect_list("id")).alias("ids"))


def _blocks(rows: DataFrame, cell: str, key: str, *cols: str) -> DataFrame:
    """(cell, block, spread, n, rows): the rows of each cell in blocks of about BLOCK, with the largest angle and the number of each."""
    size = rows.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    cut = rows.join(size, cell).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    return cut.groupBy(cell, "block").agg(F.max("angle").alias("spread"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(key, *cols)).alias("rows"))


def _struct(rows: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Where each list of structs begins and ends, and the structs of all."""
    offsets = rows.offsets.to_numpy()
    return offsets - offsets[0], rows.flatten()


def _vectors(structs: pa.StructArray) -> np.ndarray:
    return _unit(pc.struct_field(structs, "embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(structs), -1).astype(float))


def _asked(structs: pa.StructArray, threshold: float, by_floor: bool) -> tuple[np.ndarray, np.ndarray]:
    """The queries of structs and the similarity that each asks for."""
    q = pc.struct_field(structs, "query").to_numpy()
    return q, np.maximum(threshold, pc.struct_field(structs, "floor").to_numpy()) if by_floor else np.full(len(q), threshold)


def _over(q: np.ndarray, a: np.ndarray, floor: np.ndarray, b: np.ndarray, ids: pa.Array, k: int, read: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, similarity) of the pairs of rows of a and b at or over each query's floor, ties of the k-th with it; of those that
    are read alone, where that is given."""
    s = np.round(a @ b.T, PLACES)
    if read is not None:
        s[~read] = -np.inf
    if s.shape[1] > k:
        # More than k columns over a query's k-th cannot be needed, but for ties.
        floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    i, j = np.nonzero(s >= floor[:, None])
    start, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
    many = np.diff(start)[j]
    at = np.repeat(np.arange(len(i)), many)
    place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return q[i[at]], flat[start[j[at]] + place], s[i, j][at]


def _top(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    keep = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) < k
    return q[keep], ids[keep], s[keep]


FOUND = "query long, id long, similarity double"


def _multiply(pairs: DataFrame, k: int, threshold: float, by_floor: bool) -> DataFrame:
    """(query, id, similarity) of the best k for each query of each pair of blocks (left: query, embedding, floor; right: ids,
    embedding), at or over the threshold and the query's floor. Blocks stay Arrow arrays: a task holds the vectors and
    no objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                left, right = (_struct(batch.column(side).slice(n, 1))[1] for side in (0, 1))
                q, floor = _asked(left, threshold, by_floor)
                out = _top(*_over(q, _vectors(left), floor, _vectors(right), pc.struct_field(right, "ids"), k), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query", "id", "similarity"])

    return pairs.select("left", "right").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_per(found, ["query"], [F.desc("similarity"), F.asc("id")], k)


def _groups(blocks: DataFrame, dims: int) -> int:
    """How many groups the blocks of a side are dealt to: GROUPS, and more where a group would be over HELD numbers."""
    many, rows = blocks.agg(F.count(F.lit(1)), F.sum("n")).first()
    return max(1, min(many, max(GROUPS, -(-(rows or 0) * dims // HELD))))


def _compared(left: DataFrame, right: DataFrame, centres: np.ndarray, k: int, threshold: float, by_floor: bool = False, probes: int | None = None) -> DataFrame:
    """The best k for each query of all pairs of blocks (cell, block, spread, n, widest, rows and cell, block, spread, n, rows) that
    can hold one: within the widest angle that the queries of a block reach. With probes, the best k of so many cells of
    each query, its nearest.

    Blocks are dealt to groups, and a task compares one group of each side. So a block travels once for each group of the
    other side, however many blocks or cells it is compared with, and a query leaves k answers for a group. A group is bounded.
    """
    lefts, rights = _groups(left, centres.shape[1]), _groups(right, centres.shape[1])
    probes = None if probes is None or probes >= len(centres) else probes
    ship(left.sparkSession)
    group = lambda n: F.pmod(F.xxhash64("cell", "block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select("cell", "spread", "widest", "rows", group(lefts).alias("i")).withColumn("j", every(rights))
    b = right.select(F.col("cell").alias("t_cell"), F.col("spread").alias("t_spread"), F.col("rows").alias("t_rows"), group(rights).alias("j")).withColumn("i", every(lefts))

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if one.num_rows and other.num_rows:
            (at, asked), (to, targets) = (_struct(t[c].combine_chunks()) for t, c in ((one, "rows"), (other, "t_rows")))
            q, floor = _asked(asked, threshold, by_floor)
            x, y, ids = _vectors(asked), _vectors(targets), pc.struct_field(targets, "ids")
            cells, spread, widest = (one[c].to_numpy() for c in ("cell", "spread", "widest"))
            t_cells = other["t_cell"].to_numpy()
            between = np.arccos(np.clip(centres[cells] @ centres[t_cells].T, -1, 1))
            near = between - spread[:, None] - other["t_spread"].to_numpy()[None, :] <= widest[:, None] + SLACK
            cell_of = np.repeat(t_cells, np.diff(to))
            for n in range(len(cells)):
                mine, read = slice(at[n], at[n + 1]), None
                if probes is not None:
                    read = np.zeros((at[n + 1] - at[n], len(centres)), bool)
                    np.put_along_axis(read, _nearest(x[mine] @ centres.T, probes), True, 1)
                    near[n] = read.any(0)[t_cells]
                rows = np.concatenate([np.arange(to[m], to[m + 1]) for m in np.flatnonzero(near[n])] or [np.zeros(0, np.int64)])
                best = found[0]
                for lo in range(0, len(rows), 8 * BLOCK):
                    some = rows[lo : lo + 8 * BLOCK]
                    more = _over(q[mine], x[mine], floor[mine], y[some], ids.take(pa.array(some)), k, None if read is None else read[:, cell_of[some]])
                    best = _top(*(np.concatenate(c) for c in zip(best, more, strict=True)), k)
                found.append(best)
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query", "id", "similarity"])

    return _best(a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, FOUND), k)


def _reach(floor: Column) -> Column:
    """The angle beyond which a similarity, as shown, is under a floor."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), floor - 10**-PLACES)))


def search(index: Index, queries: DataFrame, k: int, threshold: float = -1.0, probes: int | None = None) -> DataFrame:
    """(query, id, similarity, rank): the k most similar rows of each query (id, embedding), at or over a threshold.

    With probes only so many cells of each query are read: the answer can miss some, and probes_for() says how many reach
    a recall. Without, the answer is exact. A query is compared with all rows, its own id too. Equal vectors
    answer with their smallest ids. Rows and queries without a direction have no neighbours.
    """
    targets = written(_blocks(_classes(index.rows, k), "cell", "embedding", "ids"))
    some = [F.col("id").alias("query"), "embedding", "cell", "angle"]
    if probes is not None:
        # A query is in the block of its nearest cell alone, however many it reads.
        asked = _placed(queries, index.centres).select(*some, F.lit(float(threshold)).alias("floor"))
        asked = written(_blocks(asked, "cell", "query", "embedding", "floor").withColumn("widest", F.lit(np.pi)))
        return _compared(asked, targets, index.centres, k, threshold, probes=probes)
    asked = _placed(queries, index.centres, PROBES).select(*some, F.lit(-1.0).alias("floor"))
    left = _blocks(asked, "cell", "query", "embedding", "floor").select("cell", F.col("rows").alias("left"))
    first = _best(_multiply(left.join(targets.select("cell", F.col("rows").alias("right")), "cell"), k, threshold, False), k)
    floors = first.where(F.col("rank") == k).select("query", F.col("similarity").alias("floor"))
    home = _placed(queries, index.centres).select(*some).join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float(threshold))))
    by_query = _blocks(home, "cell", "query", "embedding", "floor")
    by_query = written(by_query.withColumn("widest", _reach(F.array_min(F.transform("rows", lambda r: r["floor"])))))
    return _compared(by_query, targets, index.centres, k, threshold, True)


def probes_for(index: Index, k: int = 10, recall: float = 0.95, asked: int = 256, seed: int = 5) -> int:
    """How many cells each query has to read for a mean recall, as measured on so many of the indexed vectors against all.

    The sample is bounded and goes to every task; the rows are read once, and each batch leaves k rows for a query.
    """
    n = index.rows.count()
    if not n:
        return 1
    share = min(1_000_000, int(asked / n * 1_000_000) + 1)
    sample = index.rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share).select("id", "embedding").limit(2 * asked).collect()
    if not sample:
        return len(index.centres)
    own = np.array([r.id for r in sample])
    x = _unit(np.array([r.embedding for r in sample], float))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = x @ _unit(np.stack(b["embedding"].to_numpy()).astype(float)).T
            s[own[:, None] == b["id"].to_numpy()[None, :]] = -2
            few = min(k, s.shape[1])
            near = np.argpartition(-s, few - 1, axis=1)[:, :few]
            yield pd.DataFrame({"query": np.repeat(own, few), "id": b["id"].to_numpy()[near].ravel(), "similarity": np.take_along_axis(s, near, 1).ravel(), "cell": b["cell"].to_numpy()[near].ravel()})

    found = _best(index.rows.mapInPandas(best, "query long, id long, similarity double, cell int").where("similarity > -1.5"), k).collect()
    order = np.argsort(np.argsort(-(x @ index.centres.T), axis=1, kind="stable"), axis=1)
    at = {int(q): j for j, q in enumerate(own)}
    needed = np.sort([order[at[r["query"]], r["cell"]] for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def neighbours(units: DataFrame, k: int, threshold: float, probes: int | None = None) -> DataFrame:
    """(from_id, to_id, similarity, rank): the k most similar other units of each, at or over a threshold; exact, or with probes of
    the recall that probes_for() measures. Units with equal vectors are compared once, as the smallest id of them."""
    index = build(units)
    if probes is None:
        # One table is both sides. A query is the head of its class, and k + 1 answers leave k without itself.
        classes = _classes(index.rows, k + 1).withColumn("query", F.col("ids")[0]).withColumn("floor", F.lit(float(threshold)))
        both = written(_blocks(classes, "cell", "query", "embedding", "ids", "floor").withColumn("widest", _reach(F.lit(float(threshold)))))
        found = _compared(both, both.drop("widest"), index.centres, k + 1, threshold)
    else:
        heads = index.rows.groupBy("embedding").agg(F.min("id").alias("id"))
        found = search(index, heads, k + 1, threshold, probes)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "id"))).alias("found"))
    others = _members(index).join(lists, "query").select("from_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("from_id")), 1, k).alias("found"))
    flat = others.select("from_id", F.posexplode("found").alias("at", "x"))
    return flat.select("from_id", F.col("x.id").alias("to_id"), (-F.col("x.far")).alias("similarity"), (F.col("at") + 1).cast("long").alias("rank"))


def _members(index: Index) -> DataFrame:
    """(from_id, query): the head of each row's class of equal vectors. The join can be split where a class is large."""
    heads = index.rows.groupBy("embedding").agg(F.min("id").alias("query"))
    return index.rows.join(heads, "embedding").select(F.col("id").alias("from_id"), "query")
