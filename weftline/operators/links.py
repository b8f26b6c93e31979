"""Links between facts: nearest in time, similar, of one entity, causal; and how they are stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.temporal import decay_weight, link_weight, micros
from weftline.operators.rows import dealt, top_per
from weftline.sources.stored import ship, written


def with_edges(base: DataFrame, part: list[str], n: int) -> DataFrame:
    """Rows (id, part, t, cut, guest) with guests in each cut of a part: the n rows before its first and after its last.

    Only the n first and n last rows of each cut meet in a window per part. Those next to a cut there are those next
    to it in the whole part, since a cut of fewer than n rows is there with all of them.
    """
    own = Window.partitionBy(*part, "cut")
    ends = base.withColumn("a", F.row_number().over(own.orderBy("t", "id"))).withColumn("z", F.row_number().over(own.orderBy(F.desc("t"), F.desc("id"))))
    w = Window.partitionBy(*part).orderBy("t", "id")
    row = F.struct("id", "t")
    near = ends.where((F.col("a") <= n) | (F.col("z") <= n)).select(
        *part, "cut", "a", "z", F.collect_list(row).over(w.rowsBetween(-n, -1)).alias("before"), F.collect_list(row).over(w.rowsBetween(1, n)).alias("after")
    )
    none = F.array().cast("array<struct<id:bigint,t:bigint>>")
    both = F.concat(F.when(F.col("a") == 1, F.col("before")).otherwise(none), F.when(F.col("z") == 1, F.col("after")).otherwise(none))
    guests = near.where("a = 1 or z = 1").select(*part, "cut", F.explode(both).alias("o"))
    return base.select("id", *part, "t", "cut", F.lit(False).alias("guest")).union(guests.select("o.id", *part, "o.t", "cut", F.lit(True)))


def nearest_in_time(units: DataFrame, k: int, part: list[str], each_side: int | None = None, rows: int = 1_000_000) -> DataFrame:
    """(from_id, to_id, hours): for each unit the k nearest of its part by time, looked for among the
    each_side before it and after it in (time, id) order.

    A window sees each unit's neighbours by position, so no join is needed and the cost is linear: frames of each_side
    rows either way. Over `rows` units, time is cut into equal lengths that hold as many in the mean, and each cut gets
    copies of the rows next to it, so that a part of a third of all units spreads over many tasks.
    """
    n = each_side or k
    base = units.where("event_date is not null").select(F.col("id").cast("long").alias("id"), *part, micros(F.col("event_date")).alias("t"))
    total, low, high = base.agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    split = total > rows
    if split:
        length = max(1, (high - low + 1) // -(-total // rows))
        base = with_edges(dealt(base.withColumn("cut", F.floor((F.col("t") - low) / length)), total, [*part, "cut"], rows // 4), part, n)
        base = dealt(base, total, [*part, "cut"], rows // 4)
    w = Window.partitionBy(*part, *(["cut"] if split else [])).orderBy("t", "id")
    around = F.struct("id", "t")
    beside = F.concat(F.collect_list(around).over(w.rowsBetween(-n, -1)), F.collect_list(around).over(w.rowsBetween(1, n)))
    sided = base.select("id", "t", beside.alias("near"), (F.col("guest") if split else F.lit(False)).alias("guest")).where("not guest")
    # The k nearest of a unit are among those of its row, so no others leave the task.
    by_time = F.array_sort(F.transform("near", lambda o: F.struct((F.abs(o["t"] - F.col("t")) / 3.6e9).alias("hours"), o["id"].alias("to_id"))))
    flat = sided.select(F.col("id").alias("from_id"), F.explode(F.slice(by_time, 1, k)).alias("o")).select("from_id", "o.to_id", "o.hours")
    return top_per(dealt(flat, k * total, ["from_id"], 4 * rows) if split else flat, ["from_id"], [F.asc("hours"), F.asc("to_id")], k)


def range_join(left: DataFrame, right: DataFrame, part: list[str], hours: float, each: int = 20_000_000) -> DataFrame:
    """(from_id, to_id, seconds): pairs of a part at most `hours` apart. Both sides fall into buckets of that
    length; each left row looks into its own and the two beside it, an equi-join.

    There are as many pairs as the square of the density says, so tasks are dealt by pairs and not by rows: a bucket of more
    than `each` is met in slices of its left rows. Rows are in order of time, which keeps equal weights and ids together.
    """
    size = int(hours * 3_600_000_000)
    bucket = lambda t: F.floor(t / size).cast("long")
    a = left.select(*part, F.col("id").alias("from_id"), micros(F.col("event_date")).alias("ta"))
    a = a.withColumn("bucket", F.explode(F.array(*[bucket(F.col("ta")) + d for d in (-1, 0, 1)])))
    b = right.select(*part, F.col("id").alias("to_id"), micros(F.col("event_date")).alias("tb")).withColumn("bucket", bucket(F.col("tb")))
    key = [*part, "bucket"]
    load = a.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).join(b.groupBy(*key).agg(F.count(F.lit(1)).alias("__m")), key)
    load = written(load.select(*key, (F.col("__n") * F.col("__m")).alias("__pairs")))
    total = load.agg(F.sum("__pairs")).first()[0] or 0
    slices = load.select(*key, F.ceil(F.col("__pairs") / each).cast("int").alias("__slices"))
    a = a.join(slices, key).withColumn("__slice", F.pmod(F.xxhash64("from_id"), F.col("__slices")).cast("int")).drop("__slices")
    b = b.join(slices, key).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))).drop("__slices")
    met = [*key, "__slice"]
    # Spark leaves out a sort in front of a join, unless something stands between that depends on the order.
    kept = F.monotonically_increasing_id() >= 0
    a = dealt(a, total, met, each).sortWithinPartitions(*met, "ta", "from_id").where(kept)
    b = dealt(b, total, met, each).sortWithinPartitions(*met, "tb", "to_id").where(kept)
    pairs = a.join(b.hint("merge"), met).where((F.abs(F.col("ta") - F.col("tb")) <= size) & (F.col("from_id") != F.col("to_id")))
    return pairs.select("from_id", "to_id", (F.abs(F.col("ta") - F.col("tb")) / 1e6).alias("seconds"))


#: Bands at most that a range of time is cut in, units that meet others in turn, and how many of these at once.
BANDS, TURN, RUN = 8, 64, 256
#: Pairs that a task turns into rows at once.
PAIRS_AT_ONCE = 500_000


def _runs(ta: np.ndarray, ia: np.ndarray, tb: np.ndarray, ib: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit of a, start, end) of runs of b, both sorted by time and id, that lie from `first` to `last` after a unit of a; of
    those at its own time the ones with a larger id. Runs are whole eights, in turns; what is left over comes last."""
    start, end = np.searchsorted(tb, ta + first), np.searchsorted(tb, ta + last, "right")
    if not first:
        order = np.lexsort((np.repeat([0, 1], [len(tb), len(ta)]), np.concatenate([ib, ia]), np.concatenate([tb, ta])))
        of_a = order >= len(tb)
        start[order[of_a] - len(tb)] = np.cumsum(~of_a)[of_a]
    end = np.maximum(start, end)
    many = np.where(end > start, (end - 1) // RUN - start // RUN + 1, 0)
    a = np.repeat(np.arange(len(ta)), many)
    run = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + start[a] // RUN
    lo, hi = np.maximum(start[a], run * RUN), np.minimum(end[a], (run + 1) * RUN)
    whole_lo, whole_hi = -(-lo // 8) * 8, hi // 8 * 8
    whole = whole_lo < whole_hi
    turn = np.flatnonzero(whole)[np.lexsort((a[whole], run[whole], a[whole] // TURN))]
    parts = [(a[turn], whole_lo[turn], whole_hi[turn])]
    parts += [(a[m], x[m], y[m]) for x, y in ((lo, np.where(whole, whole_lo, hi)), (np.where(whole, whole_hi, hi), hi)) for m in [x < y]]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def decayed_pairs(units: DataFrame, part: list[str], hours: float, sigma: float = 86_400.0, each: int = 20_000_000) -> DataFrame:
    """(from_id, to_id, weight): all pairs of units of a part at most `hours` apart, both ways, weighted by exponential decay with six
    places.

    There are as many rows as the square of the density says, so each pair is found once, at its earlier unit, and tasks are
    dealt by pairs: a task has the units of a cut of time and those that are a band of the range later, and what is denser than
    `each` rows is met in slices. It holds times and ids of these and PAIRS_AT_ONCE pairs. A run of others follows each unit, and the same
    pairs the other way: equal ids and weights stand where a writer's codec finds them.
    """
    ship(units.sparkSession)
    size = int(hours * 3_600_000_000)
    timed = units.select(*part, F.col("id").cast("long").alias("id"), micros(F.col("event_date")).alias("t")).dropna(subset=[*part, "id", "t"])
    low, high = timed.agg(F.min("t"), F.max("t")).first()
    most = timed.groupBy(*part).count().agg(F.max("count")).first()[0] or 1
    span = (high or 0) - (low or 0) + 1
    count = max(1, min(BANDS, most * size // span // RUN))
    width = size // count + 1
    # So long that a task has `each` rows, both ways, or a twentieth as many units, where the largest part is spread evenly; in whole bands.
    apart = span / most / width
    wide = max(1, min(-(-span // width), int(each / 2 * apart**2), int(each / 20 * apart)))
    bands = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    fine = F.floor((F.col("t") - (low or 0)) / width)
    a = timed.withColumn("band", bands).withColumn("cut", F.floor(fine / wide))
    b = timed.withColumn("band", bands).withColumn("at", fine - F.col("band"))
    b = b.withColumn("cut", F.explode(F.array_distinct(F.array(F.floor(F.col("at") / wide), F.floor((F.col("at") - 1) / wide))))).drop("at")
    key = [*part, "band", "cut"]
    dense = timed.groupBy(*part, fine.alias("fine")).agg(F.count(F.lit(1)).alias("n"))
    later = dense.withColumn("band", bands).withColumn("fine", F.explode(F.array(F.col("fine") - F.col("band"), F.col("fine") - F.col("band") - 1))).withColumnRenamed("n", "m")
    load = dense.join(later, [*part, "fine"]).groupBy(*part, "band", F.floor(F.col("fine") / wide).alias("cut")).agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))
    load = written(load)
    total = load.agg(F.sum("pairs")).first()[0] or 0
    slices = load.select(*key, F.ceil(F.col("pairs") / each).cast("int").alias("slices"))
    a = a.join(slices, key).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    b = b.join(slices, key).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = [*key, "slice"]
    sides = a.select(*met, "t", "id", F.lit(True).alias("first")).union(b.select(*met, "t", "id", F.lit(False)))
    row = F.struct("t", "id")
    groups = dealt(sides, total, met, each // 4 or 1).groupBy(*met).agg(F.collect_list(F.when(F.col("first"), row)).alias("a"), F.collect_list(F.when(~F.col("first"), row)).alias("b"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                band, sorted_ = batch["band"][n].as_py(), []
                for side in ("a", "b"):
                    x = batch[side].slice(n, 1).flatten()
                    t, ids = pc.struct_field(x, "t").to_numpy(), pc.struct_field(x, "id").to_numpy()
                    order = np.lexsort((ids, t))
                    sorted_ += [t[order], ids[order]]
                ta, ia, tb, ib = sorted_
                at, lo, hi = _runs(ta, ia, tb, ib, band * width, min(size, (band + 1) * width - 1))
                ends = np.concatenate([[0], np.cumsum(hi - lo)])
                begin = 0
                while begin < len(at):
                    stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PAIRS_AT_ONCE, "right")) - 1)
                    yield from _both_ways(ta, ia, tb, ib, at[begin:stop], lo[begin:stop], hi[begin:stop], sigma)
                    begin = stop

    return groups.select("band", "a", "b").mapInArrow(pairs, "from_id long, to_id long, weight double")


def _both_ways(ta: np.ndarray, ia: np.ndarray, tb: np.ndarray, ib: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, sigma: float) -> Iterator[pa.RecordBatch]:
    """The rows of runs: those of a run one way, then the other."""
    size = hi - lo
    before = np.repeat(np.cumsum(size) - size, size)
    i, k = np.repeat(at, size), np.arange(size.sum())
    j = k - before + np.repeat(lo, size)
    one, other = ia[i], ib[j]
    there = k + before
    back = there + np.repeat(size, size)
    weight = np.round(np.exp(-((tb[j] - ta[i]) / 1e6) / sigma), 6)
    out = [np.empty(2 * len(k), np.int64), np.empty(2 * len(k), np.int64), np.empty(2 * len(k))]
    for column, x, y in zip(out, (one, other, weight), (other, one, weight), strict=True):
        column[there], column[back] = x, y
    if (one == other).any():
        keep = out[0] != out[1]
        out = [c[keep] for c in out]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["from_id", "to_id", "weight"])



def _halos(known: DataFrame, asked: DataFrame, part: list[str], n: int, low: int, length: int) -> DataFrame:
    """(part, cut, before, after) for each cut of asked: the times of the n-th unit before it and after it, null where there are
    fewer. The n first and n last units of each cut, which are few, meet in a window per part."""
    first = top_per(known, [*part, "cut"], [F.asc("t"), F.asc("id")], n)
    last = top_per(known, [*part, "cut"], [F.desc("t"), F.desc("id")], n)
    ends = first.union(last).select(*part, "t", "id").distinct()
    start = asked.select(*part, "cut").distinct().withColumn("at", F.lit(low) + F.col("cut") * length)
    none = F.lit(None).cast("long")
    rows = ends.select(*part, F.col("t").alias("at"), "t", "id", none.alias("starts"), none.alias("ends"))
    rows = rows.union(start.select(*part, "at", none, none, "cut", none)).union(start.select(*part, F.col("at") + length, none, none, none, "cut"))
    # A mark sorts before the units at its time, and is no unit itself.
    over = f"(PARTITION BY {', '.join(part)} ORDER BY at, id NULLS FIRST)"
    seen = rows.select(*part, F.coalesce("starts", "ends").alias("cut"), "starts", "ends", F.expr(f"lag(t, {n}) IGNORE NULLS OVER {over}").alias("b"), F.expr(f"lead(t, {n}) IGNORE NULLS OVER {over}").alias("a"))
    mine = [F.max(F.when(F.col(m).isNotNull(), F.col(c))).alias(out) for m, c, out in (("starts", "b", "before"), ("ends", "a", "after"))]
    return seen.where("cut is not null").groupBy(*part, "cut").agg(*mine)


def decayed_neighbours(units: DataFrame, seeds: DataFrame, part: list[str], hours: float = 24, k: int = 10, sigma: float = 86_400.0, rows: int = 1_000_000) -> DataFrame:
    """Neighbours of seeds within a range of time, weighted by exponential decay, k per seed.

    However many units are in the range, each time of a seed looks only at the k + 1 nearest and at those whose rounded
    weight may equal theirs; of units at one time the smallest ids are enough. Time is cut so that a cut holds `rows`
    in the mean, and each cut gets guests up to the k + 1 units before and after it: nothing in it looks further.
    """
    import numpy as np
    import pyarrow as pa

    span, n = int(hours * 3_600_000_000), k + 1
    # Weights that differ by less than a rounding step are of times this close, at the far end of the range.
    close = span if hours * 3600 / sigma > 30 else min(span, int(2e-6 * sigma * 1e6 * np.exp(hours * 3600 / sigma)) + 1)
    # Names of their own keep both sides apart where seeds are units.
    timed = lambda df: df.select(*[F.col(c).alias(c) for c in part], F.col("id").cast("long").alias("id"), micros(F.col("event_date")).alias("t")).dropna(subset=[*part, "t"])
    known, of = top_per(timed(units), [*part, "t"], [F.asc("id")], n).drop("rank"), timed(seeds)
    total, low, high = timed(units).union(of).agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    length = max(1, ((high or 0) - (low or 0) + 1) // max(1, -(-total // rows)))
    cut = F.floor((F.col("t") - (low or 0)) / length)
    known, asked = known.withColumn("cut", cut), of.select(*part, "t").distinct().withColumn("cut", cut)
    halo = _halos(known, asked, part, n, low or 0, length)
    start = F.lit(low or 0) + F.col("cut") * length
    first = F.greatest(start - span, F.coalesce(F.col("before") - close, start - span)).alias("first")
    last = F.least(start + length + span, F.coalesce(F.col("after") + close, start + length + span)).alias("last")
    inside = F.broadcast(halo.select(*part, F.col("cut").alias("of_cut"), first, last))
    guests = known.join(inside, part).where((F.col("cut") != F.col("of_cut")) & F.col("t").between(F.col("first"), F.col("last")))
    both = known.select(*part, "cut", "t", "id").union(guests.select(*part, "of_cut", "t", "id"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        at, t, ids = left["t"].to_numpy(), right["t"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(t, kind="stable")
        t, ids = t[order], ids[order]
        counts, got, far = np.zeros(len(at), np.int32), [], []
        for lo in range(0, len(at) if len(t) else 0, 50_000):
            x = at[lo : lo + 50_000]
            beside = np.searchsorted(t, x)[:, None] + np.arange(-n, n)[None, :]
            d = np.where((beside >= 0) & (beside < len(t)), np.abs(t[np.clip(beside, 0, len(t) - 1)] - x[:, None]), span)
            reach = np.minimum(span, np.partition(d, n - 1, axis=1)[:, n - 1] + close)
            a, z = np.searchsorted(t, x - reach), np.searchsorted(t, x + reach, "right")
            ends = np.concatenate([[0], np.cumsum(z - a)])
            b = 0
            while b < len(x):  # some seeds at a time, so that dense times need no more memory
                e = max(b + 1, int(np.searchsorted(ends, ends[b] + 2_000_000, "right")) - 1)
                seed = np.repeat(np.arange(b, e), (z - a)[b:e])
                i = np.arange(len(seed)) - (ends[seed] - ends[b]) + a[seed]
                d = np.abs(t[i] - x[seed])
                best = np.lexsort((ids[i], -np.round(np.exp(-(d / 1e6) / sigma), 6), seed))
                best = best[np.arange(len(seed)) - (ends[seed] - ends[b]) < n]
                counts[lo + b : lo + e] = np.minimum((z - a)[b:e], n)
                got.append(ids[i[best]])
                far.append(d[best])
                b = e
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        flat = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()))
        return left.select([*part, "t"]).append_column("to_id", flat(got)).append_column("far", flat(far))

    kinds = ", ".join(f"`{c}` {units.schema[c].dataType.simpleString()}" for c in part)
    lists = asked.groupBy(*part, "cut").cogroup(both.groupBy(*part, "cut")).applyInArrow(nearest, f"{kinds}, t long, to_id array<long>, far array<long>")
    mine = of.withColumnRenamed("id", "from_id").join(lists, [*part, "t"])
    others = F.slice(F.filter(F.arrays_zip("to_id", "far"), lambda x: x["to_id"] != F.col("from_id")), 1, k)
    near = mine.select("from_id", F.posexplode(others).alias("at", "x")).select("from_id", F.col("x.to_id").alias("to_id"), (F.col("x.far") / 1e6).alias("seconds"), (F.col("at") + 1).cast("long").alias("rank"))
    return near.select("from_id", "to_id", "seconds", F.round(decay_weight(F.col("seconds"), sigma), 6).alias("weight"), "rank")


def temporal_links(units: DataFrame, part: list[str], each_side: int = 20, per_unit: int = 20) -> DataFrame:
    """Temporal links: the nearest of the same kind in time, weight 1 - hours/24 but at least 0.3. Duplicates go
    before the cap."""
    near = nearest_in_time(units, per_unit, part, each_side)
    return near.select("from_id", "to_id", F.lit("temporal").alias("link_type"), F.round(link_weight(F.col("hours")), 6).alias("weight"))


def cap_links(links: DataFrame, per_unit: int) -> DataFrame:
    """The heaviest links of each unit."""
    return top_per(links, ["from_id"], [F.desc("weight"), F.asc("to_id"), F.asc("link_type")], per_unit).drop("rank")


def semantic_links(neighbours: DataFrame) -> DataFrame:
    """Links from (from_id, to_id, similarity), weights within 0..1."""
    w = F.least(F.greatest("similarity", F.lit(0.0)), F.lit(1.0))
    return neighbours.select("from_id", "to_id", F.lit("semantic").alias("link_type"), w.alias("weight"))


def entity_links(unit_entities: DataFrame, new_units: DataFrame, most: int = 10, each: int = 1_000_000) -> DataFrame:
    """Links in both directions between units of one entity. Of each entity the newest units by id count, `most` and as
    many as are new in all; of these, new units link with the `most` oldest that were there before, and the `most`
    oldest new ones with each other. So a unit has few partners, however many units an entity has.

    An entity's rows meet once, dealt by their number; each new one is told its few partners there. No link arises twice, so
    none are compared.
    """
    new = new_units.select("unit_id").distinct().withColumn("new", F.lit(True))
    marked = written(unit_entities.join(new, "unit_id", "left").select("entity_id", "unit_id", F.coalesce("new", F.lit(False)).alias("new")))
    touched = marked.join(marked.where("new").select("entity_id").distinct(), "entity_id", "left_semi")
    recent = top_per(dealt(touched, marked.count(), ["entity_id"], each), ["entity_id"], [F.desc("unit_id")], most + new.count()).drop("rank")
    own = Window.partitionBy("entity_id", "new").orderBy("unit_id")
    placed = recent.withColumn("place", F.row_number().over(own)).withColumn("before", F.lag("unit_id").over(own))
    # A unit that is given twice takes two places and stands for itself once.
    placed = placed.where("before IS NULL OR before <> unit_id")
    partner = F.when(F.col("place") <= most, F.struct(F.col("unit_id").alias("other"), F.col("new").alias("other_new")))
    met = placed.withColumn("partners", F.collect_list(partner).over(Window.partitionBy("entity_id"))).where("new")
    one = met.select("entity_id", "unit_id", "place", F.inline("partners")).where((F.col("unit_id") != F.col("other")) & (~F.col("other_new") | (F.col("place") <= most)))
    # New ones link with each other from both ends already.
    ways = F.when(F.col("other_new"), F.array(F.struct(F.col("unit_id").alias("from_id"), F.col("other").alias("to_id")))).otherwise(
        F.array(F.struct(F.col("unit_id").alias("from_id"), F.col("other").alias("to_id")), F.struct(F.col("other").alias("from_id"), F.col("unit_id").alias("to_id")))
    )
    both = one.select("entity_id", F.inline(ways)).select("from_id", "to_id", "entity_id")
    return both.withColumn("link_type", F.lit("entity")).withColumn("weight", F.lit(1.0))


def causal_links(facts: DataFrame) -> DataFrame:
    """caused_by links from facts (id, position, causes: array of earlier positions) of one document each;
    targets must be earlier facts that were kept. Needs document_id."""
    src = facts.select("document_id", F.col("id").alias("from_id"), F.col("position").alias("p"), F.explode("causes").alias("target"))
    to = facts.select("document_id", F.col("id").alias("to_id"), F.col("position").alias("target"))
    return src.where("target < p").join(to, ["document_id", "target"]).select("from_id", "to_id", F.lit("caused_by").alias("link_type"), F.lit(1.0).alias("weight")).distinct()


def insert_links(existing: DataFrame, new: DataFrame, units: DataFrame, entity: Column | None = None) -> DataFrame:
    """New links whose ends exist and that are not stored yet, one per (from, to, type, entity)."""
    key = ["from_id", "to_id", "link_type", "entity_key"]
    mark = lambda df: df.withColumn("entity_key", F.coalesce(F.col("entity_id").cast("string"), F.lit("")) if "entity_id" in df.columns else F.lit(""))
    ids = units.select("id")
    ok = new.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    first = top_per(mark(ok), key, [F.desc("weight")], 1).drop("rank")
    return first.join(mark(existing), key, "left_anti").drop("entity_key")
