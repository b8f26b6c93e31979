"""Rolling exact median and median absolute deviation over time windows.

A window's values are a histogram in two levels: a value's rank among the values of its chunk has a high and a low
digit, coarse counts stand over fine counts, and only values that occur have a rank. The window slides by adding and
taking away counts. The median is found by a walk over the coarse counts and then over one fine row; from it the
search expands outward: of the k values nearest to the median some lie to the left and the others to the right,
each side in order, and how many on either is found by bisection.

Spark cuts the time of each series into chunks of a bounded number of rows and sends each chunk a halo: what came
in the window before it. Within a chunk the moments that are asked for are dealt to lanes, stretches that begin
with their own window and slide side by side, so that numpy moves all lanes at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, ship

#: The window in microseconds.
WINDOW = 15 * 60 * 1_000_000
#: Time is cut at multiples of powers of two. Cells have one width of chunks; slots are what the width goes by.
CELL_BITS, SLOT_BITS = 37, 27
#: Rows of a chunk, by the busiest slot of its cell.
CHUNK_ROWS = 8_192
#: A slot (134 s, a seventh of the window) is a chunk of its own up to so many rows; it is cut beyond that.
SLOT_ROWS = 1_000_000
#: Fine counts that the lanes of one chunk have together, at most (but for one lane).
MOST_COUNTS = 4_000_000


def rank_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct values in order, each value's rank, and the base of the digits: about the root of their number."""
    distinct, rank = np.unique(values, return_inverse=True)
    return distinct, rank, max(1, int(np.ceil(np.sqrt(max(1, len(distinct))))))


class Lanes:
    """Histograms of many windows side by side."""

    def __init__(self, lanes: int, distinct: np.ndarray, base: int, kind: type = np.int32) -> None:
        self.values, self.base, self.kind = distinct, base, kind
        self.coarse = np.zeros((lanes, base), kind)
        self.fine = np.zeros((lanes, base, base), kind)
        self.n = np.zeros(lanes, np.int64)

    def add(self, lane: np.ndarray, rank: np.ndarray, count: np.ndarray) -> None:
        high, few = rank // self.base, count.astype(self.kind)
        np.add.at(self.fine.reshape(-1), lane * self.base**2 + rank, few)
        np.add.at(self.coarse.reshape(-1), lane * self.base + high, few)
        self.n += np.bincount(lane, count, len(self.n)).astype(np.int64)

    def settle(self) -> None:
        """Fixes the coarse counts for walks."""
        self.upto = np.cumsum(self.coarse, axis=1, dtype=self.kind)

    def walk(self, lane: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th value (from 0) of each lane's window, in order of size; k is less than the window's count."""
        k = k.astype(self.kind)
        at = self.upto[lane]
        high = (at > k[:, None]).argmax(1)
        every = np.arange(len(lane))
        rest = k - (at[every, high] - self.coarse[lane, high])
        low = (np.cumsum(self.fine[lane, high], axis=1, dtype=self.kind) > rest[:, None]).argmax(1)
        return self.values[high * self.base + low]

    def nearest(self, lane: np.ndarray, n: np.ndarray, middle: np.ndarray, doubled: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th (from 0) of |2 v - doubled| over each window, and the one after it (k-th again if it is the last).
        middle: how many values lie to the left.

        With i of the k + 1 nearest to the left, the last of these is at middle - i, and the last to the right at
        middle + k - i: the fewest i for which the value to the left of them is no nearer than the last to the right.
        """
        both = np.concatenate([lane, lane])

        def ends(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distances of the values at two places; none is nearer than what is beyond an end."""
            at = np.concatenate([left, right])
            v = 2 * self.walk(both, np.clip(at, 0, np.concatenate([n, n]) - 1))
            return doubled - v[: len(n)], v[len(n) :] - doubled

        low, high = np.maximum(0, k + 1 - (n - middle)), np.minimum(k + 1, middle)
        while (low < high).any():
            i = (low + high) // 2
            left, right = ends(middle - 1 - i, middle + k - i)
            more = (low < high) & (left < right)
            low, high = np.where(more, i + 1, low), np.where(more, high, np.maximum(low, np.minimum(i, high)))
        left, right = ends(middle - low, middle + k - low)
        found = np.maximum(np.where(low > 0, left, -1), np.where(k + 1 > low, right, -1))
        left, right = ends(middle - 1 - low, middle + k + 1 - low)
        none = np.iinfo(np.int64).max
        after = np.minimum(np.where(low < middle, left, none), np.where(middle + k + 1 - low < n, right, none))
        return found, np.where(after == none, found, after)


def roll(at: np.ndarray, cents: np.ndarray, count: np.ndarray, asked: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, doubled median, doubled median of the deviations) of the window of each asked moment.

    at, cents, count: `count` values of `cents` at a moment, in order of time. asked: moments in order, each once.
    Where n is 0 the others are 0. A chunk may hold a halo only, and no moments.
    """
    q = len(asked)
    distinct, rank, base = rank_counts(cents)
    begin, end = np.searchsorted(at, asked - window, "right"), np.searchsorted(at, asked, "right")
    if not len(distinct) or not q:
        zero = np.zeros(q, np.int64)
        return zero, zero.copy(), zero.copy()
    held = max(1, int((end - begin).mean()))  # rows that each lane begins with
    lanes = int(min(q, max(1, np.sqrt(20_000 * q / held)), max(1, MOST_COUNTS // base**2)))
    steps = -(-q // lanes)
    lanes = -(-q // steps)
    # Places of windows of over 2^31 values need the wider counts.
    state, out = Lanes(lanes, distinct, base, np.int32 if count.sum() < 2**31 else np.int64), np.zeros((3, q), np.int64)
    lane = np.arange(lanes)

    def rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lane and the place of all rows from a to b of each."""
        size = b - a
        who = np.repeat(np.arange(len(a)), size)
        return who, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)

    old_a = old_b = np.zeros(lanes, np.int64)
    for step in range(steps):
        place = lane * steps + step
        live = place < q
        place = np.minimum(place, q - 1)
        a, b = begin[place], end[place]
        if step == 0:
            old_a, old_b = a, a
        who, what = rows(np.maximum(old_b, a), b)
        state.add(who, rank[what], count[what])
        who, what = rows(old_a, np.minimum(a, old_b))
        state.add(who, rank[what], -count[what])
        old_a, old_b = a, b
        state.settle()
        some = np.flatnonzero(live & (state.n > 0))
        out[0, place[live]] = state.n[live]
        if not len(some):
            continue
        n = state.n[some]
        low, high = (n - 1) // 2, n // 2
        doubled = state.walk(some, low) + state.walk(some, high)
        # Of an odd number the median itself counts to the right, at distance 0.
        out[1, place[some]] = doubled
        mad, after = state.nearest(some, n, high, doubled, low)
        out[2, place[some]] = mad + np.where(low == high, mad, after)
    return out[0], out[1], out[2]


def _chunk(table: pa.Table) -> pa.Table:
    """What applyInArrow gives for the rows of one chunk: own moments, and what precedes them."""
    at, cents = table["at"].to_numpy(), table["cents"]
    own, kind = table["own"].to_numpy(zero_copy_only=False), table["kind"][0].as_py()
    asked = np.unique(at[own])
    known = cents.is_valid().to_numpy()
    at, count = at[known], table["count"].to_numpy()[known]
    cents = cents.drop_null().to_numpy()
    order = np.argsort(at, kind="stable")
    got = roll(at[order], cents[order], count[order], asked)
    return pa.table({"kind": pa.array([kind] * len(asked), pa.string()), "at": asked, "n": got[0], "median2": got[1], "mad4": got[2]})


def _widths(clicks: DataFrame) -> DataFrame:
    """(kind, cell, bits): chunks of a cell are 2^bits microseconds wide, by its busiest slot."""
    slots = clicks.groupBy("kind", F.shiftright("at", SLOT_BITS).alias("slot")).agg(F.count(F.lit(1)).alias("rows"))
    most = slots.groupBy("kind", F.shiftright("slot", CELL_BITS - SLOT_BITS).alias("cell")).agg(F.max("rows").alias("rows"))
    log2 = lambda x: F.log2(x)
    wide = F.least(F.lit(CELL_BITS), SLOT_BITS + F.floor(log2(CHUNK_ROWS / F.col("rows"))))
    fine = F.greatest(F.lit(0), SLOT_BITS - F.ceil(log2(F.col("rows") / SLOT_ROWS)))
    bits = F.when(F.col("rows") <= CHUNK_ROWS, wide).when(F.col("rows") <= SLOT_ROWS, SLOT_BITS).otherwise(fine)
    return most.select(F.col("kind").alias("w_kind"), F.col("cell").alias("w_cell"), bits.cast("int").alias("bits"))


def moments(clicks: DataFrame) -> DataFrame:
    """(kind, at, n, median2, mad4) of each moment (microseconds) of each series, from rows of kind, at and cents.

    Every row goes to its own chunk and to those that begin within a window after it. Where a chunk is shorter than
    the window, what no moment of it can lose is not told apart by time, so that a halo is at most a count for each
    value beside the rows that do leave.
    """
    flat = clicks.select("kind", "at", "cents")
    bits, cell = F.col("bits"), F.shiftright("at", CELL_BITS)
    # A row belongs to its own cell and, close to its end, also to the next.
    until = F.shiftright(F.col("at") + (WINDOW - 1), CELL_BITS)
    placed = flat.withColumn("cell", F.explode(F.when(until > cell, F.array(cell, until)).otherwise(F.array(cell))))
    widths = _widths(flat)
    joined = placed.join(widths, placed["kind"].eqNullSafe(widths["w_kind"]) & (placed["cell"] == widths["w_cell"]))
    wide = lambda x: F.call_function("shiftright", x, bits)
    first = F.when(F.col("cell") == cell, wide(F.col("at"))).otherwise(F.call_function("shiftleft", F.col("cell"), CELL_BITS - bits))
    last = F.least(wide(F.col("at") + (WINDOW - 1)), F.call_function("shiftleft", F.col("cell") + 1, CELL_BITS - bits) - 1)
    chunks = joined.withColumn("chunk", F.explode(F.sequence(first, last)))
    own = F.col("chunk") == wide(F.col("at"))
    # A halo's row that stays for all of the chunk stands at the time that just does not leave it.
    ends = F.call_function("shiftleft", F.col("chunk") + 1, bits)
    shown = F.when(own, F.col("at")).otherwise(F.least(F.col("at"), ends - WINDOW))
    rows = chunks.select("kind", "bits", "chunk", own.alias("own"), shown.alias("at"), "cents")
    counted = rows.groupBy("kind", "bits", "chunk", "own", "at", "cents").agg(F.count(F.lit(1)).alias("count"))
    return counted.groupBy("kind", "bits", "chunk").applyInArrow(_chunk, "kind string, at long, n long, median2 long, mad4 long")


def zoneless_micros(c: Column) -> Column:
    """Microseconds since 1970 of times without a zone, hours that a session's zone leaves out included."""
    parts = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + parts.cast("long") * 1_000_000 + (F.extract(F.lit("second"), c) * 1_000_000).cast("long")


def rolling_medians(clicks: DataFrame, id_col: str = "click_id", time_col: str = "ts", kind_col: str = "kind", value_col: str = "value") -> DataFrame:
    """(click_id, kind, n, median2, mad4, far) of every id once, but for those without time.

    A series is the rows of one kind; null is a kind. A window reaches from a row's time back to just before 15 minutes
    earlier. Values are cents, floor(100 value + 0.5); null, not-a-number, infinite values and those
    of 4e15 or more, which are no exact cents, give none. Of rows that
    share an id and differ, the one first in time (null last), then by kind and cents (null first) counts; rows
    without id share that. Rows of one moment share one window, whatever their number; an empty table gives no rows.
    """
    ship(clicks.sparkSession)
    value = F.col(value_col).cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 4e15)
    cents = F.when(ok, F.floor(100 * value + 0.5))
    at = zoneless_micros(F.col(time_col).cast("timestamp_ntz"))
    named = clicks.select(F.col(id_col).cast("long").alias("id"), at.alias("at"), F.col(kind_col).cast("string").alias("kind"), cents.cast("long").alias("cents"))
    once = named.groupBy("id").agg(F.min(F.struct(F.col("at").isNull().alias("late"), "at", "kind", "cents")).alias("row"))
    rows = materialize(once.where("row.at is not null").select("id", "row.at", "row.kind", "row.cents"))
    found = moments(rows).withColumnsRenamed({"kind": "k", "at": "t"})
    both = rows.join(found, (rows["at"] == found["t"]) & rows["kind"].eqNullSafe(found["k"]))
    some = F.col("n") > 0
    far = 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 2 * F.col("mad4")
    return both.select(F.col("id").alias(id_col), "kind", "n", F.when(some, F.col("median2")).alias("median2"), F.when(some, F.col("mad4")).alias("mad4"), F.when(some, far).alias("far"))
