"""A cache whose entries expire unless commands hold them: as a stream with timers, as one batch, and its lookup.

Inputs are put (with a time of expiry, or none), pin and release of a key; a pin names the command that holds it. An entry goes
at the first moment from its expiry on at which nothing holds its key. What happens at a moment happens after what
expires there, so a pin at the very time of expiry comes too late, and a put there makes a new entry. A command pins a key once
however often it says so. Spark's own time to live counts from the clock of the machine and knows no pins, so timers do it here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.sources.stored import ship

#: Times are microseconds since 1970.
RESULT = "key string, expires long, removed_at long"


class Cache(StatefulProcessor):
    """One value for each key (expiry of its entry, number of pins) and a map of its pins, of which a command reads its own only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "there boolean, expires long, pins long")
        self.pins = handle.getMapState("pins", "command string", "held boolean")

    def _load(self) -> tuple:
        return tuple(self.entry.get()) if self.entry.exists() else (False, None, 0)

    def _save(self, before: tuple, after: tuple) -> None:
        old, new = (expires if there else None for there, expires, _ in (before, after))
        if old is not None and old != new:
            self.handle.deleteTimer(-(-old // 1000))
        if new is not None and old != new:
            self.handle.registerTimer(-(-new // 1000))
        if not after[0] and not after[2]:
            self.entry.clear()
        elif after != before:
            self.entry.update(after)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        there, expires, pins = before = self._load()
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at, name = r["at"], (r["command"],)
            if there and expires is not None and expires <= at and pins == 0:
                yield Row(key=key[0], expires=expires, removed_at=expires)
                there = False
            if r["kind"] == "put":
                there, expires = True, r["expires"]
            elif r["kind"] == "pin" and not self.pins.containsKey(name):
                self.pins.updateValue(name, (True,))
                pins += 1
            elif r["kind"] == "release" and self.pins.containsKey(name):
                self.pins.removeKey(name)
                pins -= 1
            # What this command lets go, or put in the past.
            if there and expires is not None and expires <= at and pins == 0:
                yield Row(key=key[0], expires=expires, removed_at=at)
                there = False
        self._save(before, (there, expires, pins))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        there, expires, pins = before = self._load()
        if there and expires is not None and expires <= expiredTimerInfo.getExpiryTimeInMs() * 1000 and pins == 0:
            yield Row(key=key[0], expires=expires, removed_at=expires)
            self._save(before, (False, None, 0))

    def close(self) -> None:
        pass


def removals_stream(commands: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """A stream of (key, expires, removed_at), each entry as it goes, from a stream of commands (key, seq, kind, command,
    expires, at). A key's commands come in order from batch to batch; those later than `lateness` are dropped by Spark."""
    ship(commands.sparkSession)
    c = commands.withColumn("time", F.col("at")).withWatermark("time", lateness)
    c = c.withColumns({"at": F.unix_micros("at"), "expires": F.unix_micros("expires")})
    return c.groupBy("key").transformWithState(Cache(), RESULT, "Append", "EventTime")


def removals(commands: DataFrame, until: str) -> DataFrame:
    """The same rows, up to a time, from all commands at once: windows in order of a key's commands, which sort and spill but keep no
    key's rows in memory. Between two commands nothing changes, so each gives at most one moment at which the entry can go."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own, key = Window.partitionBy("key", "command").orderBy("at", "seq"), Window.partitionBy("key").orderBy("at", "seq")
    kind, held = F.col("kind"), F.lag("kind").over(own) == "pin"
    holds = commands.where(kind.isin("pin", "release"))
    holds = holds.withColumn("change", F.when((kind == "pin") & ~F.coalesce(held, F.lit(False)), 1).when((kind == "release") & held, -1).otherwise(0))
    puts = commands.where(kind == "put").withColumn("change", F.lit(0))
    c = puts.unionByName(holds).withColumns({"at": micros("at"), "expires": micros("expires")})
    past = key.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({
        "pins": F.sum("change").over(past), "entry": F.sum((kind == "put").cast("long")).over(past),
        "ends": F.last(F.when(kind == "put", F.struct("expires")), ignorenulls=True).over(past)["expires"], "next": F.lead("at").over(key),
    })
    c = c.withColumn("moment", F.greatest("ends", "at"))
    end = F.unix_micros(F.lit(until).cast("timestamp"))
    free = c.where((F.col("entry") > 0) & F.col("ends").isNotNull() & (F.col("pins") == 0) & (F.col("moment") <= F.least(F.coalesce("next", end), end)))
    return free.groupBy("key", "entry").agg(F.min("ends").alias("expires"), F.min("moment").alias("removed_at")).drop("entry")


def lookup(requests: DataFrame, entries: DataFrame, commands: DataFrame, now: str) -> DataFrame:
    """The requests (key, command, others) whose entry (key, expires_at) may be used: one that has not expired, or one that the asking command
    itself, unfinished (key, command, done), holds. An entry kept for one command is no hit for another."""
    holds = commands.where(~F.col("done")).select("key", "command").distinct().withColumn("mine", F.lit(True))
    hit = requests.join(entries, "key").join(holds, ["key", "command"], "left")
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
    return hit.where(live | F.col("mine")).withColumn("pinned", ~live).drop("mine")
