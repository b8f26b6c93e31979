"""The task queue as a stream: a value for each operation, and timers for what is retried or deferred.

Inputs are commands of an operation: submit, claim, done, failed, defer and cancel. Each operation has one state; an
attempt that failed waits for the next after a delay, and after the last attempt the operation is failed for good. A
timer of its own brings an operation back to pending when its delay is over, whether or not anything else happens.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.sources.stored import ship

#: Attempts of an operation, and seconds before the next one.
ATTEMPTS, DELAY = 3, 60
FINAL = ("completed", "failed", "cancelled")
#: Times are microseconds since 1970.
STATE = "status string, attempts int, worker string, due long, at long, seq long"
RESULT = f"operation_id long, {STATE}"
SECOND = 1_000_000


def step(state: dict[str, Any] | None, command: dict[str, Any], attempts: int = ATTEMPTS, delay: int = DELAY) -> dict[str, Any] | None:
    """The state of an operation after a command, by the queue's rules; None as long as it was never submitted.

    A final state takes no command. A claim needs a pending operation whose delay is over. done, failed and defer are
    the claiming worker's to say; others, late and repeated ones change nothing. A cancellation ends what is not final.
    """
    kind, at, worker = command["kind"], command["at"], command["worker"]
    if state is None:
        return {"status": "pending", "attempts": 0, "worker": None, "due": None, "at": at, "seq": command["seq"]} if kind == "submit" else None
    new = dict(state)
    if state["status"] in FINAL:
        return state
    waiting = state["due"] is not None and state["due"] > at
    mine = state["status"] == "processing" and state["worker"] == worker
    if kind == "claim" and state["status"] == "pending" and not waiting:
        new |= {"status": "processing", "worker": worker, "attempts": state["attempts"] + 1, "due": None}
    elif kind == "done" and mine:
        new |= {"status": "completed"}
    elif kind == "failed" and mine:
        over = state["attempts"] >= attempts
        new |= {"status": "failed" if over else "retrying", "worker": None, "due": None if over else at + SECOND * delay * 2 ** (state["attempts"] - 1)}
    elif kind == "defer" and mine:
        # What a worker puts off is no attempt.
        new |= {"status": "deferred", "worker": None, "attempts": state["attempts"] - 1, "due": at + SECOND * (command["seconds"] or delay)}
    elif kind == "cancel":
        new |= {"status": "cancelled", "worker": None, "due": None}
    else:
        return state
    return new | {"at": at, "seq": command["seq"]}


def wake(state: dict[str, Any], now: int) -> dict[str, Any]:
    """A retried or deferred operation is pending again when its time has come."""
    if state["status"] in ("retrying", "deferred") and state["due"] is not None and state["due"] <= now:
        return state | {"status": "pending", "at": state["due"], "due": None}
    return state


def replay(commands: list[dict[str, Any]], attempts: int = ATTEMPTS, delay: int = DELAY) -> dict[str, Any] | None:
    """The state after an operation's commands in order of time and number: what the stream has to agree with."""
    state = None
    for c in sorted(commands, key=lambda c: (c["at"], c["seq"])):
        if state is not None:
            state = wake(state, c["at"])
        state = step(state, c, attempts, delay)
    return state


class Queue(StatefulProcessor):
    """One value for each operation, and a timer at its due time."""

    def __init__(self, attempts: int = ATTEMPTS, delay: int = DELAY) -> None:
        self.attempts, self.delay = attempts, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("operation", STATE)

    def _load(self) -> dict[str, Any] | None:
        got = self.value.get() if self.value.exists() else None
        return None if got is None else dict(zip(("status", "attempts", "worker", "due", "at", "seq"), got, strict=True))

    def _save(self, before: dict[str, Any] | None, state: dict[str, Any] | None) -> None:
        if state is None or state == before:
            return
        old, new = before and before["due"], state["due"]
        if old and old != new:
            self.handle.deleteTimer(-(-old // 1000))
        if new and old != new:
            self.handle.registerTimer(-(-new // 1000))
        self.value.update(tuple(state[k] for k in ("status", "attempts", "worker", "due", "at", "seq")))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = state = self._load()
        for c in sorted((r.asDict() for r in rows), key=lambda c: (c["at"], c["seq"])):
            if state is not None:
                state = wake(state, c["at"])
            state = step(state, c, self.attempts, self.delay)
        self._save(before, state)
        if state is not None and state != before:
            yield Row(operation_id=key[0], **state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        before = self._load()
        if before is None:
            return
        state = wake(before, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(before, state)
        if state != before:
            yield Row(operation_id=key[0], **state)

    def close(self) -> None:
        pass


def states(commands: DataFrame, lateness: str = "1 minute", attempts: int = ATTEMPTS, delay: int = DELAY) -> DataFrame:
    """A stream of (operation_id, status, attempts, worker, due, at, seq): each change of an operation, from a stream of commands
    (operation_id, seq, kind, worker, seconds, at). Commands later than `lateness` are dropped by Spark, as in any stream."""
    ship(commands.sparkSession)
    c = commands.withColumn("time", F.col("at")).withWatermark("time", lateness).withColumn("at", F.unix_micros("at"))
    return c.groupBy("operation_id").transformWithState(Queue(attempts, delay), RESULT, "Update", "EventTime")


def replayed(commands: DataFrame, attempts: int = ATTEMPTS, delay: int = DELAY) -> DataFrame:
    """The last state of each operation from all commands at once, by the same rules. An operation's commands are few."""

    ship(commands.sparkSession)

    names = RESULT.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            operations, lists = batch.to_pydict().values()
            got = [{"operation_id": o, **state} for o, c in zip(operations, lists, strict=True) if (state := replay(c, attempts, delay)) is not None]
            columns = [pa.array([g[n] for g in got], kind) for n, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    command = F.struct("kind", "worker", "seconds", F.unix_micros("at").alias("at"), "seq")
    # A row for each operation, not a group: Python takes thousands of operations at once.
    return commands.groupBy("operation_id").agg(F.collect_list(command).alias("commands")).mapInArrow(run, RESULT)
