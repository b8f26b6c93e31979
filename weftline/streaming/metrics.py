"""Metrics of rows on their way: histograms counted by the job that moves the rows, without a second pass.

A frame is observed under a name; Spark sums the counts in the tasks that run anyway. A batch job gives them to an
`Observation`, a stream with each batch to a listener, which adds them up.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counts(value: Column, bounds: list[float]) -> list[Column]:
    """Columns n0, n1, ...: values at or under each bound and over the one before; the last is for all others, nulls too. total is the
    sum of the values."""
    out, low = [], None
    for i, b in enumerate(bounds):
        inside = (value <= b) if low is None else (value > low) & (value <= b)
        out.append(F.count_if(inside).alias(f"n{i}"))
        low = b
    return [*out, F.count_if(value.isNull() | (value > low)).alias(f"n{len(bounds)}"), F.sum(value.cast("double")).alias("total")]


def observed(rows: DataFrame, name: str | Observation, value: str, bounds: list[float]) -> DataFrame:
    """The same rows, whose values are counted as they pass."""
    return rows.observe(name, *counts(F.col(value), bounds))


def histogram(got: dict, bounds: list[float]) -> dict[float | None, int]:
    """Counts by upper bound (None: over all of them) of an observation; bounds without a value are left out."""
    return {u: got[f"n{i}"] for i, u in enumerate([*map(float, bounds), None]) if got[f"n{i}"]}


class Totals(StreamingQueryListener):
    """Sums of what streams observe, by name. A batch that is run again replaces its own figures, so it counts once."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._before: dict[str, dict] = {}
        self._last: dict[tuple[str, str], tuple[int, dict]] = {}

    def add(self, query: str, batch: int, name: str, figures: dict) -> None:
        with self._lock:
            last = self._last.get((query, name))
            if last is not None and batch < last[0]:
                return
            if last is not None and batch > last[0]:
                self._before[name] = _sum(self._before.get(name, {}), last[1])
            self._last[query, name] = batch, figures

    def get(self, name: str) -> dict:
        with self._lock:
            out = self._before.get(name, {})
            for (_, n), (_, figures) in self._last.items():
                if n == name:
                    out = _sum(out, figures)
            return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, figures in p.observedMetrics.items():
            self.add(str(p.id), p.batchId, name, figures.asDict() if isinstance(figures, Row) else dict(figures))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _sum(a: dict, b: dict) -> dict:
    return {k: (a.get(k) or 0) + (b.get(k) or 0) for k in {**a, **b}}
