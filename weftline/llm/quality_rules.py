"""Learned decision lists for text quality.

Statistics of each text are thresholded by rules such as `upper_share >= 0.4 AND n_words >= 20`. Sequential
covering grows one conjunction at a time on two thirds of the labelled rows (FOIL gain), prunes it on the
rest, removes what it covers and goes on. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import steady_reads

#: Labelled rows that the rules are learned from, at most about.
MAX_TRAIN = 24_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\v\f\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct")
_STATS = ", ".join(f"{c} long" for c in _COUNTS + _MORE)
#: What rules may look at: shares, which do not change when a text is repeated or cut.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "distinct_share", "words_per_line", "n_words")


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window that occurs twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = hashes.astype(np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(window):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of a whole text; all zero for null and for texts without words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: ASCII white space only
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(_WHITE):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _WHITE),
        sum(text.count(c) for c in SYMBOLS),
        dup,
        repeated_words(hashes),
        lines,
        sum(map(str.isupper, text)),
        sum(map(raw.count, b"0123456789")),
        text.count("!"),
        len(set(words)),
    )


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id, counts...) of every row."""
    steady_reads(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([text_stats(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(_COUNTS + _MORE))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in got.T]], ["doc_id", *_COUNTS, *_MORE])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {_STATS}")


def feature(name: str) -> Column:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "mean_word": lambda: per("word_chars", "n_words"),
        "symbol_share": lambda: per("n_symbols", "word_chars"),
        "dup_line_share": lambda: per("n_dup_lines", "n_lines"),
        "repeat_share": lambda: per("n_repeat_words", "n_words"),
        "upper_share": lambda: per("n_upper", "word_chars"),
        "digit_share": lambda: per("n_digits", "word_chars"),
        "bang_share": lambda: per("n_bangs", "word_chars"),
        "distinct_share": lambda: per("n_distinct", "n_words"),
        "words_per_line": lambda: per("n_words", "n_lines"),
        "n_words": lambda: F.col("n_words").cast("double"),
    }[name]()


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.bound if self.at_least else x[self.feature] < self.bound

    def column(self) -> Column:
        c = feature(self.feature)
        return c >= self.bound if self.at_least else c < self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and live.any() and not bad[live].all():
        p0, n0 = bad[live].sum(), live.sum()
        best, gain = None, 0.0
        for f in FEATURES:
            v = x[f][live]
            for bound in np.unique(np.quantile(v, np.linspace(0.01, 0.99, cuts))):
                for at_least in (True, False):
                    hit = v >= bound if at_least else v < bound
                    p, n = bad[live][hit].sum(), hit.sum()
                    if p and n < n0:
                        g = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if g > gain + 1e-12:
                            best, gain = Condition(f, at_least, float(bound)), g
        if best is None:
            break
        rule.append(best)
        live &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops final conditions while that makes (bad - good) / covered no worse on the pruning rows."""

    def worth(r: Rule) -> float:
        hit = covers(r, x, len(bad))
        p, n = bad[hit].sum(), hit.sum()
        return (2 * p - n) / n if n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, most_rules: int = 16, most_conditions: int = 4, cuts: int = 50, seed: int = 7) -> list[Rule]:
    """An ordered list of rules for bad rows. A rule is taken if at least `precision` of the labelled rows
    that it covers are bad, and at least `least` are; a rule that fails ends the list."""
    n = len(bad)
    bad = np.asarray(bad, bool)
    rules: list[Rule] = []
    live = np.ones(n, bool)
    fold = np.random.default_rng(seed).permutation(n) % 3
    while len(rules) < most_rules and bad[live].any():
        part = lambda m: ({f: v[m] for f, v in x.items()}, bad[m])
        grow, prune = part(live & (fold != 0)), part(live & (fold == 0))
        if not grow[1].any():
            break
        rule = _grow(*grow, most_conditions, cuts)
        if not rule:
            break
        for r in (_prune(rule, *prune), rule):
            hit = covers(r, x, n) & live
            ok = hit.sum() and bad[hit].sum() >= least and bad[hit].mean() >= precision
            if ok:
                break
        if not ok:
            break
        rules.append(r)
        live &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule covers: an ordered conditional expression over stats() columns."""
    out = None
    for r in rules:
        test = F.lit(True)
        for c in r:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **how) -> list[Rule]:
    """Learns from at most about max_train labelled rows, chosen by a hash of doc_id; only numbers reach the driver."""
    lab = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("l_y")).where("l_id is not null and l_y is not null")
    n = lab.count()
    if n > max_train:
        lab = lab.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    lab = lab.groupBy("l_id").agg(F.min("l_y").alias("l_y"))
    # At most about max_train ids of two numbers each.
    mine = docs.join(F.broadcast(lab), docs["doc_id"].cast("long") == lab["l_id"]).select(docs["doc_id"], docs["text"])
    rows = stats(mine).join(F.broadcast(lab), F.col("doc_id") == F.col("l_id")).select("doc_id", "l_y", *[feature(f).alias(f) for f in FEATURES]).collect()
    rows.sort(key=lambda r: tuple(r))
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn(x, np.array([r.l_y == 0 for r in rows], bool), **how)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    Null and empty texts have no words and fail the base test; equal rows are judged each.
    """
    s = stats(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return s.select("doc_id", *_COUNTS, "base_failed", "kept")
