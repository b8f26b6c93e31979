"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all thresholds. Features are counts,
log1p, of words and of words' beginnings (inflected forms share one). Fitting uses a bounded sample of the labelled rows; scoring reads every word of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, steady_reads

#: Labelled rows that fitting uses at most; they bound what reaches the driver, features included.
MAX_TRAIN = 24_000
#: Least evidence (log-likelihood ratio) for a word to become a feature.
MIN_EVIDENCE = 15.0
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Words that a Python worker remembers the features of.
REMEMBERED = 300_000
_WORD = re.compile(r"\w+")
_OUT = "doc_id long, expected_severity double, p_toxic double, rejected boolean"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *["^" + word[:k] for k in BEGINNINGS if len(word) > k]]


def count_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, k in Counter(words(text)).items():
        for f in features(w):
            out[f] += k
    return out


@dataclass
class OrdinalModel:
    """weights by feature; thresholds in rising order, one for each grade above 0; a document is
    rejected from `cut` on, the probability of grade 1 that separates the training rows best."""

    weights: dict[str, float]
    thresholds: list[float]
    cut: float = 0.5
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def _telling(self, word: str) -> tuple[str, ...]:
        got = self._known.get(word)
        if got is None:
            got = tuple(f for f in features(word) if f in self.weights)
            if len(self._known) < REMEMBERED:
                self._known[word] = got
        return got

    def grades(self, text: str | None) -> tuple[float, float]:
        """(expected grade, probability of grade 1 or more)."""
        n: Counter = Counter()
        for hit in filter(None, map(self._telling, words(text))):
            n.update(hit)
        z = sum(self.weights[f] * np.log1p(c) for f, c in n.items())
        p = [1.0 / (1.0 + np.exp(min(700.0, t - z))) for t in self.thresholds]
        return float(sum(p)), float(p[0])


def choose(seen: list[tuple[str, int, int]], nb: int, ng: int) -> list[str]:
    """The features whose presence tells toxic rows from clean ones, most telling first, by the
    log-likelihood ratio. seen: (feature, toxic rows, clean rows) of nb and ng rows."""
    if not seen:
        return []
    a, b = (np.array([x[k] for x in seen], float) for k in (1, 2))
    rate = (a + b) / (nb + ng)
    g2 = np.zeros(len(seen))
    for k, n in ((a, nb), (b, ng)):
        for part, expect in ((k, n * rate), (n - k, n * (1 - rate))):
            with np.errstate(divide="ignore", invalid="ignore"):
                g2 += np.where(part > 0, 2 * part * np.log(part / expect), 0)
    good = np.flatnonzero((g2 >= MIN_EVIDENCE) & (a * ng > b * nb))
    return [x[1] for x in sorted((-g2[i], seen[i][0]) for i in good)]


def choose_words(docs: list[Counter], toxic: np.ndarray) -> list[str]:
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for c, y in zip(docs, toxic, strict=True):
        seen[int(y > 0)].update(c.keys())
    return choose([(f, k, seen[0][f]) for f, k in seen[1].items()], int((toxic > 0).sum()), int((toxic == 0).sum()))


def severity(docs: list[Counter], toxic: np.ndarray, names: list[str]) -> np.ndarray:
    """Grades for labels that only say toxic or not: 0 clean, 1 toxic, 2 toxic with more telling words
    than the median toxic document."""
    strong = set(names)
    n = np.array([sum(c[w] for w in c.keys() & strong) for c in docs])
    if not toxic.any():
        return toxic.astype(int)
    return np.where(toxic > 0, 1 + (n > np.median(n[toxic > 0])), 0)


def fit(docs: list[Counter], toxic: np.ndarray, grade: np.ndarray | None = None, rounds: int = 400, decay: float = 1e-4, names: list[str] | None = None) -> OrdinalModel:
    """Full-batch Adam on the penalised likelihood. Without any toxic or any clean row nothing is rejected."""
    toxic = np.asarray(toxic)
    names = choose_words(docs, toxic) if names is None else names
    if not len(toxic) or not toxic.any() or toxic.all() or not names:
        return OrdinalModel({}, [20.0, 21.0])
    y = severity(docs, toxic, names) if grade is None else np.asarray(grade)
    top = int(y.max())
    col = {w: i for i, w in enumerate(names)}
    at = [(r, col[w], np.log1p(k)) for r, c in enumerate(docs) for w, k in c.items() if w in col]
    rows, cols, vals = (np.array(x) for x in zip(*at, strict=True))
    w, base, gaps = np.zeros(len(names)), 0.0, np.zeros(max(0, top - 1))  # theta = base, then + exp(gap)
    params = np.concatenate([w, [base], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        w, theta = params[: len(names)], params[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(params[len(names) + 1 :]))])
        z = np.bincount(rows, vals * w[cols], len(docs))
        tail = np.column_stack([np.ones(len(docs)), sig(z[:, None] - theta[None, :]), np.zeros(len(docs))])
        p = np.maximum(tail[np.arange(len(docs)), y] - tail[np.arange(len(docs)), y + 1], 1e-12)
        slope = tail * (1 - tail)
        dz = (slope[np.arange(len(docs)), y] - slope[np.arange(len(docs)), y + 1]) / p
        dtheta = np.zeros(top)
        for k in range(1, top + 1):
            dtheta[k - 1] = (-(slope[:, k] / p)[y == k].sum() + (slope[:, k] / p)[y == k - 1].sum()) / len(docs)
        gw = np.bincount(cols, vals * dz[rows], len(names)) / len(docs) - decay * w
        gg = [dtheta[j + 1 :].sum() * np.exp(params[len(names) + 1 + j]) for j in range(top - 1)]
        g = np.concatenate([gw, [dtheta.sum()], gg])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = params[len(names)] + np.concatenate([[0.0], np.cumsum(np.exp(params[len(names) + 1 :]))])
    z = np.bincount(rows, vals * params[cols], len(docs))
    cut = best_cut(sig(z - theta[0]), toxic)
    return OrdinalModel({n: float(x) for n, x in zip(names, params, strict=False)}, [float(t) for t in theta], cut)


def best_cut(p: np.ndarray, toxic: np.ndarray, cost: float = 10.0) -> float:
    """The probability from which rejecting gains most, where a clean row lost costs ten times the rate of
    a toxic row kept. Between two rows' values, the middle."""
    order = np.argsort(-p)
    gain = np.cumsum(toxic[order] > 0) / max(1, (toxic > 0).sum()) - cost * np.cumsum(toxic[order] == 0) / max(1, (toxic == 0).sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # rows of equal probability go together
    k = int(np.argmax(np.where(last, gain, -np.inf)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0.0)) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, grade_col: str | None = None) -> OrdinalModel:
    """Fits on at most about max_train labelled rows, chosen by a hash of doc_id. Rows with a null label
    or id are left out. Only telling features and counts of these rows reach the driver."""
    steady_reads(docs.sparkSession)
    y = F.col(grade_col or "toxic").cast("int")
    lab = labels.select(F.col("doc_id").cast("long").alias("l_id"), y.alias("l_y")).where("l_id is not null and l_y is not null")
    n = lab.count()
    if n > max_train:
        lab = lab.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    lab = lab.groupBy("l_id").agg(F.max("l_y").alias("l_y"))
    # At most about max_train ids of two numbers each.
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(lab), F.col("doc_id") == F.col("l_id"))

    mine = materialize(mine.select("l_y", "text"))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[y > 0].update(count_features(t.as_py()).keys())
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([s[w] for w in names], pa.int64()) for s in seen]], ["f", "good", "bad"])

    n = {r.toxic: r["count"] for r in mine.groupBy((F.col("l_y") > 0).alias("toxic")).count().collect()}
    nb, ng = n.get(True, 0), n.get(False, 0)
    if not nb or not ng:
        return OrdinalModel({}, [20.0, 21.0])
    df = mine.mapInArrow(presence, "f string, good long, bad long").groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    named = [(r.f, r.bad, r.good) for r in df.where((F.col("bad") > 1) & (F.col("bad") * ng > F.col("good") * nb)).toLocalIterator()]
    names = choose(named, nb, ng)
    chosen = set(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cs = [{f: k for f, k in count_features(t.as_py()).items() if f in chosen} for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(c) for c in cs], pa.list_(pa.string())), pa.array([list(c.values()) for c in cs], pa.list_(pa.int32()))], ["y", "f", "n"]
            )

    rows = sorted((r.y, sorted(zip(r.f, r.n, strict=True))) for r in mine.mapInArrow(count, "y int, f array<string>, n array<int>").toLocalIterator())
    y = np.array([r[0] for r in rows], int)
    return fit([Counter(dict(r[1])) for r in rows], (y > 0).astype(int), y if grade_col else None, names=names)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, rejected) for every row.

    Null and empty texts score as a text without telling words; equal rows are scored each.
    """
    steady_reads(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.grades(t.as_py()) for t in b.column(1)]
            p = [x[1] for x in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array(p, pa.float64()), pa.array([x > model.cut for x in p], pa.bool_())],
                ["doc_id", "expected_severity", "p_toxic", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns and the text untouched. Null and empty
    texts stay, and so does each of equal rows that are not rejected."""
    steady_reads(docs.sparkSession)

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        return text.map(lambda t: model.grades(t)[1] > model.cut)

    return docs.where(~toxic(F.col("text").cast("string")))
