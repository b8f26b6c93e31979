"""Stored postings against plain Python, with every block bound in play, and after updates."""

import math
import re
from collections import Counter

from weftline.operators import postings

SCHEMA = "id long, text string"


def words(t):
    return re.sub(r"[^\w\s]", " ", (t or "").lower()).split()


def brute_bm25(rows, terms, k, every=False):
    docs = {i: words(t) for i, t in rows}
    size = [len(w) for w in docs.values() if w]
    n, mean = len(size), sum(size) / max(1, len(size))
    df = Counter(t for w in docs.values() for t in set(w))
    out = []
    for i, w in docs.items():
        c = Counter(w)
        has = [t for t in terms if c[t]]
        if has and (not every or len(has) == len(terms)):
            s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in has)
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def brute_cover(rows, terms, k):
    out = []
    for i, t in rows:
        at = [(p, w) for p, w in enumerate(words(t), 1) if w in terms]
        runs = []
        for a in range(len(at)):
            for b in range(a, len(at)):
                if {w for _, w in at[a : b + 1]} == set(terms):
                    runs.append((a, b))
                    break
        runs = [(a, b) for a, b in runs if not any((c, d) != (a, b) and a <= c and d <= b for c, d in runs)]
        s = sum(0.1 / (1 + at[b][0] - at[a][0] - (b - a)) for a, b in runs)
        if s:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def texts(n, seed=1):
    import random

    r = random.Random(seed)
    return [(i, " ".join(r.choices("fox Dog cat, the the the. of a-b x1 rare".split(), [5, 5, 3, 9, 9, 9, 9, 2, 2, 0.2], k=r.choice([1, 5, 40])))) for i in range(n)]


def close(got, want):
    assert [x[0] for x in got] == [x[0] for x in want]
    assert all(abs(x[1] - y[1]) < 2e-6 for x, y in zip(got, want, strict=True))


def test_answers_and_updates(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 20)
    monkeypatch.setattr(postings, "FIRST", 1)
    monkeypatch.setattr(postings, "BUCKETS", 3)
    rows = [*texts(120), (900, None), (901, ""), (902, "?!"), (903, "fox " * 3000)]
    index = postings.build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/i")

    def agree(rows):
        for terms in (["rare", "x1"], ["the", "cat", "none"]):
            close([tuple(r) for r in postings.bm25(index, terms, 7).collect()], brute_bm25(rows, terms, 7))
        close([tuple(r) for r in postings.bm25(index, ["of", "dog"], 7, every=True).collect()], brute_bm25(rows, ["of", "dog"], 7, True))
        for terms in (["cat", "of", "x1"], ["rare", "rare"]):
            close([tuple(r) for r in postings.cover_density(index, terms, 9).collect()], brute_cover(rows, set(terms), 9))

    agree(rows)
    keep = spark.range(50)
    want = [x for x in brute_bm25(rows, ["fox", "rare"], 1000) if x[0] < 50][:5]
    close([tuple(r) for r in postings.bm25(index, ["fox", "rare"], 5, keep=keep).collect()], want)
    now = [(i, t) for i, t in rows if i not in (3, 900)] + [(1000, "rare fox dog"), (1001, "a-b")]
    now = [(i, "rare rare") if i == 5 else (i, t) for i, t in now]
    postings.update(index, spark.createDataFrame(now, SCHEMA), spark.createDataFrame([(3,), (5,), (900,), (1000,), (1001,)], "id long"))
    agree(now)
    assert postings.bm25(index, [], 3).count() == 0 and postings.cover_density(index, [], 3).count() == 0
    assert postings.bm25(index, ["absent"], 3).count() == 0


def test_an_empty_index(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")
    assert postings.bm25(index, ["fox"], 3).count() == 0 and postings.cover_density(index, ["fox", "dog"], 3).count() == 0


def test_the_index_follows_its_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame([(1, "old fox")], SCHEMA).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    first = postings.stored(read())
    assert [r.id for r in postings.bm25(first, ["fox"], 3).collect()] == [1] and postings.stored(read()).path == first.path
    spark.createDataFrame([(2, "new fox")], SCHEMA).write.mode("append").parquet(path)
    assert {r.id for r in postings.bm25(postings.stored(read()), ["fox"], 3).collect()} == {1, 2}
