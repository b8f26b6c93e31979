"""Activation of many questions against a plain walk for each."""

import math
import random

from weftline.operators import activation


def walk(start, vector, edges, vectors, limit, rounds=5, per_source=2, decay=0.7, least=0.2, like=0.1):
    out = {}
    for i in start:
        out[i] = (1.0, 0)
    front = dict.fromkeys(start, 1.0)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.dist(a, [0] * len(a)) / math.dist(b, [0] * len(b))
    for hop in range(1, rounds + 1):
        new = {}
        for f, parent in front.items():
            links = sorted((-w, t, k) for a, t, k, w in edges if a == f and w >= 0.1)[:per_source]
            for w, t, k in links:
                if t not in out and cos(vectors[t], vector) >= like:
                    new[t] = max(new.get(t, 0.0), 0.3, parent * -w * {"causes": 2.0, "caused_by": 2.0, "enables": 1.5, "prevents": 1.5}.get(k, 1.0) * decay)
        best = sorted(new.items(), key=lambda x: (-x[1], x[0]))[: max(0, limit - len(out))]
        for i, s in best:
            out[i] = (s, hop)
        front = {i: s for i, s in best if s > least}
    return out


def test_many_questions(spark):
    r = random.Random(7)
    vectors = {i: [r.gauss(0, 1) for _ in range(4)] for i in range(80)}
    kinds = ["temporal", "causes", "caused_by", "enables", "prevents"]
    edges = {(r.randrange(80), r.randrange(80)): (r.choice(kinds), r.choice([0.05, 0.3, 0.6, 0.9, 1.0])) for _ in range(500)}
    edges |= {(5, t): ("causes", 1.0) for t in range(80)}  # a hub
    edges = [(a, b, k, w) for (a, b), (k, w) in edges.items()]
    asked = {q: (sorted(r.sample(range(80), r.randrange(1, 4))), [r.gauss(0, 1) for _ in range(4)]) for q in range(100)}
    got = {}
    found = activation.spread(
        spark.createDataFrame([(q, i) for q, (ids, _) in asked.items() for i in ids], "question long, id long"),
        spark.createDataFrame([(q, v) for q, (_, v) in asked.items()], "question long, embedding array<double>"),
        spark.createDataFrame(edges, "from_id long, to_id long, link_type string, weight double"),
        spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>"), 9, per_source=2,
    )
    for x in found.collect():
        got.setdefault(x.question, {})[x.id] = (round(x.score, 9), x.hop)
    want = {q: {i: (round(s, 9), h) for i, (s, h) in walk(ids, v, edges, vectors, 9).items()} for q, (ids, v) in asked.items()}
    assert got == want
