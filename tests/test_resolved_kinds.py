"""Mentions that agree are resolved once, names are likened once."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

from weftline.operators import entities


def test_mentions_of_a_kind_are_resolved_as_one(spark):
    r = random.Random(3)
    names = ["Red Bolt", "red ring", "Blue Ring", "blue rings", "cold plate", None]
    rows = [(i, r.choice(names), r.choice([None, datetime(2024, 1, 3), datetime(2024, 1, 9)]), r.choice([None, [], ["B1"], ["b2", "B1"]])) for i in range(400)]
    known = [(7, "red bolt", datetime(2024, 1, 2)), (3, "Red Bolt", datetime(2024, 1, 2)), (5, "blue ring", None), (9, "blue rings", datetime(2024, 1, 8))]
    near = {7: {"b1"}, 3: {"b1"}, 9: {"b2", "b3"}}
    m = spark.createDataFrame(rows, "mention_id long, name string, seen timestamp_ntz, nearby array<string>")
    e = spark.createDataFrame(known, "entity_id long, name string, last_seen timestamp_ntz")
    c = spark.createDataFrame([(k, x.upper()) for k, v in near.items() for x in v], "entity_id long, name string")

    def score(name, seen, nearby, k, other, last):
        share = len({x.lower() for x in nearby} & near.get(k, set())) / len({x.lower() for x in nearby}) if nearby else 0
        fresh = max(0, 1 - abs(seen - last) / timedelta(days=7)) if seen and last else 0
        return round(0.5 * SequenceMatcher(None, name.lower(), other.lower()).ratio() + 0.3 * share + 0.2 * fresh, 6)

    def gram(n):
        return {f"  {w} "[i : i + 3] for w in n.lower().split() for i in range(len(w) + 1)}

    want = {}
    for i, name, seen, nearby in rows:
        may = [(-score(name, seen, nearby, *x), x[0]) for x in known if name and len(gram(name) & gram(x[1])) / len(gram(name) | gram(x[1])) >= 0.15]
        best = min((x for x in may if -x[0] > 0.6), default=None)
        want[i] = (name, best and best[1], best and -best[0])
    for each in (5, 1_000_000):
        got = entities.resolve(m, e, c, each=each)
        # Names meet Python in a table of pairs, before mentions do.
        assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
        assert {x.mention_id: (x.name, x.entity_id, x.score) for x in got.collect()} == want
