"""Links of entities arise once and are not compared with each other."""

import random
from collections import defaultdict

from weftline.operators import links


def test_entity_links_arise_once(spark):
    r = random.Random(9)
    rows = sorted({(r.randrange(80), r.choice([0, 0, 0, 1, 2, 3, 4])) for _ in range(240)})
    rows += [(79, 0), (79, 0), (5, 1), (5, 1)]  # given twice
    fresh = {u for u, _ in rows if u % 3 == 0 and u > 20} | {1000}
    got = links.entity_links(spark.createDataFrame(rows, "unit_id long, entity_id long"), spark.createDataFrame([(u,) for u in fresh], "unit_id long"), 4, each=10)
    of = defaultdict(list)
    for u, e in rows:
        of[e].append(u)
    want = set()
    for e, units in of.items():
        kept = sorted(units, reverse=True)[: 4 + len(fresh)]
        old, new = sorted(u for u in kept if u not in fresh)[:4], sorted(u for u in kept if u in fresh)
        one = {(a, b, e) for a in new for b in old} | {(a, b, e) for a in new[:4] for b in new[:4] if a != b}
        want |= one | {(b, a, e) for a, b, e in one}
    assert sorted((x.from_id, x.to_id, x.entity_id) for x in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate [from_id" not in plan
