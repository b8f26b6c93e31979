"""What travels, and what a task holds, follows the rows and not their square or the number of words."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from weftline.operators import graph, links, postings
from weftline.operators.docmodel import parse_markdown
from weftline.streaming import tasks


def stages(spark, run):
    """What run() gives, and Spark's data of the stages that it ran."""
    sc, name = spark.sparkContext, f"growth-{random.random()}"
    sc.setJobGroup(name, "")
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ids = {i for j in sc.statusTracker().getJobIdsForGroup(name) for i in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setJobGroup("", "")
    return out, [sc._jsc.sc().statusStore().lastStageAttempt(i) for i in sorted(ids)]


def test_no_word_of_an_index_travels_alone(spark, tmp_path):
    rows = [(i, " ".join(["fox", "the", "Dog."] * 50) if i % 7 else None) for i in range(200)]
    units = spark.createDataFrame(rows, "id long, text string").repartition(4).cache()
    units.count()
    index, ran = stages(spark, lambda: postings.build(units, str(tmp_path / "index")))
    # 25,650 words of 513 terms in documents: a row travels for each document, each term in a block and each part of a count.
    assert sum(s.shuffleWriteRecords() for s in ran) < 400
    got = {r.term: r for r in index.rows(["fox", "dog"]).collect()}
    assert got["fox"].df == 171 and got["dog"].df == 171 and (got["dog"].most, got["dog"].least) == (50, 150)
    assert {tuple(e.positions) for e in got["dog"].entries} == {tuple(range(3, 151, 3))}
    assert {e.id for e in got["fox"].entries} == {i for i in range(200) if i % 7}


def test_pairs_of_entities_are_dealt_by_their_number(spark):
    r = random.Random(4)
    rows = sorted({(r.randrange(60), r.randrange(12)) for _ in range(300)})
    units = spark.createDataFrame(rows, "unit_id long, entity_id long")
    dates = spark.createDataFrame([(i, f"2024-01-{i % 28 + 1:02}") for i in range(50)], "unit_id long, event_date string")
    want = {}
    for u, a in rows:
        for v, b in rows:
            if u == v and a < b:
                day = f"2024-01-{u % 28 + 1:02}" if u < 50 else ""
                n, last = want.get((a, b), (0, ""))
                want[a, b] = (n + 1, max(last, day))
    got = graph.cooccurrence(units, dates, each=10)
    assert got.rdd.getNumPartitions() >= 2 * len(rows) // 10
    assert {(x.e1, x.e2): (x.n, x.last or "") for x in got.collect()} == want
    assert {(x.e1, x.e2): x.n for x in graph.cooccurrence(units).collect()} == {k: n for k, (n, _) in want.items()}


def test_temporal_causes_are_dealt_by_their_links(spark):
    r = random.Random(6)
    units = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=r.randrange(9000))) for i in range(200)], "id long, event_date timestamp_ntz")
    near = links.temporal_links(units.withColumn("part", F.lit("a")), ["part"], 4, 4)
    few, whole = graph.temporal_causal(units.select("id"), near, units, 5, each=20), graph.temporal_causal(units.select("id"), near, units, 5)
    assert few.rdd.getNumPartitions() >= 2 * 800 // 20
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))


def test_operations_are_no_groups_and_texts_no_arrow_batches(spark):
    commands = spark.createDataFrame([(1, 0, "submit", None, None, datetime(2024, 1, 1)), (2, 1, "claim", "w", None, datetime(2024, 1, 1))], "operation_id long, seq long, kind string, worker string, seconds long, at timestamp")
    got = tasks.replayed(commands)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(x.operation_id, x.status, x.attempts, x.worker, x.due) for x in got.collect()] == [(1, "pending", 0, None, None)]
    parsed = spark.createDataFrame([("# A",), (None,)], "md string").select(parse_markdown("md").alias("x"))
    assert "ArrowEvalPython" not in parsed._jdf.queryExecution().executedPlan().toString()
    assert '"heading": "A"' in parsed.collect()[0].x and parsed.collect()[1].x == '{"sections": []}'
