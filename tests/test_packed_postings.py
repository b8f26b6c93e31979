"""The rows of an index travel in packs."""

from weftline.operators import postings

from tests.test_growth import stages


def test_terms_of_a_block_travel_together(spark, tmp_path):
    """3,000 terms in two blocks: a record for each document, each partition of terms in a block and each part of a count."""
    rows = [(i, " ".join(f"w{i}x{j} é{j}" for j in range(2)) if i % 9 else None) for i in range(1100)]
    units = spark.createDataFrame(rows, "id long, text string").repartition(4).cache()
    units.count()
    index, ran = stages(spark, lambda: postings.build(units, str(tmp_path / "index")))
    assert sum(s.shuffleWriteRecords() for s in ran) < 1100 + 2 * postings.BUCKETS + 50
    got = index.rows(["w5x1", "é0", "w9x0"]).collect()
    assert {(e.id, e.tf, e.length, tuple(e.positions)) for r in got if r.term == "w5x1" for e in r.entries} == {(5, 1, 4, (3,))}
    assert {e.id for r in got if r.term == "é0" for e in r.entries} == {i for i in range(1100) if i % 9}
    assert len({r.block for r in got if r.term == "é0"}) == 2 and not [r for r in got if r.term == "w9x0"]
