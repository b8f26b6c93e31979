"""Files, backups, deliveries, structured documents, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from weftline.operators import docmodel, sampling
from weftline.sources import files, store
from weftline.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_parsers_fall_back():
    assert files.convert(b"<h1>A</h1><p>b &amp; c<script>x</script></p><ul><li>d</ul>", "a.html", ["json", "html"])[:2] == ("# A\n\nb & c\n\n- d", "html")
    assert files.convert(b'{"b": 1}', "a", ["json"])[1] == "json"
    assert files.convert(b"a,b\n1,2", "t.csv", ["csv"])[0] == "| a | b |\n|---|---|\n| 1 | 2 |"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p>")
    assert files.convert(z.getvalue(), "a.docx", ["pptx", "docx"])[:2] == ("One & two\n\nthree", "docx")
    text, used, errors = files.convert(b"\xff\xfe\x00", "a", ["json", "text"])
    assert text is None and used is None and "text" in errors and files.convert(None, "a", ["text"])[1] is None


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hello</p>")
    (tmp_path / "b.txt").write_bytes(b"\x00\x01")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_files(spark, str(tmp_path), ["html", "text"]).collect()}
    assert got == {"a.html": "hello", "b.txt": None}
    with pytest.raises(ValueError):
        files.convert_files(spark.range(1), ["pdf2"])


def test_backup_and_restore(spark, tmp_path):
    t = {"memory_units": spark.range(5), "banks": spark.range(2)}
    assert [r.table_name for r in store.backup(t, str(tmp_path)).collect()] == ["banks", "memory_units"]
    assert {k: v.count() for k, v in store.restore(spark, str(tmp_path)).items()} == {"banks": 2, "memory_units": 5}
    spark.range(1).write.mode("overwrite").parquet(str(next(tmp_path.glob("*/banks"))))
    with pytest.raises(ValueError):
        store.restore(spark, str(tmp_path))


def test_a_backup_is_of_one_state(spark, tmp_path):
    for name in ("banks", "documents"):
        spark.range(5).write.parquet(f"{tmp_path}/{name}")
    t = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("documents", "banks")}
    spark.range(5, 9).write.mode("append").parquet(f"{tmp_path}/documents")  # comes once the state is fixed
    to = f"{tmp_path}/backup"
    assert {r.table_name: r.row_count for r in store.backup(t, to).collect()} == {"banks": 5, "documents": 5}
    broken = {"banks": t["banks"], "documents": t["documents"].select((F.col("id") + F.raise_error(F.lit("no"))).alias("id"))}
    with pytest.raises(Exception, match="no"):
        store.backup(broken, to)
    assert {k: v.count() for k, v in store.restore(spark, to).items()} == {"banks": 5, "documents": 5}  # the one before
    again = store.restore(spark, to, f"{tmp_path}/fresh")
    assert list(again) == ["banks", "documents"] and all("/fresh/" in f for v in again.values() for f in v.inputFiles())


def test_signature_and_fingerprint():
    assert store.sign("k", "v") == "sha256=" + __import__("hmac").new(b"k", b"v", "sha256").hexdigest()
    f = store.fingerprint("a", "b", 3)
    store.check_fingerprint(f, "a", "b", 3)
    with pytest.raises(ValueError):
        store.check_fingerprint(f, "a", "b", 4)


def test_structured_documents():
    md = "# Stop Conditions\n\nText one\nline two\n\n- a\n- b\n\n## Stop Conditions\n\n1. x\n2. y\n\n```py\ncode\n\n# no heading\n```"
    doc = docmodel.parse(md)
    assert [s["id"] for s in doc["sections"]] == ["stop-conditions", "stop-conditions-2"]
    assert [b["type"] for s in doc["sections"] for b in s["blocks"]] == ["paragraph", "bullet_list", "ordered_list", "code"]
    assert docmodel.render(doc) == md and docmodel.parse(docmodel.render(doc)) == doc
    ops = [
        {"op": "append_block", "section_id": "stop-conditions", "block": {"type": "paragraph", "text": "more"}},
        {"op": "replace_block", "section_id": "stop-conditions", "index": 9, "block": {"type": "paragraph", "text": "?"}},
        {"op": "add_section", "heading": "New", "after_section_id": "stop-conditions"},
        {"op": "remove_section", "section_id": "nothing"},
        {"op": "fly", "section_id": "new"},
    ]
    before = docmodel.render(doc)
    new, skipped = docmodel.apply(doc, ops)
    assert [s["id"] for s in new["sections"]] == ["stop-conditions", "new", "stop-conditions-2"] and len(skipped) == 3
    assert docmodel.render(doc) == before and new["sections"][2] == doc["sections"][1]
    para = lambda t: {"type": "paragraph", "text": t}
    more = [
        {"op": "rename_section", "section_id": "stop-conditions", "new_heading": "Go"},
        {"op": "add_section", "heading": "Own id", "new_id": "stop-conditions", "blocks": [para("x")], "level": 3},
        {"op": "add_section", "heading": "Nowhere", "after_section_id": "nothing"},
        {"op": "insert_block", "section_id": "stop-conditions", "index": 2, "block": para("end")},
        {"op": "insert_block", "section_id": "stop-conditions", "index": 9, "block": para("?")},
        {"op": "remove_block", "section_id": "stop-conditions", "index": 0},
        {"op": "replace_section_blocks", "section_id": "stop-conditions-2", "blocks": [para("all")]},
        {"op": "append_block", "section_id": "stop-conditions"},
        {"op": "rename_section", "section_id": "stop-conditions"},
        {"op": "remove_section", "section_id": "stop-conditions-3"},
    ]
    new, skipped = docmodel.apply(doc, more)
    assert [(s["id"], s["heading"]) for s in new["sections"]] == [("stop-conditions", "Go"), ("stop-conditions-2", "Stop Conditions")]
    assert [b.get("text") for b in new["sections"][0]["blocks"]] == [None, "end"] and new["sections"][1]["blocks"] == [para("all")]
    assert [x.split(":")[0] for x in skipped] == ["2", "4", "7", "8"]
    assert docmodel.render(doc) == before


def test_spaced_sample(spark):
    df = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate([5, 9, 8, 1, 7, 2, 2, 2, 2, 6])], "p long, t double, v double")
    got = sorted(r.t for r in sampling.spaced_sample(df, "p", "t", "v", "t", 4, 3.0).collect())
    assert got == [1.0, 4.0, 7.0, 9.0] or len(got) == 4 and all(b - a >= 1 for a, b in zip(got, got[1:], strict=False))


def test_streams_equal_their_batches(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, make, mode in (
        ("tumbling", lambda df: jobs.tumbling_counts(df, "ts", "event_type", "6 hours", "40 days"), "update"),
        ("sessions", lambda df: jobs.sessions(df, "ts", "user_id", "2 hours", "40 days"), "complete"),
        ("running", lambda df: jobs.running_counts(df, "event_type"), "complete"),
    ):
        out: dict[int, list] = {}
        q = jobs.start(make(jobs.stream_of(spark, str(tmp_path / "in"), e.schema, 10)), lambda b, n, out=out: out.__setitem__(n, b.collect()), str(tmp_path / name), mode)
        q.awaitTermination()
        got = sorted(map(str, (r for rows in out.values() for r in rows)))
        assert got == sorted(map(str, make(e).collect())), name


def test_outbox_is_written_once_per_batch(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    sink = jobs.outbox(str(tmp_path / "out"))
    q = jobs.start(jobs.stream_of(spark, str(tmp_path / "in"), "id long", 100), sink, str(tmp_path / "cp"))
    q.awaitTermination()
    sink(spark.range(10), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_last_writer_wins(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c")], "k long, t long, v string")
    assert sorted((r.k, r.v) for r in jobs.last_writer_wins(df, ["k"], "t").collect()) == [(1, "b"), (2, "c")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_recall_of_odd_questions(spark):
    from datetime import datetime

    from weftline.operators import search
    from weftline.plans.recall import recall
    from weftline.plans.registry import SearchConfig

    rows = [(k, t, [1.0, k / 10], "world", None, datetime(2024, 1, 1 + k), 1) for k, t in enumerate(["A fox", "the dog", "", "fox, fox!"])]
    u = spark.createDataFrame(rows, "id long, text string, embedding array<float>, fact_type string, tags array<string>, event_date timestamp_ntz, proof_count int")
    assert {r.id for r in search.bm25(u, ["fox", "?"]).collect()} == {0, 3} and search.bm25(u, ["?"]).count() == 0
    ask = lambda q, **how: [r.id for r in recall(u, q, [0.0, 1.0], datetime(2024, 1, 5), **how).collect()]
    assert set(ask("fox?")) == set(ask("FOX")) >= {0, 3}
    for bad in ("???", "", "word " * 501):
        with pytest.raises(ValueError):
            ask(bad)
    assert ask("what happened yesterday?", config=SearchConfig(retrieval="temporal")) == [3]
    assert ask("what happened?", config=SearchConfig(retrieval="temporal")) == []
    assert ask("fox", config=SearchConfig(retrieval="temporal"), window=(datetime(2024, 1, 3), datetime(2024, 1, 3))) == [2]
    none = u.limit(0).select("id", "embedding")
    assert search.lsh_neighbours(none, none, 3).count() == 0


def test_halving():
    from weftline.operators.consolidate import halving

    def work(batch):
        if any(x % 5 == 0 for x in batch):
            raise RuntimeError
        return [x * 2 for x in batch]

    done, failed = halving(list(range(1, 18)), work)
    assert done == [2 * x for x in range(1, 18) if x % 5] and failed == [5, 10, 15]
    assert halving([], work) == ([], [])


def test_policy_fingerprints_ignore_order():
    from weftline.operators.ingest import policy_fingerprint

    assert policy_fingerprint(a=1, b="x") == policy_fingerprint(b="x", a=1) != policy_fingerprint(a=2, b="x")
