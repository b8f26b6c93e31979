"""Cases that once went wrong: fitting chunks, names in any case, scores of marked and missing texts, many tags."""

import pandas as pd
import pytest
from weftline.operators import consolidate, entities, ingest, rerank


def test_fitting_texts_are_one_chunk_as_they_are(spark):
    texts = ['[{"role":"user","content":"hi"}]', "", "   ", "plain", None, '[{"role":"user","content":"' + "a" * 40 + '"},{"role":"bot","content":"b"}]', "one two\n\n" + "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in ingest.chunk_documents(df, 50).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    for i in range(4):
        assert got[i] == [texts[i]]
    assert 4 not in got and len(got[5]) == 2 and len(got[6]) == 2


def test_lexical_scores():
    s = rerank.lexical_scorer("The fox?")
    assert list(s(pd.Series(["fox, the", "Fox!", None, ""]))) == [2.0, 0.0, -2.0, -2.0]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 0.93])
def test_names_of_any_case_and_first_letter(spark, threshold):
    names = ["Apple", "APPLE", "smith", "psmith", "Martha", "marhta", "dwayne", "Duane", "dixon", "dicksonx", "", "a", "ab", "ba", "aaaa", "aaab", "jellyfish", "smellyfish", "éa", "Éa", "zz top", "top zz", "crate", "trace", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.a, r.b): r.similarity for r in entities.jaro_winkler_pairs(df, df, threshold).where("a < b").collect()}
    known = sorted({n for n in names if n})
    want = {(a, b): round(entities.jaro_winkler(a.lower(), b.lower()), 4) for a in known for b in known if a < b}
    assert got == {k: v for k, v in want.items() if v > threshold}
    assert threshold > 0.93 or ("APPLE", "Apple") in got


def test_many_tags(spark):
    df = lambda n: spark.createDataFrame([(1, [f"t{i}" for i in range(n)])], "id long, tags array<string>")
    assert consolidate.scopes(df(6), "all_combinations").count() == 63
    with pytest.raises(Exception, match="too many tags"):
        consolidate.scopes(df(31), "all_combinations").count()


def test_modes_of_a_document_agree(spark):
    import pytest
    from weftline.operators import ingest

    rows = [(1, 1, "a", "append"), (1, 2, None, "append"), (2, 1, "a", None), (2, 2, "b", "append"), (2, 3, "a", "replace")]
    schema = "batch_id long, item long, document_id string, update_mode string"
    got = {(r.batch_id, r.target): (r["items"], r.update_mode) for r in ingest.group_modes(ingest.group_items(spark.createDataFrame(rows, schema))).collect()}
    assert got == {(1, "a"): (2, "append"), (2, "a"): (2, "replace"), (2, "b"): (1, "append")}
    with pytest.raises(Exception, match="conflicting update modes for document a: append, replace"):
        ingest.group_modes(ingest.group_items(spark.createDataFrame([*rows, (2, 4, "a", "append")], schema))).collect()
