"""The pipeline, stage by stage, against plain Python."""

import itertools
import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import queries, simhash

from tests.llm.test_python_style import brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    assert cp.ORACLE_SQL is None


def test_toxic_documents_go(spark, docs):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = cp.drop_toxic(spark, d, sf)
    assert got.columns == d.columns
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    q = {r.doc_id: r.rejected for r in queries.op7_toxicity(spark, sf).collect()}
    assert ids == {i for i, x in q.items() if not x} and len(ids) < len(q)


def test_stages_keep_clashing_columns_and_odd_rows(spark, docs):
    """Null ids, texts and sources, equal rows, and columns named like the operators' own."""
    extra = [(None, None, None, None, None), (7000, "", "en", "s", 0), (7001, "A b c", "en", None, 5), (7001, "A b c", "en", None, 5)]
    d = docs.union(spark.createDataFrame(extra, docs.schema))
    clash = ["t", "n_bytes", "spans", "kept", "marks", "k1", "k2", "n_removed", "row", "__row", "__2", "component", "id", "size", "parts", "copy", "toxic", "a.b"]
    for k, c in enumerate(clash):
        d = d.withColumn(c, F.lit(k))
    for name, stage in cp.STAGES[:4]:
        got = stage(spark, d, SF)
        assert got.columns == d.columns, name
        rows = got.collect()
        assert rows and all(r[c] == k for r in rows for k, c in enumerate(clash)), name
        assert stage(spark, d.limit(0), SF).count() == 0 or name == "toxicity"
    assert sum(r.doc_id == 7001 for r in cp.drop_near_duplicates(spark, d, SF).collect()) == 1


def test_one_of_each_group_stays(spark, docs):
    rnd = random.Random(8)
    base = [r.text for r in docs.where("n_chars > 1500").orderBy("doc_id").limit(12).collect()]
    rows = [tuple(r) for r in docs.collect()]
    for k, t in enumerate(base):
        for i in range(70 if k == 0 else 4):  # a group above the bucket size
            words = t.split(" ")
            for _ in range(max(1, len(words) // rnd.choice([60, 120, 400]))):
                words[rnd.randrange(len(words))] = rnd.choice(["zork", "plim", "vatu"])
            rows.append((5000 + 100 * k + i, " ".join(words), "en", "s", 1))
    rows += [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, " ", "en", "s", 1), (2, rows[2][1], "en", "s", 1), (None, rows[4][1], "en", "s", 1), (9003, "A b", "en", "s", 3), (9004, "a  B", "en", "s", 4)]
    d = spark.createDataFrame(rows, docs.schema)
    sets = [set(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if (len(x & y) >= 0.8 * len(x | y)) if x or y else True:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    got = cp.drop_near_duplicates(spark, d, SF)
    assert got.columns == d.columns
    want = Counter(min((x for x in v if x is not None), default=None) for v in groups.values())
    left = Counter(r.doc_id for r in got.collect())
    assert not want - left  # no group is lost
    assert sum((left - want).values()) <= 0.01 * len(rows)  # bands miss a pair in 250


def test_repeated_passages_go(spark, docs):
    got = {r.doc_id: r for r in cp.drop_repeats(spark, docs, SF).collect()}
    rows = docs.collect()
    for r, (n, gone, _, _) in zip(rows, brute_repeats([r.text for r in rows], 400), strict=True):
        if not gone:
            assert got[r.doc_id].text == r.text
        elif r.doc_id in got:
            assert n - gone - 6 <= len(got[r.doc_id].text.encode()) <= n - gone and got[r.doc_id].text.strip()
            assert got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_passages_of_51_words_go(spark, docs):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = " ".join(word(5) for _ in range(51))
    rows = [(k, f"{' '.join(word(6) for _ in range(60))} {passage} {' '.join(word(6) for _ in range(60))}", "en", "s", 0) for k in range(5)]
    stage = dict(cp.STAGES)["suffix_array_dedup"]
    got = {r.doc_id: r.text for r in stage(spark, spark.createDataFrame(rows, docs.schema), SF).collect()}
    assert len(passage) < 400 and len(got) == 5
    for r in rows:
        a, b = r[1].split(passage)
        assert got[r[0]] == a.rstrip() + b.lstrip()  # the spaces around it repeat too


def test_mixing_and_packing(spark, docs):
    mixed = cp.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count()
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    packed = cp.pack_sequences(spark, mixed, SF).collect()
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_run(spark):
    out = cp.run(spark, SF)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.count() > 0


def test_empty_table(spark, docs):
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0




def test_near_copies_of_texts_with_repeats(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):  # two texts with the same set of shingles: a passage stands once in one, 40 times in the other
        own = " ".join(f"w{k}x{rnd.randrange(10**6)}" for _ in range(280))
        part = " ".join(f"p{k}x{i}" for i in range(24))
        rows += [(2 * k, f"{own} {part} {part}"), (2 * k + 1, f"{own} {part}" + f" {part}" * 40)]
    got = {r.row: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "row long, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(60))


def test_star_of_unlike_copies(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))]
    for k in range(1, 1001):
        w = list(words)
        for i in rnd.sample(range(10, 390, 10), 7):
            w[i] = f"z{k}x{i}"
        rows.append((k, " ".join(w)))
    rnd.shuffle(rows)
    text = dict(rows)
    assert all(simhash.similarity(text[0], text[k]) >= 0.8 for k in range(1, 1001))
    # Edits of the same places are more alike than others; most are below the threshold.
    assert sum(simhash.similarity(text[k], text[k + 1]) < 0.8 for k in range(1, 1000)) > 900
    got = simhash.near_copies(spark.createDataFrame(rows, "row long, text string")).collect()
    assert len({r.component for r in got}) <= 4  # bands miss a pair of 0.838 in 1700


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_similar_links_connect_what_all_pairs_do(least):
    rnd = random.Random(5)
    for _ in range(40):
        base = [rnd.sample(range(300), rnd.randrange(1, 40)) for _ in range(3)]
        sets = [sorted({x if rnd.random() > 0.12 else rnd.randrange(300) for x in rnd.choice(base)}) if rnd.random() > 0.05 else [] for _ in range(rnd.randrange(1, 60))]
        group = [rnd.randrange(len(sets)) for _ in sets]

        def roots(pairs, n=len(sets), group=group):
            label = list(group)
            for a, b in pairs:
                old, new = label[b], label[a]
                label = [new if x == old else x for x in label]
            return {frozenset(i for i in range(n) if label[i] == x) for x in label}

        near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if (x := set(sets[a])) | (y := set(sets[b])) == set() or len(x & y) / len(x | y) >= least]
        got = simhash.similar_links([np.array(x, np.uint64) for x in sets], np.array(group), least)
        assert roots(got) == roots(near)
