"""Language identification against a plain version of the method, and on held-out documents."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from weftline.llm import language, queries

SCHEMA = "doc_id long, text string, lang string, row string, word string, times long"


def bare(text):
    return Counter(w[k : k + 64] for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for k in range(0, len(w), 64))


def cut(word, size):
    marked = f"<{word}>"
    return [p for k in range(len(marked) - size + 1) if (p := marked[k : k + size]) not in "<>"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def brute(rows):
    train = [(bare(t), lang) for i, t, lang, *_ in rows if lang is not None and not held(i)]
    langs = sorted({lang for _, lang in train})
    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for c, lang in train:
        words[lang].update(c)
        for w, n in c.items():
            for size in range(1, 6):
                for p in cut(w, size):
                    grams[size][lang][p] += n

    def gains(counts, key):
        total = {k: sum(c.values()) for k, c in counts.items() if c}
        floor = 0.5 / min(total.values())
        return {k: math.log1p(counts[k][key] / total[k] / floor) for k in total if counts[k][key]}

    def of(word):
        if any(word in c for c in words.values()):
            return gains(words, word)
        for size in range(min(5, len(word) + 2), 0, -1):
            known = [p for p in cut(word, size) if any(p in c for c in grams[size].values())]
            if known:
                out = Counter()
                for p in known:
                    out.update(gains(grams[size], p))
                return {k: v / len(known) for k, v in out.items()}
        return {}

    out = []
    for i, t, *_ in rows:
        c = bare(t)
        if not c or not langs:
            out.append((i, held(i), "und", 0.0))
            continue
        sums = dict.fromkeys(langs, 0.0)
        for w, n in c.items():
            for k, g in of(w).items():
                sums[k] += n * g
        best = max(sums.values())
        pred = next(k for k in langs if round(sums[k], 6) == round(best, 6))
        out.append((i, held(i), pred, 1 / sum(math.exp(v - best) for v in sums.values())))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[3], 4))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 1e-5 for x, y in zip(got, want, strict=True))


EDGES = [(None, "the end", "en"), (901, None, "en"), (902, "", None), (903, "12 _ 3!", "fr"), (904, "日本語", None), (905, "zzzqx xq", None), (906, "the le der", None), (907, "ÉTÉ été Été", None),
         (908, "le", "fr"), (908, "le", "fr"), (909, "a" * 5000, None), (910, "x" * 70 + " b", "de"), (911, "the " * 100_000, None), (912, "i̇İ", "xx")]


def test_matches_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 60").collect()] + EDGES
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)
    same([tuple(r) for r in language.identify(df).collect()], brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(2, "the", None)], [(k, "le", "fr") for k in range(3)], [(k, None, "fr") for k in range(8)]])
def test_little_or_nothing_learned(spark, rows):
    df = spark.createDataFrame([(*r, "", "", 1) for r in rows], SCHEMA)
    same([tuple(r) for r in language.identify(df).collect()], brute(rows))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op12_language(spark, sf).collect() if r.held_out]
    assert len(got) > 200 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.99 * len(got)


def test_pieces_alone_tell_most_languages(spark):
    """Without words, as if no word of a text had been seen."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    model.words = {}
    got = [(r.lang, model.predict(r.text)[0]) for r in docs.where(language.held_out("doc_id")).collect() if r.text and r.lang]
    assert sum(a == b for a, b in got) >= 0.9 * len(got)


def test_fit_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, texts=20, most=3000)
    assert sum(map(len, model.words.values())) == 3000 and model.languages == ["de", "en", "es", "fr"]
    again = language.train(docs.repartition(7), texts=20, most=3000)
    assert again.words == model.words and again.pieces == model.pieces
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language.predict(docs, model).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
