"""URL filters, fingerprints and mixing against plain Python on small tables."""

import hashlib
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from weftline.llm import fingerprints, mixing, url_filter
from weftline.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def brute_rule(host, path):
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


@pytest.mark.parametrize("sf", [SF])
def test_urls_match_the_rules(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    urls = {r.page_id: r.url for r in rows.collect()}
    got = url_filter.filter_urls(rows).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = brute_url(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        want = brute_rule(host, path)
        assert (r.rule, r.verdict) == (want or (None, "allow"))


def test_aliases_carry_blocks_and_allows_win(spark):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    rows = [
        (1, "http://a.net/x#frag", link.format("https://example.org/es/1")),  # alias of a blocked url
        (2, "https://example.org/es/1", None),
        (3, "http://b.net/", '<META HTTP-EQUIV="refresh" CONTENT="0; url=/moved">'),
        (4, "http://b.net/moved", link.format("http://shop.com/de/1")),
        (5, "http://c.net/q", link.format("//shop.com/de/2")),
        (6, "http://shop.com/de/2", link.format("https://www.shop.com/fr/2")),  # an allowed alias
        (7, "http://a.net/x", ""),
        (8, None, None),
        (9, "no scheme", link.format("https://example.org/es/1")),
        (10, "http://A.NET/other", "<p>canonical"),
        (11, "http://x.net/r?a=1&b=2", None),
        (12, "http://y.net/", '<link href="http://x.net/r?a=1&amp;b=2" rel=canonical>'),
        (7, "http://a.net/x", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = defaultdict(list)
    for r in url_filter.filter_urls(df).collect():
        got[r.page_id].append((r.rule, r.verdict))
    assert got[1] == [(None, "block")] and got[7] == [(None, "block")] * 2
    assert got[3] == [(None, "block")] and got[4] == [(None, "block")]
    assert got[5] == [(None, "allow")] and got[6] == [("com/de/", "block")]
    assert got[8] == got[9] == got[10] == got[11] == [(None, "allow")]
    known = spark.createDataFrame([("http://x.net/r?a=1&b=2", "https://example.org/es/9")], "src string, dst string")
    again = {r.page_id: r.verdict for r in url_filter.filter_urls(df, redirects=known).collect()}
    assert again[11] == again[12] == "block"
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    tabled = defaultdict(list)
    for r in url_filter.filter_urls(df, compiled=0).collect():
        tabled[r.page_id].append((r.rule, r.verdict))
    assert tabled == got


def test_long_rule_lists(spark):
    import random

    rnd = random.Random(4)
    part = lambda: rnd.choice(["a", "b", "net", "org"])
    rules = [(rnd.choice(["allow", "block"]), ".".join(part() for _ in range(rnd.randrange(1, 4))), "/" + "/".join(part() for _ in range(rnd.randrange(3)))) for _ in range(url_filter.MAX_RULES + 100)]
    rows = [(".".join(part() for _ in range(rnd.randrange(1, 5))), "/" + "/".join(part() for _ in range(4))) for _ in range(300)] + [("", ""), ("", "/a"), ("a", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, host string, path string")
    got = {r.i: r.hit and tuple(r.hit) for r in url_filter.match_rules(df, rules).collect()}
    assert len(got) == len(rows)
    for i, (host, path) in enumerate(rows):
        fits = [(len(h + p), -k, h + p, v) for k, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else None)


def test_components(spark):
    import random

    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(120)]
    edges += [(1000, i) for i in range(1001, 1400)] + [(7, 7), (5, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "s long, d long"), "s", "d").collect()}
    assert got == {n: find(n) for n in parent}


def brute_canon(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for i, (k, t) in enumerate(rows):
        t, x = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + x[:h]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), float(brute_canon(e) == brute_canon(t)), float(brute_canon(x) == brute_canon(t))))
    return sorted(out, key=str)


def test_many_ranges(spark):
    bounds = [3 * i - 900 for i in range(1500)]
    keys = [-(2**63), -901, *range(-900, 3700, 7), 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (0, 1, 256, 257, 1500):
        got = {r[0]: r[1] for r in df.select("k", fingerprints._bucket(F.col("k"), bounds[:n])).collect()}
        assert got == {k: sum(b <= k for b in bounds[:n]) for k in keys}


def test_edits_over_many_ranges(spark):
    rows = [(5 * i % 4001 - 700, f"text {i} " * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.edited_pairs(df, 900).select("id", "n_chars", F.sha2("edited", 256)).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([r[:3] for r in brute_edits(rows)], key=str)


def test_folded_text_is_composed_again(spark):
    texts = ["\u01f0\u0323", "J\u030c\u0323", "\u1e96 \u1f52", "\u0390", "\u03b9\u0308\u0301", "a\u0345\u0301"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.canon for r in fingerprints.digests(df).collect()}
    assert got == {i: brute_canon(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("buckets", [1, 4, 40])
def test_fingerprints(spark, buckets):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(5000, "Straße  ÉTÉ"), (5001, "STRASSE été "), (5002, None), (5003, ""), (None, "x"), (5003, "b"), (5003, "b"), (9, "\U0001f600" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    got = fingerprints.fingerprint_edits(df, buckets).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=str) == brute_edits(rows)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[5000] == by[5001] and len(by[5000]) == 32
    texts = dict(rows)
    assert len(set(by.values())) == len({brute_canon(texts[k]) for k in by})


def test_fingerprints_of_one_and_of_none(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    r = fingerprints.fingerprint_edits(one).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r[0].near_next == 1.0
    assert fingerprints.fingerprint_edits(one.limit(0)).count() == 0


def test_exact_groups_and_collisions(spark, monkeypatch):
    df = spark.createDataFrame([(3, "A  b"), (1, "a b"), (2, "c"), (None, None), (7, "")], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in fingerprints.exact_groups(df).collect()}
    assert got == {3: 1, 1: 1, 2: 2, None: 7, 7: 7}
    d = fingerprints.digests(df)
    assert fingerprints.colliding(d, 0).count() == fingerprints.colliding(d).count() == 0
    monkeypatch.setattr(fingerprints, "wide_digest", lambda c: F.lit("0" * 32))  # every digest collides
    rows = fingerprints.exact_groups(df).collect()
    assert {r.doc_id: r.group_id for r in rows} == got


def brute_targets(sizes):
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else (left * weight[s] / w) for s in order}
        over = {s for s in order if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


def check_mix(rows, got, block):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[r[2]] += size[r[0]]
    target, taken = brute_targets(by), defaultdict(int)
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    for g in got:
        s = source[g.id]
        assert g.size == size[g.id] and g.source_size == by[s] and abs(g.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= g.taken <= 3 * g.size
        taken[s] += g.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= 1.5 * block, (s, taken[s], target[s])  # half a block, and the last block is short


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()] + [(9001, None, None), (9002, "a b c " * 500, None), (9003, "", "src1"), (9004, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(-1))
    mix = mixing.Mix(df, block_words=16, shard_slots=128)
    got = mix.taken().collect()
    check_mix(rows, got, 16)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.Mix(df.repartition(5), block_words=16, shard_slots=128).taken().collect()), key=str)
    s = mix.slots.collect()
    n = {r["rank"]: (r.n_blocks, r.n_slots) for r in mix.sources.collect()}
    assert len({(r.shard, r.place) for r in s}) == len(s) == sum(x[1] for x in n.values())
    uses = defaultdict(int)
    for r in s:
        uses[r["rank"], r.block] += 1
    for rank, (blocks, total) in n.items():
        got = [uses[rank, b] for b in range(blocks)]
        assert sum(got) == total and (not got or max(got) - min(got) <= 1)
    assert mixing.Mix(df.limit(0)).taken().count() == 0


def test_mix_rows_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.Mix(docs, block_words=32)
    words = {r.doc_id: len(WORD.findall(r.text)) for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    out = defaultdict(int)
    for r in mix.rows().collect():
        k = len(WORD.findall(r.text))
        out[r.doc_id] += k
        assert r.n_chars == len(r.text) and (k < words[r.doc_id] or r.text == text[r.doc_id])
    assert dict(out) == {r.id: r.taken for r in mix.taken().collect() if r.taken}
    assert mix.rows().columns == docs.columns
