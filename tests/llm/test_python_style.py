"""Suffix-array dedup, packing, SimHash, lattice scores, toxicity, rules and html against plain Python."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.llm import html_text, lattice_lm, packing, quality_rules, simhash, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").cache()


# --- suffix arrays -----------------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(1)
    for _ in range(200):
        b = bytes(rnd.randrange(rnd.choice([1, 2, 4, 255])) for _ in range(rnd.randrange(1, 150)))
        b = b[: len(b) // 2] + b if rnd.random() < 0.5 else b
        t = np.frombuffer(b, np.uint8)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_dedup.suffix_array(t).tolist() == want
        size, prev = suffix_dedup.common_prefixes(t, np.array(want))
        for k, i in enumerate(want[1:], 1):
            j = want[k - 1]
            same = next((m for m in range(len(b)) if i + m >= len(b) or j + m >= len(b) or b[i + m] != b[j + m]), len(b))
            assert size[i] == same and prev[i] == j


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, docs, small):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh é") for _ in range(6))
    passage = " ".join(word() for _ in range(90))
    rows = [tuple(r) for r in docs.collect()]
    rows += [(10_000 + i, f"{word()} {word()} {passage} {word() * 3} {passage[i:] if i % 2 else ''}{word()}") for i in range(40)]
    rows += [(20_000, "a" * 401), (20_001, "a" * 399), (20_002, "ab" * 700), (None, None), (20_003, ""), (20_003, passage), (20_003, passage), (20_004, "x" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("k1", "t", "size", "kept", "marks", "anchor")})
    how = {"shard_bytes": 20_000, "shard_segments": 4} if small else {}
    got = suffix_dedup.without_repeats(df, 400, **how).collect()
    want = sorted(zip([str(r[0]) for r in rows], brute_repeats([r[1] for r in rows], 400), strict=True))
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed
    both = suffix_dedup.without_repeats(df, 400, shorter=200, **how).collect()
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in both) == want
    short = sorted((str(r[0]), x[1]) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 200), strict=True))
    assert sorted((str(r.doc_id), r.n_in_passages) for r in both) == short


def test_repeats_by_shuffle_joins(spark, docs, monkeypatch):
    want = sorted(suffix_dedup.without_repeats(docs, 300, shorter=100).select("doc_id", "n_removed", "n_in_passages").collect())
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(suffix_dedup.without_repeats(docs, 300, shorter=100).select("doc_id", "n_removed", "n_in_passages").collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeats_of_nothing(spark, docs):
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


# --- packing ------------------------------------------------------------------------------------


def test_tightest():
    t = packing.Capacities(2048)
    rnd, inside = random.Random(2), set()
    for _ in range(2000):
        c = rnd.randrange(0, 2049)
        (inside.add if rnd.random() < 0.5 else inside.discard)(c)
        t.put(c, c in inside)
        q = rnd.randrange(0, 2049)
        assert t.tightest(q) == min((x for x in inside if x >= q), default=None)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_that_of_one_by_one(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 64, 2048])
    counts = Counter(rnd.randrange(1, cap + 1) for _ in range(rnd.choice([0, 50, 3000])))
    runs, made = packing.best_fit_decreasing(counts, cap)
    free: list[int] = []
    for n in sorted(counts.elements(), reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(cap - n)
    assert made == len(free)
    at, left = defaultdict(list), Counter()
    for length, first, n, b, offset in runs:
        left[length] += n
        for k in range(n):
            at[b + k].append((offset, length))
    assert left == counts and sorted(cap - sum(x[1] for x in v) for v in at.values()) == sorted(free)
    for v in at.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length


def test_pack(spark, docs):
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in docs.collect()] + [(9000, None), (9001, ""), (9002, "<|endoftext|> x  y\n\nz \t "), (9003, " lead"), (9003, " lead"), (9004, "wort " * 7000), (None, "n  b c\x1cd\x85e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(3))
    got = packing.pack(df).collect()
    tok = Tokenizer.from_file(packing.default_paths()[0])
    want, total = Counter(), 0
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, (s, n) in enumerate(packing.cut_points(len(ids), 2048)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for v in at.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= math.ceil(total / 2048) * 1.05 + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_encoder_agrees_with_the_tokenizer(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    enc = packing.Encoder(*packing.default_paths())
    plain = packing.Encoder(packing.default_paths()[0])
    for t in texts + ["", " ", "a  b", "a \n b", "\n", "it's 3,5 x", "　a b", "a​b  c"]:
        assert enc(t) == plain(t)


# --- SimHash ------------------------------------------------------------------------------------


def brute_simhash(text):
    import xxhash

    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    nodes = sorted(set(fps.values()))
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    low = defaultdict(list)
    for i, f in fps.items():
        low[find(f)].append(i)
    return {i: min(v) for v in low.values() for i in v}


@pytest.mark.parametrize("paired", [32, 1])
def test_near_duplicates(spark, docs, paired):
    rows = [tuple(r) for r in docs.collect()]
    base = max((r[1] for r in rows), key=len)
    rows += [(5000 + i, " ".join(w for j, w in enumerate(base.split(" ")) if j != 7 * i)) for i in range(90)]
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "one"), (7004, "ONE"), (7005, "É one"), (7006, base), (7007, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df, paired=paired).collect()}
    fps = {i: brute_simhash(t) for i, t in rows}
    assert {i: v[0] for i, v in got.items()} == fps
    assert {i: v[1] for i, v in got.items()} == brute_components(fps)


def test_links_of_random_fingerprints(spark):
    rnd = random.Random(9)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps]
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    for paired in (2, 1000):
        got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(df, paired).collect()}
        assert got <= {frozenset(p) for p in near}
        want = brute_components({f: f for f in fps})
        root = {f: f for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in map(tuple, got):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert {f: find(f) for f in fps} == want
    assert simhash.near_duplicates(df.limit(0).select(F.col("fp").alias("doc_id"), F.lit("").alias("text"))).count() == 0


# --- lattice ------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    rnd = random.Random(4)
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b"ba", b" a", b"abc", b"cab", b" ab", b"aab"]
    lat = lattice_lm.Lattice(pieces)
    p = np.array([rnd.random() for _ in pieces])
    scores = np.log(p / p.sum())
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))).encode() for _ in range(60)] + [b"ab" * 200]

    def paths(w):
        if not w:
            yield ()
        for k in range(1, len(w) + 1):
            if w[:k] in lat.number:
                for rest in paths(w[k:]):
                    yield (lat.number[w[:k]], *rest)

    got = lat.log_probability(words, scores)
    use = np.zeros(len(pieces))
    for w, g in zip(words[:-1], got, strict=False):
        each = [(sum(scores[i] for i in q), q) for q in paths(b" " + w)]
        total = sum(math.exp(x) for x, _ in each)
        assert abs(g - math.log(total)) < 1e-9
        for x, q in each:
            for i in q:
                use[i] += math.exp(x) / total
    assert np.allclose(lat.expected(words[:-1], np.ones(len(words) - 1), scores), use)
    assert abs(got[-1] - lat._alone(b" " + words[-1], scores)) < 1e-9 and np.isfinite(got[-1])


def test_expected_pieces_of_long_words():
    from fractions import Fraction

    rnd = random.Random(9)
    weights = {bytes([x]): Fraction(1, 10) for x in range(256)} | {b"ab": Fraction(3, 10), b"abc": Fraction(1, 5), b"ca": Fraction(1, 4), b"bcab": Fraction(1, 10), b" a": Fraction(1, 5)}
    scores = np.log(np.array([float(x) for x in weights.values()]))
    words = [bytes(rnd.choice(b"abc") for _ in range(n)) for n in (256, 300, 400)]
    want = Counter()
    for times, w in enumerate(words, 1):
        w = b" " + w
        n = len(w)
        edges = [(j - k, j, w[j - k : j]) for j in range(1, n + 1) for k in range(1, 5) if k <= j and w[j - k : j] in weights]
        a, b = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
        for i, j, p in edges:
            a[j] += a[i] * weights[p]
        for i, j, p in sorted(edges, reverse=True):
            b[i] += b[j] * weights[p]
        for i, j, p in edges:
            want[p] += times * float(a[i] * weights[p] * b[j] / a[n])
    got = lattice_lm.Lattice(list(weights)).expected(words, np.array([1.0, 2.0, 3.0]), scores)
    assert np.allclose(got, [want[p] for p in weights])


def test_lattice_scores(spark, docs):
    rows = [tuple(r) for r in docs.collect()] + [(9000, None), (9001, ""), (9001, ""), (None, "the the"), (9005, "y" * 3000), (9006, "a " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(0))
    got = lattice_lm.lattice_scores(df, chunk_bytes=60_000).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, [w.translate(low) for w in WORD.findall(t or "")]) for i, t in rows]
    c = Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, w in words:
        if not held(i):
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 4)) for i, w in words)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    again = {r.doc_id: r.score for r in lattice_lm.lattice_scores(df.repartition(3), chunk_bytes=200_000).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 * abs(r.score) for r in got)
    assert lattice_lm.lattice_scores(df.limit(0)).count() == 0


# --- toxicity and rules -------------------------------------------------------------------------


def test_ordinal_fit_orders_grades():
    rnd = random.Random(3)
    bad = ["grr", "ugh", "bah"]
    rows, y = [], []
    for _ in range(900):
        g = rnd.choice([0, 0, 0, 1, 2])
        rows.append(Counter([f"w{rnd.randrange(200)}" for _ in range(40)] + [rnd.choice(bad) for _ in range((0, 2, 9)[g])]))
        y.append(g)
    m = toxicity.fit(rows, (np.array(y) > 0).astype(int), np.array(y))
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 2
    text = lambda k: "w1 w2 w3 " + "grr ugh bah " * k
    e = [m.grades(text(k))[0] for k in (0, 1, 4)]
    assert e[0] < 0.1 and e[0] < e[1] < e[2] and e[2] > 1.5


def test_toxicity_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d, lab.where("doc_id % 4 <> 0"))
    got = toxicity.score(d, model).join(lab.where("doc_id % 4 = 0"), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = defaultdict(int, {(r.toxic, r.rejected): r["count"] for r in got})
    assert n[1, True] >= 0.9 * (n[1, True] + n[1, False])
    assert n[0, True] <= 0.01 * (n[0, True] + n[0, False])


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot")], "doc_id long, text string").withColumn("rejected", F.lit("x"))
    lab = spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = toxicity.score(df, model).collect()
    assert len(got) == 4 and not any(r.rejected for r in got)
    assert toxicity.keep_clean(df, model).count() == 4 and toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.score(df.limit(0), model).count() == 0


def brute_stats(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_rules(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(90_000, None), (90_001, ""), (90_002, "a b c d e f g h " * 5), (90_003, "x\nx\n \nx y\nx"), (90_004, "#" * 50)]
    d = d.union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("kept", F.lit(1))
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.train(d, lab.where("doc_id % 3 <> 0"))
    assert rules and all(rules)
    got = quality_rules.judge(d, rules).collect()
    text = {r.doc_id: r.text for r in d.collect()}
    assert len(got) == len(text)
    for r in got:
        n, chars, symbols, dup, rep = brute_stats(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and (r.kept or r.base_failed or True) and not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got if not r.base_failed}
    held = [(kept[r.doc_id], r.quality) for r in lab.where("doc_id % 3 = 0").collect() if r.doc_id in kept]
    assert sum(k == (q == 1) for k, q in held) >= 0.95 * len(held)
    assert quality_rules.judge(d.limit(0), rules).count() == 0
    assert quality_rules.learn({f: np.zeros(0) for f in quality_rules.FEATURES}, np.zeros(0)) == []


# --- html ---------------------------------------------------------------------------------------


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav>
    <div class="ad">Buy</div><div class="headline">Top</div><main><h1>A &amp; B</h1><p><b>one<br><p>two
      <i>three</i>&nbsp;x<script>var t="</p>";</script></p><!-- no --><ul><li>four<li>five</ul>
      <div id="comments-list"><p>troll</p></div></main><footer>&copy; x</footer> <p>after</p><p>cut <a hre"""
    got = html_text.blocks(page)
    assert [t for t, m, _ in got if not m] == ["Top", "A & B", "one", "two three x", "four", "five", "after", "cut"]
    assert [t for t, m, _ in got if m] == ["Home", "Buy", "troll", "© x"]
    assert [t for t, _, s in got if s] == ["A & B", "one", "two three x", "four", "five", "troll"]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<script>never closed") == []


def test_blocks_keep_what_belongs_to_the_article():
    page = """<header><h1>Site</h1></header><div class="site-header">Site</div><article><header><h1>Title</h1></header><div class="article-header">By me</div>
      <div class="side-by-side">Left</div><div class="share">Share</div></article><div class="content with-sidebar">Text</div><div class="sidebar-left">Links</div>"""
    assert [t for t, m, _ in html_text.blocks(page) if not m] == ["Title", "By me", "Left", "Text"]


def test_blocks_are_linear():
    start = time.perf_counter()
    assert html_text.blocks("<div>" * 20_000 + "</p>" * 20_000 + "x") == [("x", False, False)]
    assert html_text.blocks("<p><div>" + "<b>" * 20_000 + "<p></p>" * 20_000 + "x")[0][0] == "x"
    assert time.perf_counter() - start < 10


def test_differencing_without_an_article_element(spark):
    notice = "We value your privacy and that of our partners, read all about it here. " * 2
    page = "<body><div>Top of the site</div><div>" + notice.strip() + "</div><p>{}</p><p>{}</p><div>Imprint</div></body>"
    rows = [(i, f"http://a.net/{i:02}", page.format(f"Story {i} begins", f"and ends {i}")) for i in range(20)]  # mostly boilerplate
    art = "<body><article><p>Follow us</p><p>{}</p><p>{}</p></article></body>"
    rows += [(100 + i, f"http://b.net/{i:02}", art.format(f"Story {i} " * 3, "A quotation of two stories." if i in (3, 4) else f"End {i}")) for i in range(12)]
    para = [f"Paragraph {k} of one long story. " * 3 for k in range(10)]
    for i in range(3):  # copies with an edit, between other pages
        rows.append((200 + i, f"http://c.net/{i}", "".join(f"<p>{x.strip()}</p>" for x in [*para[:-1], f"Edit {i}"])))
    rows += [(210 + i, f"http://c.net/x{i}", f"<p>Other {i}</p>") for i in range(9)]
    rows += [(300 + i, f"http://d.net/{i:03}", page.format("Same", "story " * 9) if 10 <= i < 60 else page.format(f"Story {i} " * 9, i)) for i in range(70)]  # a run of copies
    for span_pages in (7, 200):
        got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), span_pages=span_pages).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == f"Story {i} begins\nand ends {i}" for i in range(20))
        assert all(got[100 + i] == (f"Story {i} " * 3).strip() + "\n" + ("A quotation of two stories." if i in (3, 4) else f"End {i}") for i in range(12))
        assert all(got[200 + i] == "\n".join([*[x.strip() for x in para[:-1]], f"Edit {i}"]) for i in range(3))
        assert all(got[300 + i] == (f"Story {i} " * 9).strip() + f"\n{i}" for i in [*range(10), *range(60, 70)])
        assert all(got[300 + i] == "Same\n" + ("story " * 9).strip() for i in range(10, 60))


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randrange(0, 12))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        got = html_text.shared_lines(a, b)
        assert len(got) == n[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(got))


def test_main_text(spark):
    page = "<body><div>Site name</div><div>{}</div><div>Imprint</div></body>"
    art = "<body><article><p>Shared words here</p><p>{}</p></article></body>"
    rows = [(i, f"http://h.net/a/{i}", page.format(f"Body {i} " * 9)) for i in range(12)]
    rows += [(20, "http://h.net/b/1", art.format("x" * 30)), (21, "http://h.net/b/2", art.format("y" * 30))]
    rows += [(30, "http://k.net/a/1", page.format("alone")), (31, None, None), (32, None, "<p>q</p>"), (33, "http://z.net/c", page.format("copy")), (34, "http://z.net/d", page.format("copy"))]
    rows += [(35, "http://z.net/d", "")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = html_text.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == ("Body %d " % i * 9).strip() for i in range(12))
    assert by[20] == "Shared words here\n" + "x" * 30 and by[30] == "Site name\nalone\nImprint"
    assert by[31] == by[35] == "" and by[32] == "q" and by[33] == by[34] == "Site name\ncopy\nImprint"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("span_pages", [3, 200])
def test_main_text_compares_nearest_paths_across_folders_and_spans(spark, span_pages):
    page = "<body><div>Menu of {}</div><div>{}</div><div>Imprint of {}</div></body>"
    rows = [(i, f"http://h{i % 2}.net/post-{i * 37 % 101}/", page.format(i % 2, f"Body {i} " * 9, i % 2)) for i in range(50)]
    # Neighbours of one folder that share a line with their nearest pages only.
    pair = "<body><div>Serial {}</div><div>{}</div></body>"
    rows += [(100 + i, f"http://s.net/a/{i:03}x{i * 7919 % 1000:03}", pair.format(i // 2, f"Text {i} " * 9)) for i in range(600)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), span_pages=span_pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (f"Body {i} " * 9).strip() for i in range(50))
    assert all(got[100 + i] == (f"Text {i} " * 9).strip() for i in range(600))


def test_main_text_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    import html as H

    for r in html_text.main_text(pages).collect():
        body = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|br|h1)>", body)]
        assert r.text == "\n".join(x for x in want if x)
