"""Removal of long repeated passages with suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus. Three
steps find these strings without comparing all shards with all:

1. Each window of `length` bytes has an anchor, the smallest hash of the short strings in it. Equal windows
   have equal anchors. Consecutive windows of one anchor form a segment; segments whose anchor occurs
   nowhere else are done. Segments of equal content repeat as a whole.
2. The distinct segments of an anchor meet in a shard of bounded size. Each shard is sorted into a suffix
   array by Larsson-Sadakane refinement; Kasai's common prefixes tell which windows occur twice in it.
3. An anchor with more segments than a shard takes is dealt over several. Their windows leave each shard
   as a sorted run, one of each content, and the runs are merged by binary search. A window found in
   several runs is reported for its representative; where it stood in its own shard it was marked there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, steady_reads

LENGTH = 400
#: Bytes of a passage of over 50 words: what nearly every one has.
PASSAGE = 200
GRAM = 32
BATCH_BYTES = 2_000_000
#: Small enough for a shard's arrays to stay in a processor's cache.
SHARD_BYTES = 300_000
#: Distinct segments of one anchor that go to one shard.
SHARD_SEGMENTS = 500
#: Size up to which a list of documents (keys and intervals) is broadcast; a longer one is joined by a shuffle.
BROADCAST_BYTES = 48_000_000
_TABLE = np.random.default_rng(17).integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_ODD = np.random.default_rng(19).integers(1, 2**64, 16, np.uint64) | np.uint64(1)
_SEPARATOR = 255  # no byte of UTF-8
_SEGMENT = "anchor long, h1 long, h2 long, k1 long, k2 long, start int, size int, loops boolean"


# --- suffix arrays -------------------------------------------------------------------------------


def packed8(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number (zeros after the end)."""
    p = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    x = (p[:-1] << np.uint64(8)) | p[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return ((x[:-4] << np.uint64(32)) | x[4:])[: len(t)]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (under 2 GB) in order. Larsson-Sadakane: suffixes sorted by their first h
    bytes are refined to 2h by the ranks of what follows; groups of one are left alone."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    key = packed8(t)
    if (t == 0).any():  # zeros after the end sort before real zero bytes: shorter suffixes come first
        short = np.minimum(n - np.arange(n), 8)
        order = np.lexsort((short, key))
        new = _starts(key[order]) | _starts(short[order])
    else:
        order = np.argsort(key)
        new = _starts(key[order])
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank[n] = -1  # what follows the end
    order = order.astype(np.int32)
    live = np.flatnonzero(~_alone(new)).astype(np.int32)  # places in order whose group has several suffixes
    h = 8
    while len(live):
        s = order[live]
        follow = rank[np.minimum(s.astype(np.int64) + h, n)]
        pair = (rank[s].astype(np.int64) << 32) | (follow.astype(np.int64) + 1)
        by = np.argsort(pair)
        s, pair = s[by], pair[by]
        order[live] = s
        new = _starts(pair)
        rank[s] = live[np.maximum.accumulate(np.where(new, np.arange(len(s), dtype=np.int32), 0))]
        live = live[~_alone(new)]
        h *= 2
    return order


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _alone(new: np.ndarray) -> np.ndarray:
    """Which runs that start here also end here."""
    out = new.copy()
    out[:-1] &= new[1:]
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: how many bytes its suffix shares with the one before it in order, and which
    that is (-1 for the first). Kasai: the number drops by at most one from a position to the next. It
    drops by exactly one where the bytes before both suffixes agree, so only the other positions are
    compared, eight bytes at a time."""
    n = len(t)
    prev = np.full(n, -1)
    prev[order[1:]] = order[:-1]
    at = np.arange(n)
    fresh = (prev < 0) | (at == 0) | (prev == 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = t[inner - 1] != t[prev[inner] - 1]
    heads = np.flatnonzero(fresh)
    size = np.zeros(n, np.int64)
    key = packed8(t)
    i = heads[prev[heads] >= 0]
    j, k = prev[i], 0
    while len(i):
        inside = (i + k < n) & (j + k < n)
        i, j = i[inside], j[inside]
        x = key[i + k] ^ key[j + k]
        room = n - k - np.maximum(i, j)
        same = (x == 0) & (room > 8)
        ended = ~same
        if ended.any():
            xe = x[ended]
            equal = np.full(len(xe), 8)
            for b in range(7, -1, -1):
                equal[(xe >> np.uint64(8 * (7 - b))) & np.uint64(255) != 0] = b
            size[i[ended]] = k + np.minimum(equal, room[ended])
        i, j = i[same], j[same]
        size[i] = k + 8
        k += 8
    lead = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.maximum(size[lead] - (at - lead), 0), prev


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct texts: the window starts whose window occurs at another start of any."""
    joined = bytes([_SEPARATOR]).join(texts)
    t = np.frombuffer(joined, np.uint8)
    hit = np.zeros(len(t), bool)
    if len(t):
        size, prev = common_prefixes(t, suffix_array(t))
        twice = np.flatnonzero(size >= length)
        hit[twice] = hit[prev[twice]] = True
    out, at = [], 0
    for x in texts:
        out.append(np.flatnonzero(hit[at : at + max(0, len(x) - length + 1)]))
        at += len(x) + 1
    return out


# --- anchors -------------------------------------------------------------------------------------


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes (a power of two) from each position."""
    h, k, r = _TABLE[b], 1, 0
    while k < gram:
        h = h[:-k] * _ODD[r] + h[k:]
        k, r = 2 * k, r + 1
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, k = h, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - k :][: len(h) - width + 1]) if k < width else m


def segments(texts: list[bytes], length: int, gram: int) -> list[tuple[int, int, int, int, int]]:
    """(text number, start, size, anchor, loops): runs of windows of one anchor. loops: the anchor's string
    stands in the segment more than once, so that windows of the segment may equal each other."""
    big = [(k, t) for k, t in enumerate(texts) if len(t) >= length]
    if not big:
        return []
    b = np.frombuffer(b"".join(t for _, t in big), np.uint8)
    h, width = gram_hashes(b, gram), length - gram + 1
    anchor = sliding_min(h, width)  # one for each window start
    sizes = np.array([len(t) for _, t in big])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[begins[begins < len(anchor)]] = True
    stop = begins + sizes - length + 1  # windows from here on cross into the next text
    new[stop[stop < len(anchor)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(anchor))
    text = np.searchsorted(begins, starts, "right") - 1
    good = starts < stop[text]
    text, starts, ends = text[good], starts[good], ends[good]
    values = anchor[starts]
    loops = [np.count_nonzero(h[s : e + width - 1] == a) > 1 for s, e, a in zip(starts.tolist(), ends.tolist(), values, strict=True)]
    return [(big[k][0], int(s - begins[k]), int(e - s) + length - 1, int(a), x) for k, s, e, a, x in zip(text, starts, ends, values.view(np.int64), loops, strict=True)]


def _halves(b: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_digest(b)
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("weftline"), F.octet_length(text), text).alias("k2")]


def all_segments(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys, size = [], [], 0
            last = b.num_rows - 1
            for i, (k1, k2, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                texts.append(raw)
                keys.append((k1, k2))
                size += len(raw)
                if size >= BATCH_BYTES or i == last:
                    rows = [(a, *_halves(texts[k][s : s + n]), *keys[k], s, n, x) for k, s, n, a, x in segments(texts, length, gram)]
                    cols = list(zip(*rows, strict=True)) or [[]] * 8
                    types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], ["anchor", "h1", "h2", "k1", "k2", "start", "size", "loops"])
                    texts, keys, size = [], [], 0

    return keyed.select("k1", "k2", "t").mapInArrow(run, _SEGMENT)


# --- shards --------------------------------------------------------------------------------------


def _runs(starts: np.ndarray) -> bytes:
    """Consecutive numbers as packed (first, last) pairs."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.column_stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]]).astype("<i4").tobytes()


def _by_size(df: DataFrame, size: Column) -> DataFrame:
    """df with a broadcast hint if its measured size allows it."""
    total = df.agg(F.sum(size + 48)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, shard_segments: int = SHARD_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans): documents with their 128-bit text keys, and for each key the maximal runs
    (a, b) of bytes that windows which occur elsewhere cover."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("t", text).withColumns({c: k for c, k in zip(("k1", "k2"), text_key(F.col("t")), strict=True)})
    segs = materialize(all_segments(keyed.where(F.octet_length("t") >= length), length, gram))
    # Written before the joins: Spark splits a join only where both sides come straight from a shuffle.
    often = materialize(segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.bool_or("loops").alias("any")).where("n > 1 or any").select("anchor"))
    # Copies of a text have equal keys: their segments become one row each, with a count.
    same = ["anchor", "h1", "h2", "k1", "k2", "start", "size", "loops"]
    # The anchor is computed anew after the join, so that the grouping does not reuse its partitions: those of
    # a frequent anchor are split by the skew join, and each part is counted before it moves.
    repeated = segs.join(often, "anchor").withColumn("anchor", F.col("anchor").bitwiseXOR(F.lit(0)))
    cand = materialize(repeated.groupBy(*same).agg(F.count(F.lit(1)).alias("n")))
    kinds = cand.groupBy("anchor", "h1", "h2").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "start", "size")).alias("rep"), F.bool_or("loops").alias("loops"))
    kinds = materialize(kinds.select("anchor", "h1", "h2", "n", "rep.*", "loops"))
    several = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or("loops").alias("any")).where("kinds > 1 or any").drop("any"))
    wanted = materialize(kinds.join(several, "anchor"))
    # Texts of the segments that have to be compared, cut out where the documents are.
    places = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "h1", "h2", "kinds", "start", "size")).alias("parts"))
    one = keyed.select("k1", "k2", "t")
    texts = one.join(_by_size(materialize(places), F.size("parts") * 40), ["k1", "k2"])
    cut = texts.select(F.encode("t", "utf-8").alias("raw"), F.explode("parts").alias("p"))
    cut = cut.select("p.*", F.substring("raw", F.col("p.start") + 1, F.col("p.size")).alias("body"))
    cut = materialize(cut.groupBy("anchor", "h1", "h2", "kinds").agg(F.first("body").alias("body")))  # copies gave one each
    total = cut.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    salts = F.ceil(F.col("kinds") / shard_segments).cast("int")
    cut = cut.withColumn("salts", salts).withColumn("shard", F.pmod(F.xxhash64("anchor", F.pmod(F.col("h1"), F.col("salts"))), F.lit(shards)).cast("int"))

    def sort_shard(t: pa.Table) -> pa.Table:
        """Each segment's repeated windows; of dealt anchors also the other windows, as sorted runs."""
        anchor, h1, h2, salts = (t.column(c).to_pylist() for c in ("anchor", "h1", "h2", "salts"))
        body = [x.as_buffer().to_pybytes() for x in t.column("body")]
        rows: list[tuple] = []
        hits = repeated_starts(body, length)
        spare: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for k, hit in enumerate(hits):
            rows.append((anchor[k], h1[k], h2[k], _runs(hit), None, None, None))
            if salts[k] > 1:
                # Repeated windows go along too, one of each content: windows elsewhere may equal them.
                free = np.arange(len(body[k]) - length + 1)
                b = np.frombuffer(body[k], np.uint8)
                h = np.zeros(len(b) - length + 1, np.uint64)
                for r, x in enumerate(gram_hashes(b, GRAM)[g : g + len(h)] for g in range(0, length - GRAM + 1, GRAM)):
                    h = h * _ODD[r % 16] + x
                rest = length % GRAM
                if rest:
                    h = h * _ODD[15] + gram_hashes(b, GRAM)[length - GRAM : length - GRAM + len(h)]
                spare.setdefault(anchor[k], []).append((h, k, free))
        for a, parts in spare.items():
            h = np.concatenate([x[0] for x in parts])
            seg = np.concatenate([np.full(len(x[2]), x[1]) for x in parts])
            pos = np.concatenate([x[2] for x in parts])
            order = np.argsort(h)
            order = order[np.concatenate([[True], h[order[1:]] != h[order[:-1]]])]
            h, seg, pos = h[order], seg[order], pos[order]
            # Ranges of each run, sixteen and more: they grow as the root of the number of runs, and so do the groups.
            bits = 4 + (salts[parts[0][1]].bit_length() - 1) // 2
            part = (h >> np.uint64(64 - bits)).astype(int)
            for r in np.unique(part):
                m = part == r
                ids = np.array([(h1[k], h2[k]) for k in seg[m]], "<i8")
                rows.append((a, int(r), int(t.column("shard")[0].as_py()), None, h[m].astype("<u8").tobytes(), ids.tobytes(), pos[m].astype("<i4").tobytes()))
        cols = list(zip(*rows, strict=True))
        types = [pa.int64()] * 3 + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=["anchor", "h1", "h2", "runs", "hashes", "ids", "places"])

    found = cut.select("shard", "anchor", "h1", "h2", "salts", "body").groupBy("shard")
    found = materialize(found.applyInArrow(sort_shard, "anchor long, h1 long, h2 long, runs binary, hashes binary, ids binary, places binary"))

    def merge_runs(t: pd.DataFrame) -> pd.DataFrame:
        """Windows of a dealt anchor that stand in two runs or more: each run is searched in the others."""
        runs = [np.frombuffer(x, "<u8") for x in t["hashes"]]
        ids, places = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in t["ids"]], [np.frombuffer(x, "<i4") for x in t["places"]]
        alone = np.sort(np.concatenate([np.unique(r) for r in runs]))
        out: list[tuple] = []
        for r, who, where in zip(runs, ids, places, strict=True):
            twice = np.searchsorted(alone, r, "right") - np.searchsorted(alone, r, "left") > 1
            got = pd.DataFrame({"h1": who[twice, 0], "h2": who[twice, 1], "at": where[twice]})
            out += [(int(t["anchor"].iloc[0]), a, b, _runs(np.sort(g["at"].to_numpy()))) for (a, b), g in got.groupby(["h1", "h2"])]
        return pd.DataFrame(out, columns=["anchor", "h1", "h2", "runs"])

    dealt = found.where("hashes is not null").select("anchor", F.col("h1").alias("part"), "hashes", "ids", "places")
    crossed = dealt.groupBy("anchor", "part").applyInPandas(merge_runs, "anchor long, h1 long, h2 long, runs binary")
    partial = found.where("hashes is null and length(runs) > 0").select("anchor", "h1", "h2", "runs").union(crossed)
    every = kinds.where("n > 1").select("anchor", "h1", "h2", F.lit(None).cast("binary").alias("runs"))  # null: all of it
    marks = partial.union(every)
    placed = cand.join(marks, ["anchor", "h1", "h2"]).select("k1", "k2", F.struct("start", "size", "runs").alias("mark"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [covered(m, length) for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["k1", "k2", "spans"])

    every = placed.groupBy("k1", "k2").agg(F.collect_list("mark").alias("marks"))
    return keyed, materialize(every.mapInArrow(merge, "k1 long, k2 long, spans array<struct<a:int,b:int>>"))


def covered(marks: list[dict], length: int) -> list[tuple[int, int]]:
    """(begin, end) of the maximal runs of bytes that windows at the marked starts cover."""
    pairs = [np.array([[m["start"], m["start"] + m["size"] - length]]) if m["runs"] is None else np.frombuffer(m["runs"], "<i4").reshape(-1, 2) + m["start"] for m in marks]
    p = np.concatenate(pairs)
    p = p[np.argsort(p[:, 0], kind="stable")]
    begin, end = p[:, 0], np.maximum.accumulate(p[:, 1] + length)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return list(zip(begin[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)].tolist(), strict=True))


def nested_intervals(docs: DataFrame, length: int, shorter: int, **how) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans with those of `shorter` as short). A string of `length` bytes that repeats lies in both
    places in a run of repeated shorter ones, so only texts with such a run are searched for it."""
    keyed, short = repeated_intervals(docs, shorter, **how)
    long_run = F.exists("spans", lambda x: x["b"] - x["a"] >= length)
    asked = materialize(short.where(long_run).select("k1", "k2"))
    some = keyed.join(_by_size(asked, F.lit(0)), ["k1", "k2"], "left_semi").select(F.col("t").alias("text"))
    _, spans = repeated_intervals(some, length, **how)
    return keyed, materialize(short.withColumnRenamed("spans", "short").join(spans, ["k1", "k2"], "left"))


#: Names of results and working columns.
_TAKEN = {"spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "t", "k1", "k2", "marks", "n_in_passages", "short"}


def without_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False, shorter: int | None = None, **how) -> DataFrame:
    """Every row of docs (but its text) with spans (removed byte ranges), n_bytes, n_removed, n_spans,
    kept_sha256, and kept: the bytes that stay, or with as_text their text without halves of characters. With
    shorter also n_in_passages: the bytes that repeated strings of so many bytes cover.

    Windows are judged on the texts as they are, so all occurrences of a repeated passage go. Null texts
    count as empty; a row that repeats another is another document, so both lose all windows; texts of
    fewer than `length` bytes lose nothing; ids play no part and may be null or repeated. Columns of docs
    with the name of a result or of a working column are left out.
    """
    steady_reads(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in _TAKEN])

    size = lambda c: F.coalesce(F.size(c), F.lit(0)) * 16
    if shorter is None:
        keyed, spans = repeated_intervals(docs, length, **how)
        spans = _by_size(spans, size("spans"))
    else:
        keyed, spans = nested_intervals(docs, length, shorter, **how)
        spans = _by_size(spans, size("spans") + size("short"))
    joined = keyed.join(spans.withColumnRenamed("spans", "marks"), ["k1", "k2"], "left")
    names = [c for c in docs.columns if c != "text"]
    schema = joined.select(*names).schema
    width = len(names)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t, m in zip(b.column(width), b.column(width + 1), strict=True):
                raw = t.as_buffer().to_pybytes()
                spans = [[x["a"], x["b"]] for x in m.as_py() or ()]
                at, kept = 0, []
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                row = (spans, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if as_text else kept)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.list_(pa.list_(pa.int64())), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary()]
            new = [pa.array(c, ty) for c, ty in zip(cols, types, strict=True)]
            heads = [*b.schema.names[:width], "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            if shorter is not None:
                new.append(pa.array([sum(x["b"] - x["a"] for x in s.as_py() or ()) for s in b.column(width + 2)], pa.int64()))
                heads.append("n_in_passages")
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *new], heads)

    out = "spans array<array<bigint>>, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept " + ("string" if as_text else "binary")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out += "" if shorter is None else ", n_in_passages bigint"
    return joined.select(*names, "t", "marks", *([] if shorter is None else ["short"])).mapInArrow(remove, f"{head}, {out}")
