"""Language-model scores from a subword lattice.

The vocabulary is that of a public tokenizer and stays as it is. Its unigram scores start from the
vocabulary's ranks and are re-estimated on the training documents; all segmentations of a word into
pieces count, weighted by their scores, through a forward recursion in log space. Words of the training
documents are units of the lattice too: an edge over the whole word with its discounted share of the
tokens, beside the paths through pieces, which have the mass that the discounts leave. A text's score
is the marginal probability of its words and of the end after them. Pieces never cross the space
before a word, so a text's lattice falls apart into its words' and each distinct word is computed once.

Words are gathered in chunks of documents: one row per chunk and distinct word, with packed (document,
count) postings. Only these rows move; no table of words is collected or broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, steady_reads

FOLDS = 10
CHUNK_BYTES = 16_000_000
CHUNK_DOCS = 50_000
#: Added to the expected count of each piece.
FLOOR = 1e-3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LONG = 256  # bytes of a word from which it is scored alone
_SENT = "word binary, chunk long, train long, posts binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def tokens(text: str | None) -> list[bytes]:
    """Bytes lower-case A-Z only and split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _packed(blobs: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of an array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(blobs))])


def _chunk_rows(chunk: int, ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    held = np.array([held_out(i) for i in ids], np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    n = len(texts)
    pair, times = np.unique(flat * n + np.repeat(np.arange(n), sizes), return_counts=True)
    more = -(-times // 65_535)  # counts above 16 bits take several postings
    if (more > 1).any():
        pair, times = np.repeat(pair, more), np.concatenate([[65_535] * (m - 1) + [t - 65_535 * (m - 1)] for t, m in zip(times, more, strict=True)])
    word, doc = pair // n, pair % n
    posts = np.empty((len(pair), 2), "<u2")
    posts[:, 0], posts[:, 1] = doc, times
    per = np.bincount(word, minlength=len(number))
    train = np.bincount(word, times * (held[doc] == 0), minlength=len(number)).astype(np.int64)
    missing = np.array([i is None for i in ids], np.uint8)
    info = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + (sizes + 1).astype("<i8").tobytes() + held.tobytes() + missing.tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*number, None], pa.binary()),
            pa.array(np.full(len(number) + 1, chunk)),
            pa.array(np.append(train, int((held == 0).sum()))),
            _packed(np.concatenate([posts.reshape(-1).view(np.uint8), np.frombuffer(info, np.uint8)]), np.append(per * 4, len(info))),
        ],
        ["word", "chunk", "train", "posts"],
    )


def postings(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk and distinct word; the row with a null word describes the chunk's documents."""
    steady_reads(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = tokens(t.as_py())
                ids.append(i)
                texts.append(words)
                size += 8 * len(words) + 100
                if size >= chunk_bytes or len(ids) >= CHUNK_DOCS:
                    yield _chunk_rows(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield _chunk_rows(chunk, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SENT)


class Lattice:
    """All segmentations of words into the pieces of a vocabulary, for many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        self.tables = {}
        for n, ids in by.items():
            m = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(len(ids), n)
            self.tables[n] = self._slots(self._prefix(m)[:, n], np.array(ids))
        self.powers = np.ones(max(self.longest, _LONG) + 2, np.uint64)
        for k in range(1, len(self.powers)):
            self.powers[k : k + 1] = self.powers[k - 1 : k] * _BASE

    @staticmethod
    def _slots(h: np.ndarray, ids: np.ndarray) -> tuple[np.uint64, list[tuple[np.ndarray, np.ndarray]]]:
        """A hash table for whole arrays: sixteen slots or more per key, and layers for keys of one slot."""
        shift = np.uint64(64 - max(8, int(len(h) * 16).bit_length()))
        layers, left = [], np.arange(len(h))
        while len(left):
            keys, where = np.zeros(1 << (64 - int(shift)), np.uint64), np.full(1 << (64 - int(shift)), -1, np.int32)
            at = (h[left] * _MIX) >> shift
            _, first = np.unique(at, return_index=True)
            keys[at[first]], where[at[first]] = h[left[first]], ids[left[first]]
            layers.append((keys, where))
            left = np.delete(left, first)
        return shift, layers

    @staticmethod
    def _prefix(m: np.ndarray) -> np.ndarray:
        h = np.zeros((m.shape[0], m.shape[1] + 1), np.uint64)
        for j in range(m.shape[1]):
            h[:, j + 1] = h[:, j] * _BASE + m[:, j] + np.uint64(1)
        return h

    def edges(self, m: np.ndarray) -> dict[int, np.ndarray]:
        """By length: the piece that starts at each position of each row of bytes, or -1."""
        h, n, out = self._prefix(m), m.shape[1], {}
        for k, (shift, layers) in self.tables.items():
            if k > n:
                continue
            sub = h[:, k:] - h[:, : n - k + 1] * self.powers[k]
            at = (sub * _MIX) >> shift
            found = np.full(sub.shape, -1, np.int32)
            for keys, where in layers:
                hit = keys[at] == sub
                found = np.where(hit, where[at], found)
            if (found >= 0).any():
                out[k] = found
        return out

    @staticmethod
    def _forward(edges: dict, scores: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, dict]:
        s = {k: np.where(e >= 0, scores[e], -np.inf) for k, e in edges.items()}
        a = np.full((n + 1, rows), -np.inf)
        a[0] = 0.0
        for j in range(1, n + 1):
            a[j] = np.logaddexp.reduce([a[j - k] + s[k][:, j - k] for k in s if k <= j], axis=0)
        return a, s

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of bytes (a space before each word) by length, and their places; long words alone."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            where = np.flatnonzero(lengths == n)
            step = max(1, 400_000 // (int(n) + 1))
            for k in range(0, len(where), step):
                part = where[k : k + step]
                raw = b"".join(b" " + words[i] for i in part)
                yield part, np.frombuffer(raw, np.uint8).reshape(len(part), int(n) + 1)

    def _alone(self, word: bytes, scores: np.ndarray) -> float:
        a = np.full(len(word) + 1, -np.inf)
        a[0] = 0.0
        lengths = sorted(self.tables)
        for j in range(1, len(word) + 1):
            got = [a[j - k] + scores[p] for k in lengths if k <= j and (p := self.number.get(word[j - k : j])) is not None]
            a[j] = np.logaddexp.reduce(got) if got else -np.inf
        return float(a[-1])

    def _alone_expected(self, word: bytes, scores: np.ndarray) -> np.ndarray:
        """How often each piece is used in a word, over its segmentations by weight, in log space. Memory
        is linear in the word."""
        n, lengths = len(word), sorted(self.tables)
        found = [(j - k, j, p) for j in range(1, n + 1) for k in lengths if k <= j and (p := self.number.get(word[j - k : j])) is not None]
        start, end, piece = np.array(found, np.int64).reshape(-1, 3).T
        weight = scores[piece]
        a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        a[0] = b[n] = 0.0
        last = np.searchsorted(end, np.arange(n + 2))  # edges are in order of their ends
        for j in range(1, n + 1):
            x = slice(last[j], last[j + 1])
            a[j] = np.logaddexp.reduce(a[start[x]] + weight[x])
        by = np.argsort(start, kind="stable")
        first = np.searchsorted(start[by], np.arange(n + 1))
        for j in range(n - 1, -1, -1):
            x = by[first[j] : first[j + 1]]
            b[j] = np.logaddexp.reduce(weight[x] + b[end[x]])
        if a[n] == -np.inf:
            return np.zeros(len(self.pieces))
        return np.bincount(piece, np.exp(a[start] + weight + b[end] - a[n]), len(self.pieces))

    def log_probability(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """The log of the summed weight of all segmentations of each word (with a space before it)."""
        out = np.empty(len(words))
        for where, m in self._groups(words):
            if m.shape[1] > _LONG:
                out[where] = [self._alone(b" " + words[i], scores) for i in where]
            else:
                out[where] = self._forward(self.edges(m), scores, *m.shape)[0][-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How often each piece is used in the words, over their segmentations by weight. Long
        words are taken alone, in log space."""
        out = np.zeros(len(self.pieces))
        used, amounts = [np.zeros(0, np.int32)], [np.zeros(0)]
        for where, m in self._groups(words):
            c = counts[where]
            if m.shape[1] > _LONG:
                for i, k in zip(where, c, strict=True):
                    out += k * self._alone_expected(b" " + words[i], scores)
                continue
            # Weights instead of their logs: words are short. Where the sum leaves the range of doubles, every
            # weight is scaled up for each byte, which cancels in the shares.
            edges = self.edges(m)
            rows, n = m.shape
            weight = np.exp(scores)
            for scale in (1.0, 1e3, 1e6):
                s = {k: np.where(e >= 0, weight[e] * scale**k, 0.0) for k, e in edges.items()}
                a, b = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
                a[0] = b[n] = 1.0
                for j in range(1, n + 1):
                    for k in s:
                        if k <= j:
                            a[j] += a[j - k] * s[k][:, j - k]
                if a[n].min() > 1e-250:
                    break
            for j in range(n - 1, -1, -1):
                for k in s:
                    if j + k <= n:
                        b[j] += b[j + k] * s[k][:, j]
            share = c / np.maximum(a[n], 1e-300)
            for k, e in edges.items():
                used.append(np.maximum(e, 0).ravel())
                amounts.append(((a[: n - k + 1] * b[k:]).T * s[k] * share[:, None]).ravel())
        return out + np.bincount(np.concatenate(used), np.concatenate(amounts), len(out))


_LATTICES: dict[str, Lattice] = {}


def vocabulary(ranks_path: str) -> list[bytes]:
    import base64

    with open(ranks_path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def lattice(ranks_path: str) -> Lattice:
    """One for each worker process."""
    if ranks_path not in _LATTICES:
        _LATTICES[ranks_path] = Lattice(vocabulary(ranks_path))
    return _LATTICES[ranks_path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def gathered(words: Iterator[bytes], n: int = 60_000) -> Iterator[list[bytes]]:
    """Words in lists long enough for array work to pay."""
    while part := list(islice(words, n)):
        yield part


def piece_scores(words: DataFrame, ranks_path: str, passes: int = 3) -> np.ndarray:
    """The log probability of each piece, from all words (word, c) with c > 0. Each word counts once,
    for the pieces have to spell words whose own edge has little or no weight.

    The start is the vocabulary's own order: weight 1/(rank + 1). Each pass replaces it by smoothed
    expected counts. What reaches the driver is one number for each piece of the vocabulary.
    """
    size = len(vocabulary(ranks_path))
    p = 1.0 / np.arange(1, size + 1)
    scores = np.log(p / p.sum())
    for _ in range(passes):
        now = scores

        def expect(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            lat, total = lattice(ranks_path), np.zeros(size)
            for words in gathered(bytes(w) for b in batches for w in b["word"]):
                total += lat.expected(words, np.ones(len(words)), now)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": used.astype(np.int32), "n": total[used]})

        got = words.where("c > 0").select("word").mapInPandas(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.full(size, FLOOR)
        for r in got:
            n[r.piece] += r.n
        scores = np.log(n / n.sum())
    return scores


def lattice_scores(docs: DataFrame, ranks_path: str | None = None, passes: int = 3, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(doc_id as text) mod 10 is not 0. base_score is the smoothed
    word unigram, score the lattice's marginal, both log10 and both with the end. Null and empty texts
    are one end; a null doc_id counts as the empty text (held out); equal rows are scored each; no rows
    give none.
    """
    ranks_path = ranks_path or default_path()
    rows = materialize(postings(docs, chunk_bytes))
    words = materialize(rows.where("word is not null").groupBy("word").agg(F.sum("train").alias("c")))
    train_docs = int(rows.where("word is null").agg(F.sum("train")).first()[0] or 0)
    c = F.col("c")
    n, types, once, twice = words.agg(F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)).first()
    n, v = int(n) + train_docs, types + (train_docs > 0)
    spread = n + 0.1 * (v + 1)
    scores = piece_scores(words, ranks_path, passes)
    cut = once / (once + 2 * twice) if once else 0.5  # the discount of a word's count
    rest = cut * types / n if n and types else 1.0  # what is left for words through pieces
    end = float(np.log((train_docs + 0.1) / (n + 0.1)))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(ranks_path)
        for b in batches:
            spelt = np.log(rest) + lat.log_probability([bytes(w) for w in b["word"]], scores)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(b["c"].to_numpy(float) - cut, 0) / max(n, 1))
            yield b.assign(lp=np.logaddexp(spelt, whole))

    weighed = words.mapInPandas(weigh, "word binary, c long, lp double")
    joined = rows.where("word is not null").select("word", "chunk", "posts").join(weighed, "word").select("chunk", "c", "lp", "posts")
    about = rows.where("word is null").select("chunk", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("lp"), "posts")

    def total(t: pa.Table) -> pa.Table:
        c, lp, posts = t.column("c").combine_chunks(), t.column("lp"), t.column("posts")
        head = c.is_null().to_numpy(zero_copy_only=False)
        info = posts.take(pa.array(np.flatnonzero(head))).to_pylist()[0]
        k = len(info) // 18
        ids, sizes = np.frombuffer(info, "<i8", k), np.frombuffer(info, "<i8", k, 8 * k)
        held, none = np.frombuffer(info, np.uint8, k, 16 * k), np.frombuffer(info, np.uint8, k, 17 * k)
        body = np.flatnonzero(~head)
        blobs = posts.take(pa.array(body)).to_pylist()
        each = np.array([len(x) // 4 for x in blobs], np.int64)
        p = np.frombuffer(b"".join(blobs), "<u2").reshape(-1, 2)
        doc, times = p[:, 0].astype(np.int64), p[:, 1].astype(float)
        seen = np.repeat(c.fill_null(0).to_numpy(zero_copy_only=False)[body], each)
        lps = np.repeat(lp.to_numpy()[body].astype(float), each)
        base = np.bincount(doc, times * np.log10((seen + 0.1) / spread), k) + np.log10((train_docs + 0.1) / spread)
        model = (np.bincount(doc, times * lps, k) + end) / np.log(10)
        known = np.bincount(doc, times * (seen > 0), k) + (train_docs > 0)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=none.astype(bool)),
                "held_out": pa.array(held.astype(bool)),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(known.astype(np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(model),
            }
        )

    out = joined.union(about).groupBy("chunk").applyInArrow(total, _OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
