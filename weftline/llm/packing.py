"""Best-fit-decreasing packing of token sequences.

Documents of one length are interchangeable, so best fit decreasing needs only how many pieces there
are of each length: the driver packs that histogram (at most `capacity` numbers, whatever the input)
with a segment tree over remaining capacities, and emits runs of assignments. Executors number the
pieces of each length and look their places up in the runs. The packing is that of best fit
decreasing over all pieces, one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, running_offsets, spread, steady_reads

CAPACITY = 2048
END = 0
#: Distinct words that a Python worker remembers the ids of.
REMEMBERED = 300_000
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of a text, as packed little-endian 32-bit integers.

    With ranks of the same vocabulary for tiktoken, texts are encoded word by word, and words are
    remembered: this tokenizer's pattern always starts a new token at a space between two other
    characters. Texts with the string of a special token go through the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.ranks = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.full.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return self._whole(text)
        if not text:
            return b""
        first, *rest = text.split(" ")
        known, part = self.words, self.ranks.encode_ordinary
        try:
            return self._bytes(part(first)) + b"".join([known[w] for w in rest])
        except KeyError:
            pass
        if not first or first[-1].isspace() or not all(w and not w[0].isspace() and not w[-1].isspace() for w in rest):
            first, *rest = _BETWEEN.split(text)
        local = {}
        for w in set(rest):
            if w not in known:
                ids = self._bytes(part(" " + w))
                if len(known) < REMEMBERED and "\n" not in w and len(w) < 40 and not w[0].isspace() and not w[-1].isspace():
                    known[w] = ids
                else:
                    local[w] = ids
        return self._bytes(part(first)) + b"".join([local[w] if w in local else known[w] for w in rest])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """One for each worker process."""
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, paths: tuple[str, str | None] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the tokens of each text and one end, cut to capacity."""
    paths = paths or default_paths()
    steady_reads(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*paths)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(enc(text.as_py() or "") + END.to_bytes(4, "little"))
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    for c, v in zip(cols, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


class Capacities:
    """A segment tree over 0..n: which remaining capacities have an open bin."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, capacity: int, some: bool) -> None:
        k = capacity + self.size
        self.any[k] = some
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least `least`."""
        k = least + self.size
        if self.any[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                break
            k //= 2
        else:
            return None
        while k < self.size:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs counts[length] pieces of each length. Returns runs (length, first, n, bin, offset), which
    put pieces first..first+n-1 of that length at that offset of bins bin..bin+n-1, and how many bins there are.

    A piece goes to the tightest open bin that holds it, a new bin if none does. The bins of one
    remaining capacity are kept as ranges of numbers and move together.
    """
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    tree, runs, made = Capacities(capacity), [], 0

    def add(cap: int, start: int, n: int) -> None:
        if cap > 0:
            open_bins[cap].append((start, n))
            tree.put(cap, True)

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, at = counts[length], 0
        while left:
            cap = tree.tightest(length)
            if cap is None:
                cap, each = capacity, capacity // length
                start, n = made, max(1, left // each)
                made += n
            else:
                each = cap // length
                start, n = open_bins[cap].pop()
                use = min(n, max(1, left // each))
                if use < n:
                    open_bins[cap].append((start + use, n - use))
                n = use
                if not open_bins[cap]:
                    tree.put(cap, False)
            each = min(each, left)  # the last bin may take fewer
            for k in range(each):
                runs.append((length, at, n, start, capacity - cap + k * length))
                at += n
            left -= each * n
            add(cap - each * length, start, n)
    return runs, made


def pack(docs: DataFrame, paths: tuple[str, str | None] | None = None, capacity: int = CAPACITY, encode: Callable | None = None) -> DataFrame:
    """Every piece with its sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end token. Equal rows are separate documents. No rows give no pieces.
    Only texts longer than a sequence are cut.
    """
    found = materialize((encode or token_pieces)(docs, paths, capacity))
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = best_fit_decreasing(counts, capacity)
    plan = docs.sparkSession.createDataFrame(runs, "r_length long, r_first long, r_n long, r_bin long, r_offset long")
    numbered = running_offsets(found.withColumn("one", F.lit(1)), ["length"], ["doc_id", "piece", "ids_crc32"], "one", "nth", spread(sum(counts.values())))
    inside = (F.col("nth") >= F.col("r_first")) & (F.col("nth") < F.col("r_first") + F.col("r_n"))
    # The plan depends on the lengths there are, not on the number of documents: a few ten thousand rows at most.
    placed = numbered.join(F.broadcast(plan), (F.col("length") == F.col("r_length")) & inside)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r_bin") + F.col("nth") - F.col("r_first")).alias("sequence_id"), F.col("r_offset").alias("offset"))
