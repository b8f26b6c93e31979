"""Fill-in-the-middle: a text is cut at unit boundaries into prefix, middle and suffix, which change places.

A text is decoded to an array of code points. Every code point has a class; a unit is a run of neighbours of one
class, so the places where neighbouring classes differ are the boundaries, and the two that a document's hash
chooses by rank are indexed. Slices of the array are encoded again. Nothing is shuffled: each row is its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ship

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many stay plain, and so many of the others have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: The white space that parts words and lines.
_SPACE = np.array([0x20, *range(0x09, 0x0E)], np.uint32)
UNITS = ("char", "word", "line")
#: Rows that are held with their pieces and outputs at a time.
SLICE = 512


@dataclass(frozen=True)
class Fim:
    """A transformed text and what became of it; the lengths are null if it is plain."""

    form: str
    n: int
    prefix: str | None
    middle: str | None
    suffix: str | None
    output: str


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and end, 0 and the length included.

    char: every code point is a class of its own. word: white space and the rest are two classes. line: the class
    is the number of line ends before.
    """
    if unit == "char":
        classes = np.arange(len(points))
    elif unit == "word":
        classes = np.isin(points, _SPACE)
    elif unit == "line":
        classes = np.cumsum(points == 10) - (points == 10)
    else:
        raise ValueError(f"unit is one of {UNITS}")
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def transform(text: str, h: tuple[int, int, int, int], unit: str = "char") -> Fim:
    """The text in the form that its four numbers choose."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points) or h[2] % 100 >= 100 - PLAIN or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Fim("plain", len(points), None, None, None, text)
    ends = boundaries(points, unit)
    a, b = sorted((h[0] % len(ends), h[1] % len(ends)))
    cut = [piece.tobytes().decode("utf-32-le") for piece in np.split(points, ends[[a, b]])]
    prefix, middle, suffix = cut
    if h[3] % 100 < SUFFIX_FIRST:
        return Fim("spm", len(points), prefix, middle, suffix, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
    return Fim("psm", len(points), prefix, middle, suffix, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle)


def restore(output: str, form: str) -> str:
    """The text that transform() was given. A marker cannot arise where a piece meets one, as each begins with a
    character that stands nowhere else in it."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, rest = output[len(PREFIX) :].split(SUFFIX, 1)
        suffix, middle = rest.split(MIDDLE, 1)
    else:
        suffix, rest = output[len(SUFFIX) :].split(PREFIX, 1)
        prefix, middle = rest.split(MIDDLE, 1)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of every row, n in code points.

    The four numbers of a document come from the SHA-256 of seed, colon and id, so that any run gives the same. Null
    texts count as empty and stay plain; a null id is hashed as no digits; equal rows are transformed alike; other
    columns play no part. Memory is that of SLICE texts, each whole whatever its length.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    ship(docs.sparkSession)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), hashed.alias("hash"))
    names = ["n", "form", "prefix", "middle", "suffix", "output"]
    kinds = [pa.int64(), *[pa.string()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            got = [transform(t.as_py(), tuple(int(x.as_py()[8 * k : 8 * k + 8], 16) for k in range(4)), unit) for t, x in zip(b.column(1), b.column(2), strict=True)]
            cols = [pa.array([getattr(f, name) for f in got], kind) for name, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, *names])

    return rows.mapInArrow(run, f"{id_col} long, n long, form string, prefix string, middle string, suffix string, output string")


def restored(df: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with `restored`: the text rebuilt from output and form alone."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = [restore(o, f) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*b.schema.names, "restored"])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", restored string")
