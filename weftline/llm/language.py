"""Language identification: words first, and where a word was never seen, ever shorter pieces of it.

A word that the training texts have scores each language by the logarithm of its relative frequency there. A word
that they lack falls back to its longest pieces (character n-grams, the word's ends marked) of which at least one was
seen, and scores by the mean of theirs. What a language lacks counts as one small frequency, the same for all
languages, so that no language gains by having less text; scores are kept as gains over it. A text's gains add up,
and their softmax is the score of the language that is chosen.

The classifier is fitted on a bounded number of texts of each language and keeps a bounded number of words, so that
it can go to every worker whatever the size of the corpus; each text is then scored where it is, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, ship

#: The longest pieces of an unseen word that are looked for.
LONGEST = 5
#: Share of an occurrence that a language has of what it was never seen with.
UNSEEN = 0.5
#: The answer for texts without letters.
UNKNOWN = "und"
#: The longest word that is one: longer runs of letters are cut into words of this length.
WORD_CHARS = 64
#: Training texts are those whose number by crc32 of the id is not this.
HELD_OUT, PARTS = 2, 4
#: The classifier is fitted on about this many texts of each language, chosen by hash.
FIT_TEXTS = 5_000
#: Counts of a word in a language that the classifier keeps: the largest; rarer words back off to their pieces.
FIT_WORDS = 120_000
_WORDS = re.compile(r"[^\W\d_]+")
#: Texts whose words are held at a time.
SLICE = 256
#: Unseen words whose pieces a worker remembers.
REMEMBERED = 50_000


def words(text: str) -> Counter[str]:
    """The words of a text, in lower case, with their numbers: runs of letters."""
    found = _WORDS.findall(text.lower())
    if max(map(len, found), default=0) > WORD_CHARS:
        found = [w[k : k + WORD_CHARS] for w in found for k in range(0, len(w), WORD_CHARS)]
    return Counter(found)


def pieces(word: str, size: int) -> list[str]:
    """The pieces of a size of a word between its marks; a mark alone is none."""
    marked = f"<{word}>"
    return [p for k in range(len(marked) - size + 1) if (p := marked[k : k + size]) not in ("<", ">")]


def _gains(counts: dict[str, dict[int, int]]) -> dict[str, tuple[tuple[int, float], ...]]:
    """For each key the languages that have it, each with the log of its relative frequency over that of what a
    language lacks."""
    total: Counter[int] = Counter()
    for by in counts.values():
        total.update(by)
    floor = UNSEEN / min(total.values(), default=1)
    scale = {k: 1 / n / floor for k, n in total.items()}
    return {key: tuple((k, log1p(n * scale[k])) for k, n in by.items()) for key, by in counts.items()}


class Model:
    """Gains of words and of pieces by language."""

    def __init__(self, languages: list[str], counts: list[tuple[str, str, int]]) -> None:
        self.languages, self.remembered = languages, {}
        place = {name: k for k, name in enumerate(languages)}
        whole: dict[str, dict[int, int]] = {}
        levels: list[dict[str, dict[int, int]]] = [{} for _ in range(LONGEST + 1)]
        for lang, word, times in counts:
            k = place[lang]
            whole.setdefault(word, {})[k] = times
            for size in range(1, min(LONGEST, len(word) + 2) + 1):
                level = levels[size]
                for p in pieces(word, size):
                    by = level.setdefault(p, {})
                    by[k] = by.get(k, 0) + times
        self.words = _gains(whole)
        self.pieces = {p: g for level in levels for p, g in _gains(level).items()}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"remembered": {}}

    def backed_off(self, word: str) -> tuple:
        """The mean gains of the longest pieces of which any is known; none if no letter is."""
        got = self.remembered.get(word)
        if got is None:
            got, known, marked = (), self.pieces.get, f"<{word}>"
            n = len(marked)
            for size in range(min(LONGEST, n), 0, -1):
                found = [g for k in range(n - size + 1) if (g := known(marked[k : k + size]))]
                if found:
                    sums = dict.fromkeys(range(len(self.languages)), 0.0)
                    for gains in found:
                        for k, g in gains:
                            sums[k] += g
                    got = tuple((k, v / len(found)) for k, v in sums.items() if v)
                    break
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[word] = got
        return got

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its part in the softmax of all gains. A text without letters, or any if nothing was learned, is
        `und` with 0; where nothing is known, or languages tie to six places, the first by name is chosen."""
        found = words(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        sums, table = [0.0] * len(self.languages), self.words
        for word, times in found.items():
            for k, g in table.get(word) or self.backed_off(word):
                sums[k] += times * g
        best = max(sums)
        chosen = next(k for k, v in enumerate(sums) if round(v, 6) == round(best, 6))
        return self.languages[chosen], 1 / sum(exp(v - best) for v in sums)


def held_out(id_col: str) -> Column:
    """Whether a row takes no part in learning; a null id counts as one without digits."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(PARTS)) == HELD_OUT


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = FIT_TEXTS, most: int = FIT_WORDS) -> Model:
    """Learns from rows that are not held out and have a language: of each language about `texts`, those whose hashes fall
    into that share of all (rows that are equal count each), of these the `most` largest counts. Words are
    counted where the texts are.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text), F.lit(2**40))
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), place.alias("place"))
    share = materialize(labelled.groupBy("lang").agg((F.lit(float(texts)) / F.count(F.lit(1)) * 2**40).alias("below")))  # a row for each language
    chosen = labelled.join(share, "lang").where("place < below").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            sums: dict[str, Counter[str]] = defaultdict(Counter)
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[lang].update(words(t.as_py()))
            rows = [(lang, w, n) for lang, c in sums.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "times"])

    counts = chosen.mapInArrow(count, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    kept = counts.orderBy(F.desc("times"), "lang", "word").limit(most).collect()
    return Model(sorted(r.lang for r in share.collect()), [(r.lang, r.word, r.times) for r in kept])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, each scored where it is; see Model.predict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"{id_col} long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out and have a language, and predicts that of every one.

    Null and empty texts are `und`; a null id is held out or not as an id without digits; rows that repeat count
    each and are answered each; other columns play no part. No rows give none.
    """
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
