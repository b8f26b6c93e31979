"""Text expressions: tokens, trigrams, wildcards, hashes of identity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What words are made of.
WORD_CHAR = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_\s]"


def normalise(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores a space."""
    return F.trim(F.regexp_replace(F.lower(text), _NOT_WORD, " "))


def tokens(text: Column) -> Column:
    """Words of a text in order; an empty array for none."""
    return F.filter(F.split(normalise(text), r"\s+"), lambda t: t != "")


def words(query: str) -> list[str]:
    """The words of a question, on the driver, by the rule of tokens()."""
    return re.sub(r"[^\w\s]", " ", query.lower()).split()


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces before and one after it."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def like_pattern(wildcard: str) -> str:
    """A `*` pattern as a LIKE pattern; % and _ stand for themselves."""
    return wildcard.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def wildcard(c: Column, pattern: str) -> Column:
    return c.ilike(like_pattern(pattern))


def chunk_key(doc_id: Column, index: Column, text: Column) -> Column:
    """An identity that depends on place and content."""
    return F.concat_ws(":", F.lit("chunk"), F.length(doc_id.cast("string")).cast("string"), doc_id.cast("string"), index.cast("string"), F.sha2(text, 256))


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def present(c: Column) -> Column:
    """A field that says something: not null, blank or N/A."""
    t = F.trim(c)
    return F.when((t != "") & ~F.upper(t).isin("N/A", "NA", "NONE"), t)


def fact_text(what: Column, when: Column, who: Column, why: Column) -> Column:
    """`what | When: w | Involving: x | why`, without what is missing."""
    label = lambda name, c: F.concat(F.lit(name), present(c))
    return F.concat_ws(" | ", present(what), label("When: ", when), label("Involving: ", who), present(why))


def embedding_text(text: Column, start: Column, end: Column, entities: Column | None = None) -> Column:
    """The text with its dates and entities, as it is embedded."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    dated = (
        F.when(start.isNotNull() & end.isNotNull() & (day(start) != day(end)), F.concat(text, F.lit(" (happened from "), day(start), F.lit(" to "), day(end), F.lit(")")))
        .when(start.isNotNull(), F.concat(text, F.lit(" (happened in "), day(start), F.lit(")")))
        .otherwise(text)
    )
    if entities is None:
        return dated
    return F.when(F.coalesce(F.size(entities), F.lit(0)) > 0, F.concat(dated, F.lit(" ["), F.array_join(entities, ", "), F.lit("]"))).otherwise(dated)
