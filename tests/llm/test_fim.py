"""Fill-in-the-middle against slices of plain strings, and back again."""

import hashlib
import re

import pytest
from weftline.llm import fim

DOCS = "doc_id long, text string"


def numbers(doc_id, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def brute(text, h, unit):
    units = {"char": list(text), "word": re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text), "line": re.findall(r"[^\n]*\n|[^\n]+", text)}[unit]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return ("spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", p, m, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, "a", "é😀é‍", "<P", "x<M>y", "<S<S", "P><", "  two words\n\n and\tmore ", "\n", "one\ntwo\n\nthree", "\x1f\x85  z", "<" * 30, "w " * 200_000]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_cuts_match_plain_slices(spark, unit):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", n string, restored string")
    got = sorted((r.doc_id or -1, r.n, r.form, r.prefix, r.middle, r.output, r.restored) for r in fim.restored(fim.fill_in_middle(df, unit=unit)).collect())
    want = []
    for k, t in rows:
        form, p, m, out = brute(t or "", numbers(k), unit)
        want.append((k or -1, len(t or ""), form, p, m, out, t or ""))
    assert got == sorted(want)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_shares_of_forms_and_no_rows(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text")
    n = {r.form: r["count"] for r in fim.fill_in_middle(df).groupBy("form").count().collect()}
    assert 320 < n["plain"] < 480 and 600 < n["spm"] < 840
    assert fim.restored(fim.fill_in_middle(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="page")
