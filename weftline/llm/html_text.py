"""Main text of web pages: structural blocks, then nearest-url page differencing.

Each page is cut into blocks of text; blocks that their markup names as menus, headers, footers, sidebars,
adverts, forms, comments and the like go at once. What a site repeats from page to page without naming it is
found by differencing: pages of a host are ordered by url path, each is paired with the nearest others there
that are no copies of it, lines are aligned by longest common subsequence, and shared lines go, also
those inside an article or main element. There half of the neighbours, three or more, have to share a line, for
two articles of a site may well quote one passage; elsewhere, and in an article's blocks whose name speaks of furniture,
most are enough, however few they are, or one that shares no more than half of the page. Edited copies of a page
delete nothing: what they do not share is alike all the same.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import lower_ascii, ship

#: Elements whose text is never shown, or is never main text.
HIDDEN = {"script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "head", "select", "textarea"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset"}
#: Elements that start a block.
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that mark furniture where a name begins or ends with one.
STRONG = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "ad", "ads", "advert", "advertisement", "promo", "sponsor",
    "sponsored", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "social", "related", "recommended", "comment", "comments",
    "replies", "disqus", "pagination", "pager", "toolbar", "copyright", "contentinfo", "complementary",
}
#: Words that mark furniture only alone or beside a word for the whole page: an article has its own header.
WEAK = {"header", "footer", "masthead", "banner", "share", "sharing", "search", "legal", "alert", "toc", "reply"}
WHOLE = {"site", "page", "global", "top", "bottom", "main", "wrapper", "wrap", "container", "inner", "outer", "bar", "box", "area", "block", "section", "sticky", "fixed", "list", "links", "posts", "form", "left", "right"}
#: Words by which a name speaks of something that is elsewhere (with-sidebar) or absent (no-ads).
ABOUT = {"with", "has", "no", "without", "not", "is", "by"}
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_MARK = re.compile("[>\"']")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}
_SPACE = re.compile(r"\s+")
#: Pages of one span that are differenced together.
SPAN_PAGES = 200
#: Spans at most: their bounds and ends go to every task.
MOST_SPANS = 4_096
#: Neighbours on either side that a page is compared with: the nearest of other content.
NEIGHBOURS = 4
#: A line outside articles goes if most neighbours share it, or one that shares no more than this part of the page.
MOST_SHARED = 0.5
#: A neighbour is a copy, and no other page of the site, if what two pages do not share has this part of its pairs of
#: words in common.
COPY_LIKENESS = 0.5
#: Elements that close one of their kind that is open, unless one of BARRIERS was opened after it.
CLOSES_OWN = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
BARRIERS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body"} | FURNITURE


def names_furniture(names: str, whole: bool = False) -> bool:
    """Whether a class, id or role names something that is not main text; whole: by nothing but such words."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_\d]+", name) if x]
        if not parts or ABOUT & set(parts) or whole and not all(x in STRONG or x in WEAK or x in WHOLE for x in parts):
            continue
        if parts[0] in STRONG or parts[-1] in STRONG:
            return True
        if WEAK & set(parts) and all(x in WEAK or x in WHOLE for x in parts):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag, comment and declaration in order; the name is empty for the latter two.

    A tag ends at the first > outside quotes. Once a quote or a tag is not closed, no later search looks for what is
    not there, so the whole is linear in the page, closed or not.
    """
    at, last, quoted = 0, page.rfind(">"), {'"': page.rfind('"'), "'": page.rfind("'")}
    plain = False  # quotes are characters like others from where a tag was found not to end outside them
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i) or page.startswith("<![CDATA[", i):
            mark = "-->" if page[i + 2] == "-" else "]]>"
            end = page.find(mark, i + 4)
            at = len(page) if end < 0 else end + len(mark)
            yield i, at, False, "", ""
        elif page[i + 1 : i + 2] in ("!", "?"):
            if i < last:
                at = page.index(">", i) + 1
                yield i, at, False, "", ""
        elif (m := _NAME.match(page, i + 1)) and i < last:
            end, k = -1, m.end()
            while not plain:
                found = _MARK.search(page, k)
                if found is None:
                    plain = True
                elif found[0] == ">":
                    end = found.start()
                    break
                elif found.start() < quoted[found[0]]:
                    k = page.index(found[0], found.end()) + 1
                else:
                    k = found.end()
            if end < 0:
                end = page.find(">", m.end())
            if end >= 0:
                at = end + 1
                yield i, at, bool(m[1]), m[2].lower(), page[m.end() : end]


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, marked, inside) of each block in page order; marked: inside furniture, inside: in an article or main
    element, whose own header is no furniture, and in no block there whose name speaks of furniture. Tags that are not closed end with what encloses them; a page cut
    off in the middle keeps what there is. Linear in the page, however deep its elements stand."""
    page = page or ""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, hidden, furniture, article's own, in an article
    places: dict[str, list[int]] = {}  # where elements of a name are open
    barriers: list[int] = []
    buf: list[str] = []
    hidden = marked = inside = article = False

    def flush() -> None:
        if buf:
            text = _SPACE.sub(" ", _html.unescape("".join(buf))).strip()
            if text:
                out.append((text, marked, inside))
            buf.clear()

    def close(k: int) -> None:
        nonlocal hidden, marked, inside, article
        while len(stack) > k:
            places[stack.pop()[0]].pop()
        while barriers and barriers[-1] >= k:
            barriers.pop()
        hidden, marked, inside, article = stack[-1][1:] if stack else (False, False, False, False)

    at = 0
    for start, end, closing, name, attributes in tags(page):
        if start < at:
            continue  # within what has no markup
        if not hidden and start > at:
            buf.append(page[at:start])
        at = end
        if not name:
            continue
        open_at = places.get(name)
        if closing:
            if open_at:
                k = open_at[-1]
                if name in BLOCKS or any(x[2] != (stack[k - 1][2] if k else False) for x in stack[k:]):
                    flush()
                close(k)
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name in CLOSES_OWN and open_at and open_at[-1] > (barriers[-1] if barriers else -1):
            close(open_at[-1])
        if name in _RAW:
            at = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, at).end()
            continue
        low = name in FURNITURE and not (name == "header" and inside)
        named = [next((g for g in a if g), "") for a in _ATTR.findall(attributes)]
        whole = article  # in an article only names of nothing but furniture on a block decide; others are a vote
        low = low or (not whole or name in BLOCKS) and any(names_furniture(x, whole) for x in named)
        doubtful = whole and not low and name in BLOCKS and any(map(names_furniture, named))
        if name in ("html", "body", "article", "main"):
            low = doubtful = False
        if (low and not marked) or name in HIDDEN:
            flush()
        hidden, marked, article = hidden or name in HIDDEN, marked or low, article or name in ("article", "main")
        inside = (inside or name in ("article", "main")) and not doubtful
        if name in BARRIERS:
            barriers.append(len(stack))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, hidden, marked, inside, article))
    if not hidden and at < len(page):
        rest = page[at:]
        cut = re.search(r"<[A-Za-z/!][^<]*\Z", rest)  # a tag that the page breaks off in
        buf.append(rest[: cut.start()] if cut else rest)
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """The places in a of a longest common subsequence of a and b (whole lines)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    got = set(range(lo)) | set(range(len(a) - hi, len(a)))
    in_b = set(b[lo : len(b) - hi])
    x = [i for i in range(lo, len(a) - hi) if a[i] in in_b]  # only lines of both can be in it
    in_a = {a[i] for i in x}
    y = [s for s in b[lo : len(b) - hi] if s in in_a]
    if x and y:
        ids = {s: k for k, s in enumerate(in_a)}
        yv = np.array([ids[s] for s in y])
        rows = [np.zeros(len(y) + 1, np.int32)]
        for i in x:
            up = rows[-1]
            best = np.maximum(up[1:], np.where(yv == ids[a[i]], up[:-1] + 1, 0))
            rows.append(np.concatenate([[0], np.maximum.accumulate(best)]).astype(np.int32))
        i, j = len(x), len(y)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                got.add(x[i - 1])
                i, j = i - 1, j - 1
    return got


def _pairs(lines: list[str], without: set[int]) -> Counter[tuple[str, str]]:
    words = " ".join(x for j, x in enumerate(lines) if j not in without).split()
    return Counter(zip(words, words[1:], strict=False)) or Counter(zip(words, words, strict=True))


def _is_copy(own: list[str], other: list[str], mine: set[int]) -> bool:
    """Whether what two pages do not share is alike, or one of them has nothing else: an edited copy."""
    theirs = shared_lines(other, own)
    a, b = _pairs(own, mine), _pairs(other, theirs)
    least = min(a.total(), b.total())
    return not least or (a & b).total() >= COPY_LIKENESS * least


def difference(own: list[str], inside: list[bool], others: list[list[str]]) -> set[int]:
    """The lines of own to delete after a comparison with its neighbours, which all differ from it.

    Edited copies of the page delete nothing. Of the others most have to share a line outside an article, or one of them
    that shares no more than half of the page; inside an article half have to, three or more. What two pages
    share that have no other neighbours, and whose rests are not alike, is their site's.
    """
    hits = [(h, o) for o in others if (h := shared_lines(own, o))]
    good = [h for h, o in hits if not _is_copy(own, o, h)]
    n = len(others) - (len(hits) - len(good))
    votes = Counter(j for h in good for j in h)
    size = [len(x) for x in own]
    few = {j for h in good if sum(size[j] for j in h) <= MOST_SHARED * sum(size) for j in h}
    return {j for j, v in votes.items() if (v > 2 and 2 * v >= n if inside[j] else 2 * v > n or j in few)}


def _ranges(keys: DataFrame, span_pages: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """Where the spans of the order of keys (with content, a digest) begin, but for the first; and the other spans
    that the key of a page also goes to: those that lack neighbours before or after them without it, one page of
    each run of equal content. At most MOST_SPANS, so that these lists are small."""
    spans = min(MOST_SPANS, max(1, -(-keys.count() // span_pages)))
    cols = [c for c in keys.columns if c != "content"]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list[tuple] = []
        last: list[tuple] = []
        before = None
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if row[-1] != before:
                    before = row[-1]
                    if len(first) < NEIGHBOURS:
                        first.append(row)
                    last = [*last[1 - NEIGHBOURS :], row]
        rows = [(*x, at) for part, at in ((first, 0), (last, 1)) for x in part]
        if rows:
            yield pd.DataFrame(rows, columns=[*cols, "content", "at"]).astype({"content": "int64"})

    keys = keys.select(*cols, F.coalesce("content", F.lit(0)).alias("content"))
    found = keys.repartitionByRange(spans, *cols).sortWithinPartitions(*cols).mapInPandas(ends, "host string, path string, u string, k long, content long, at int")
    parts: dict[int, tuple[list, list]] = {}
    for r in found.withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r.part, ([], []))[r.at].append(((r.host, r.path, r.u, r.k), r.content))
    whole = sorted(parts.values(), key=lambda x: x[0][0])
    also: dict[tuple, list[int]] = {}
    for side, order in ((1, range(len(whole))), (0, range(len(whole) - 1, -1, -1))):
        near: list[tuple] = []  # the pages nearest to the span, of different content
        for s in order:
            for key, _ in near:
                also.setdefault(key, []).append(s)
            for page in whole[s][side] if side else whole[s][side][::-1]:
                near = [*[x for x in near if x[1] != page[1]][1 - NEIGHBOURS :], page]
    return [x[0][0][0] for x in whole[1:]], also


class _Host:
    """Pages of a host in path order, as runs of equal content; a run is settled when its neighbours are known."""

    def __init__(self) -> None:
        self.runs: list[tuple[list[str], list[bool], list[tuple]]] = []
        self.next = 0

    def add(self, lines: list[str], inside: list[bool], member: tuple | None) -> list[tuple]:
        if not self.runs or self.runs[-1][0] != lines or self.runs[-1][1] != inside:
            self.runs.append((lines, inside, []))
        if member:
            self.runs[-1][2].append(member)
        return self.settled(NEIGHBOURS)

    def settled(self, ahead: int) -> list[tuple]:
        """(id, url, text) of the runs that have so many others after them."""
        out = []
        while len(self.runs) - self.next > ahead:
            lines, inside, members = self.runs[self.next]
            if members:
                near: list[list[str]] = []
                for other in self.runs[max(0, self.next - NEIGHBOURS) : self.next + NEIGHBOURS + 1]:
                    if other[0] != lines and other[0] not in near:
                        near.append(other[0])
                gone = difference(lines, inside, near)
                text = "\n".join(s for j, s in enumerate(lines) if j not in gone)
                out += [(*m, text, len(text)) for m in members]
            self.next += 1
            if self.next > NEIGHBOURS:
                del self.runs[0]
                self.next -= 1
        return out


def main_text(pages: DataFrame, id_col: str = "page_id", span_pages: int = SPAN_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every row.

    All pages are ordered by host, path, url and id and cut there into spans of about span_pages; the
    pages next to a span, one of each content, are also sent to it, so that neighbours meet at every size and a
    host with a third of all pages is many spans. Each span is read in order, a window of pages at a time. Pages
    that are equal but for the url are copies: they have the same neighbours, and none is another's. Null html
    gives an empty text; null urls form a host of their own; equal rows are kept; no rows give none.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    u = F.coalesce("url", F.lit(""))
    base = base.withColumn("host", lower_ascii(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)))
    base = base.withColumn("path", F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    base = base.select("id", "url", "html", F.struct("host", "path", u.alias("u"), F.coalesce("id", F.lit(-(2**63))).alias("k")).alias("key"))
    ship(pages.sparkSession)
    bounds, also = _ranges(base.select("key.*", F.xxhash64("html").alias("content")), span_pages)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[(t, inside) for t, marked, inside in blocks(x.as_py()) if not marked] for x in b.column(2)]
            keys = [tuple(x.values()) for x in b.column(3).to_pylist()]
            rows = []  # row, span, ghost
            for i, k in enumerate(keys):
                rows.append((i, bisect_right(bounds, k), False))
                rows += [(i, span, True) for span in also.get(k, ())]
            take = pa.array([x[0] for x in rows], pa.int64())
            lines = pa.array([[x[0] for x in page] for page in got], pa.list_(pa.string())).take(take)
            inside = pa.array([[x[1] for x in page] for page in got], pa.list_(pa.bool_())).take(take)
            span, ghost = pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(3).take(take), span, ghost, lines, inside], ["id", "url", "key", "span", "ghost", "lines", "inside"])

    cut = base.mapInArrow(strip, "id long, url string, key struct<host string, path string, u string, k long>, span int, ghost boolean, lines array<string>, inside array<boolean>")
    out = f"{id_col} long, url string, text string, n_chars long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], [id_col, "url", "text", "n_chars"])

        now, host = None, _Host()
        for b in batches:
            done: list[tuple] = []
            ids, urls, ghosts = (b.column(k).to_pylist() for k in (0, 1, 4))
            for k, (key, span) in enumerate(zip(b.column(2), b.column(3).to_pylist(), strict=True)):
                place = (span, key["host"].as_py())
                if place != now:
                    done += host.settled(0)
                    now, host = place, _Host()
                done += host.add(b.column(5)[k].as_py(), b.column(6)[k].as_py(), None if ghosts[k] else (ids[k], urls[k]))
            yield packed(done)
        yield packed(host.settled(0))

    return cut.repartition("span").sortWithinPartitions("span", "key", "ghost").mapInArrow(compare, out)
