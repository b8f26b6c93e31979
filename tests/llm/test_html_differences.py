"""Unclosed markup in linear time, names inside articles, and differencing on hosts of every size."""

import random
import time

import pytest
from weftline.llm.html_text import blocks, difference


@pytest.mark.parametrize("piece", ["<p ", '<a href="x', "</p", '<div class="x', "<", "<!x", "<![CDATA[", "<a 'b\"", "<b><i ", "&amp", "<title>", "<p></"])
def test_a_megabyte_of_broken_markup(piece):
    start = time.process_time()
    blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 10


def test_broken_markup_keeps_text():
    assert [b[0] for b in blocks('<p>one<p title="a>b">two</p>three<a href="x>four</a><p>five')] == ["one", "two", "threefour", "five"]
    assert [b[0] for b in blocks("a < b <c and <p>d<!-- e > --> f</p>")] == ["a < b d f"] or [b[0] for b in blocks("<p>1 < 2 <p>3<!-- x -->4")] == ["1 < 2", "34"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<section class="related-work"><p>prior art</p></section>', ["prior art"]),
        ('<div class="social-sciences">science</div>', ["science"]),
        ('<div class="comment-on-policy">policy</div>', ["policy"]),
        ('<div id="menu-of-the-day">soup</div>', ["soup"]),
        ('<p>a <b class="notice">important</b> c</p>', ["a important c"]),
        ('<div class="comments"><p>first!</p></div><aside>see also</aside><p>text</p>', ["text"]),
    ],
)
def test_names_in_an_article(html, want):
    assert [t for t, marked, _ in blocks(f"<body><article>{html}</article></body>") if not marked] == want


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.mark.parametrize("pages", [2, 3, 4, 9])
@pytest.mark.parametrize("share", [0.1, 0.6, 0.95])
@pytest.mark.parametrize("words", [2, 60])
def test_boilerplate_goes_on_hosts_of_every_size(pages, share, words):
    r = random.Random(pages)
    total = 20
    menu = [sentence(r, words) for _ in range(round(share * total))]
    own = [[sentence(r, words) for _ in range(total - len(menu))] for _ in range(pages)]
    whole = [menu + o for o in own]
    for k, page in enumerate(whole):
        others = [x for j, x in enumerate(whole) if j != k][:8]
        assert difference(page, [False] * total, others) == set(range(len(menu)))


def test_edited_copies_keep_their_text():
    r = random.Random(5)
    page = [sentence(r, 40) for _ in range(12)]
    for changed in (1, 4):
        copy = [" ".join(w if j % 7 or i >= changed else "new" for j, w in enumerate(x.split())) for i, x in enumerate(page)]
        assert difference(page, [False] * 12, [copy]) == set()
    assert difference(page, [False] * 12, [page[:-1]]) == set() and difference(page[:-1], [False] * 11, [page]) == set()
    others = [[page[0], *(sentence(r, 40) for _ in range(5))] for _ in range(4)]
    assert difference(page, [True] * 12, others[:2]) == set() and difference(page, [True] * 12, others) == {0}
