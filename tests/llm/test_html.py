import time

import pytest

from tracewright.llm import html

TREE = html.train()
LONG = "word " * 40


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>Head</h1><p>One &amp; <b>t</b>wo&nbsp;x<br>y</p><p>Be.</p></article>", "Head One & two x y Be."),
        ("<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></ul></nav><article><p>Text here</p></article><footer>&copy; x.example</footer>", "Text here"),
        ('<div class="ad">Buy it now.</div><article><p>Text</p><div class="advert">More of it</div><p>End', "Text End"),
        ('<script>var t="</p><p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><article><p>Yes</p></article>', "Yes"),
        ('<article><p>Kept text</p></article><section id="comments"><article class="comment"><p>' + LONG + "</p></article></section>", "Kept text"),
        (f"<div><h2>Head over text</h2><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href=1>a</a><li><a href=2>b</a></ul>", f"Head over text {LONG}{LONG}".strip()),
        ("<article><form><p>Name</p></form><aside>Side</aside><p>a &lt;b&gt; 1 &lt 2 &#233;</p><a hre", "a <b> 1 < 2 é"),
        ("<nav><a href=x>Menu</a></nav>", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, TREE) == text


WORDS = "Water flows from the hills to the sea and many people live along its banks in small towns."


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ('<div class="form-of-government"><h2>State</h2><p>{0}</p></div>', "State {0}"),
        ('<div class="related-work"><p>{0}</p></div>', "{0}"),
        ('<section id="social-structure"><p>{0}</p></section>', "{0}"),
        ('<h2 id="search-algorithms">Search</h2><p>{0}</p>', "Search {0}"),
        ('<p id="comments">{0}</p>', "{0}"),
        ("<p>{0}</p><svg width=1 /><p>{0}</p>", "{0} {0}"),
        ("<p>{0}</p><svg><text>no</text></svg><p>{0}</p>", "{0} {0}"),
        ("<p>{0} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "{0} x=2 holds"),
        ("<object><p>{0}</p></object>", "{0}"),
        ("<p>{0} <button>press</button> it</p>", "{0} press it"),
        ('<p>foo<span class="share">bar</span> {0}</p>', "foobar {0}"),
        ('<div class="ad-slot"><p>{0}</p></div><p>{0}</p><div class="siteFooter">{0}</div><div class="cookie-notice site">{0}</div>', "{0}"),
    ],
)
def test_articles_lose_nothing_to_their_names(inside, text):
    page = f"<nav><a href=a>Home</a></nav><article><h1>Head</h1><p>{WORDS}</p>{inside.format(WORDS)}<p>{WORDS}</p></article><footer>2020</footer>"
    assert html.main_text(page, TREE) == f"Head {WORDS} {text.format(WORDS)} {WORDS}"


def test_blocks_carry_words_and_link_density():
    found = html.blocks("<p>one <a href=x>two three</a></p><div class=menu><p>x</p></div><article>y</article>")
    assert [(b.words, b.linked, b.furniture, b.article) for b in found] == [(3, 2, False, False), (1, 0, True, False), (1, 0, False, True)]
    assert html.features(found)[1].tolist() == [1, 0, 3, 2 / 3, 1, 0, 1, 0]


def test_tree_fits_its_table():
    import numpy as np

    table = np.array(html.LABELLED)
    assert ((TREE.predict(table[:, :-1]) > 0.5) == table[:, -1]).mean() > 0.95


def test_broken_pages_take_time_in_proportion():
    start = time.perf_counter()
    for unit in ("<div", "<div>", "<script>", "<a href='", "<!--", "</div>", '<p class="', "<b>x", "&amp", "<"):
        html.main_text(unit * 50_000, TREE)
    assert time.perf_counter() - start < 20


def test_rows(spark):
    rows = [(1, "u", "<article><p>é x</p></article>"), (1, "u", "<article><p>é x</p></article>"), (2, None, None), (None, "v", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    found = sorted(html.extract(pages).collect(), key=str)
    assert [tuple(r) for r in found] == sorted([(1, "u", "é x", 3), (1, "u", "é x", 3), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html.extract(pages.limit(0)).count() == 0
