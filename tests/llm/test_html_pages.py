"""Main text of pages whose wrappers, names and links are like those of the web."""

import pytest

from verseloom.llm import html_extract
from verseloom.llm.html_extract import extract_text

LONG = "A sentence, with some words and marks, that is long enough. " * 4
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "attribute",
    [
        'class="post overflow-hidden"',
        'style="overflow:hidden"',
        'title="the hidden valley"',
        'class="has-sidebar"',
        "class='content-with-sidebar'",
        "class=no-comments",
        'class="social-science"',
        'id="page-header"',
        'class="widget"',
    ],
)
@pytest.mark.parametrize("inner", ["<article><p>{0}</article>", "<main><p>{0}</main>", "<p>{0}<p>{0}"])
def test_wrapper_keeps_its_article(attribute, inner):
    page = f"<body><nav><a href=/>Home</a></nav><div {attribute}>{inner.format(LONG)}</div><div class=ad>Buy</div></body>"
    assert extract_text(page) == "\n\n".join([TEXT] * inner.count("{0}"))


@pytest.mark.parametrize("attribute", ["hidden", "hidden=''", "style='color:red; display: none'", "aria-hidden=true", "class='comments'", "id=site-footer"])
def test_what_is_hidden_or_named_stays_apart(attribute):
    page = f"<body><article><p>{LONG}</p><div {attribute}><p>{LONG}</p></div></article></body>"
    assert extract_text(page) == TEXT


def test_threshold_drops_boilerplate_without_telling_names():
    page = (
        f"<body><article><h1>Head</h1><p>{LONG}<p>Short one.<ul><li>point<li>other</ul><div><span>Read more</span></div><p>{LONG}"
        f"<div><div>Shop now</div></div><blockquote>{LONG}</blockquote><section>12 min</section></article></body>"
    )
    assert extract_text(page).split("\n\n") == ["Head", TEXT, "Short one.", "point", "other", TEXT, TEXT]


LINKED = "<a href=x>Q&amp;A &lt;about&gt; this</a>"


def test_linked_blocks_stay():
    page = (
        f"<body><article><h1>{LINKED}</h1><p>{LONG}<p>{LINKED}<p><a href=y>\n      indented\n      link\n   </a></p>"
        f"<ol><li><a href=z>Reference &amp; more</a></ol></article></body>"
    )
    assert extract_text(page).split("\n\n") == ["Q&A <about> this", TEXT, "Q&A <about> this", "indented link", "Reference & more"]


def test_links_without_article():
    page = f"<body><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul><h2>{LINKED}</h2><p>{LONG}<p>{LINKED}<p>{LONG}</body>"
    assert extract_text(page).split("\n\n") == ["Q&A <about> this", TEXT, "Q&A <about> this", TEXT]


def test_short_lines_of_an_article_stay():
    for length in (1, 30):
        rows = "".join("<p>" + f"Paragraph {k} tells a long story, with detail; it goes on for a while, and then ends. " * length + "</p>" for k in range(20))
        page = f"<html><body><article><h1>T</h1><div class=lead>Reported from Lima</div>{rows}<section><div>2024 results table follows</div></section></article></body></html>"
        text = html_extract.extract_text(page)
        assert "Reported from Lima" in text and text.endswith("2024 results table follows")


def test_time_grows_with_the_page_not_with_its_nesting():
    import time

    n = 10_000
    for page in ("".join(f"<div>text {k}" for k in range(n)), "<p>x</p>" + "<a " * n, "<div>" * n + "words here." + "</b></div>" * n):
        began = time.process_time()
        html_extract.extract_text(page)
        assert time.process_time() - began < 10  # quadratic work takes minutes


def test_scores_decide_without_telling_names(monkeypatch):
    """With one score for all paths other text comes out of pages without an article or names."""
    story = "".join(f"<p>Part {k} tells a long story, with detail; it goes on for a while, and then it ends.</p>" for k in range(9))
    page = f"<html><body><div><div><div>Menu</div></div><section>{story}</section><div>12 min</div></div></body></html>"
    real = html_extract.extract_text(page)
    monkeypatch.setattr(html_extract, "_scores", lambda found: {b.path: html_extract.Score(1.0, 1.0, 1.0, 1.0) for b in found})
    assert "Part 8" in real and "Menu" not in real and "12 min" not in real and html_extract.extract_text(page) != real


def test_table_of_pages(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, "v", "", "y"), (2, None, "<p>Some words, here.</p>", "z")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(docs).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "Some words, here.", 17)]
    assert html_extract.extract(docs.limit(0)).count() == 0
