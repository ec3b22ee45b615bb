"""Block rules on made-up pages."""

import time

import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import main_text

LONG = "This is the long text of the article, and it has many of the words that are in a text of that kind."

CASES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("plain words", "plain words"),
    ("<p>a &lt; b &amp;amp; c&nbsp;d\n\t e</p>", "a < b &amp; c d e"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<p>Short<br>line</article><footer>f</footer>", f"T\n{LONG}\nShort line"),
    (f"<header><p>{LONG}</p></header><div><p>{LONG}</p></div>", LONG),
    (f"<article><header><h1>Kept</h1></header><p>{LONG}</p></article>", f"Kept\n{LONG}"),
    (f"<div class='site-header'>{LONG}</div><div>{LONG} x</div>", f"{LONG} x"),
    (f"<div id=cookieNotice>{LONG}</div><p>{LONG} x</p>", f"{LONG} x"),
    (f"<article><p>{LONG}</p><section class=comments><p>{LONG} y</p></section><p>{LONG} x</p></article>", f"{LONG}\n{LONG} x"),
    (f"<div class=ad>{LONG}</div><article><p>tiny</p></article>", "tiny"),
    (f"<p>{LONG}</p><p>short</p><p>{LONG}</p>", f"{LONG}\nshort\n{LONG}"),
    (f"<ul><li><a href=a>one</a><li>two words</ul><p>{LONG}</p>", LONG),
    (f"<script>var x = '<p>{LONG}</p>'</script><style>p{{}}</style><!-- {LONG} --><p>{LONG} x", f"{LONG} x"),
    (f"<form><p>{LONG}</p></form><aside>{LONG}</aside><p>{LONG} x</p>", f"{LONG} x"),
    (f"<article><p><b>bold</b> and <i>slanted</i> text: {LONG}", f"bold and slanted text: {LONG}"),
    ("<p title='a>b'>hello</p>", "hello"),
    ("<div", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_pages(spark):
    schema = "text string, url string, html string, page_id long"
    rows = [("old", f"u{i}", page, i) for i, (page, _) in enumerate(CASES)]
    rows += [rows[5], ("old", None, CASES[5][0], None)]
    out = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == (CASES[r.page_id][1] if r.page_id is not None else CASES[5][1])
    assert not html_text.extract_text(spark.createDataFrame([], schema)).collect()


def test_time_follows_length():
    start = time.process_time()
    for page in ('<p "' * 40_000, "<" * 200_000, "<div>" * 50_000, "<script>" * 20_000, f"<p>{LONG}" * 20_000):
        main_text(page)
    assert time.process_time() - start < 20


PROSE = "This is the story of a long day in which all of us went out to see what the weather would bring to the town."


def test_unclosed_and_wrapping_elements_keep_the_article():
    article = f"<article><p>{PROSE}</p><p>{PROSE}</p></article>"
    want = f"{PROSE}\n{PROSE}"
    for page in (
        f"<html><head><title>T</title><body>{article}</body></html>",
        f"<html><head><title>T</title><script>var a = 1;</script><div>{article}</div></html>",
        f"<html><head><script>document.write('<div>x</div>')</script></head><body>{article}</body></html>",
        f"<body><svg/><svg class='icon' />{article}<svg><text>no</text></svg></body>",
        f"<body><div class='has-sidebar'>{article}</div></body>",
        f"<body><form action='/'><input name='q'>{article}</form></body>",
    ):
        assert main_text(page) == want, page
    # comments stay out, in articles of their own too, as does what a menu holds
    page = f"<body>{article}<div class='comments'><article><p>{PROSE} Says a reader.</p></article></div></body>"
    assert main_text(page) == want
    assert main_text(f"<body><nav><article><p>{PROSE}</p></article></nav></body>") == ""
