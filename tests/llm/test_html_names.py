"""Names in class and id that say nothing against an article, and those that do."""

import pytest

from phmspark.llm.html_text import main_text

WORDS = " ".join(f"word{k}" for k in range(60))
NAV = "<nav><a href='/'>home</a></nav><div class='sidebar'><a href='/x'>one</a> <a href='/y'>two</a></div>"


@pytest.mark.parametrize(
    "around",
    [
        "<article class='post has-sidebar'>{}</article>",
        "<div id='page' class='no-sidebar'><div>{}</div></div>",
        "<main class='related'>{}</main>",
        "<div class='layout sidebar-right'><div class='text'>{}</div></div>",
        "<section id='menu-planning'>{}</section>",
    ],
)
def test_names_do_not_drop_an_article(around):
    inner = f"<h2 id='social-media'>Heading one</h2><p>{WORDS}</p><h3 id='notice-period'>Heading two</h3><p>{WORDS}</p>"
    got = main_text(f"<html><body>{NAV}{around.format(inner)}<footer>end</footer></body></html>")
    assert got == f"Heading one\n{WORDS}\nHeading two\n{WORDS}"


def test_names_still_drop_boilerplate():
    comments = f"<div class='comments'><p>{WORDS} said</p><p>{WORDS} again</p></div>"
    got = main_text(f"<body>{NAV}<div><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p><div class='share'>{WORDS}</div></div>{comments}</body>")
    assert got == "\n".join([WORDS] * 3)


def test_formulas_stay():
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x=1</annotation></math>"
    assert main_text(f"<body><article><p>{WORDS} {formula} end</p><p>{WORDS}</p></article></body>") == f"{WORDS} x=1 end\n{WORDS}"


COMMENTS = "".join(f"<p>{WORDS} said {k}</p>" for k in range(3))
CARDS = "".join(f"<div><a href='/{k}'>Card {k}</a><p>{WORDS} card {k}</p></div>" for k in range(12))
TWO = f"<p>{WORDS}</p><p>{WORDS} more</p>"


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<article><p>Short piece here.</p></article><div class='comments'>{COMMENTS}</div>", "Short piece here."),
        (f"<article><p>Short piece here.</p></article><div class='cookie-consent'>{COMMENTS}</div>", "Short piece here."),
        (f"<article><p>Short piece here.</p></article><div class='legal'>{COMMENTS}</div>", "Short piece here."),
        (f"<article>{TWO}</article><div class='related'>{CARDS}</div>", f"{WORDS}\n{WORDS} more"),
        (f"<article>{TWO}</article><section><h2>Comments</h2>{COMMENTS}</section>", f"{WORDS}\n{WORDS} more"),
        (f"<article>{TWO}<section><h2>Comments (3)</h2>{COMMENTS}</section></article>", f"{WORDS}\n{WORDS} more"),
        (f"<main><article>{TWO}</article><div>{CARDS}</div></main>", f"{WORDS}\n{WORDS} more"),
        (f"<main>{TWO}<div class='share'>{COMMENTS}</div></main>", f"{WORDS}\n{WORDS} more"),
        (f"<article>{TWO}</article><article>Teaser of another page</article>", f"{WORDS}\n{WORDS} more"),
        (f"<div class='story'>{TWO}</div><div class='related'>{CARDS}</div>", f"{WORDS}\n{WORDS} more"),
        (f"<div class='story'>{TWO}</div><section><h3>Related articles</h3>{CARDS}</section>", f"{WORDS}\n{WORDS} more"),
        (f"<h1>Title</h1><article>{TWO}</article><h2>Other pages</h2>{CARDS}", f"Title\n{WORDS}\n{WORDS} more"),
        (f"<div class='widget'><article>{TWO}</article></div>", f"{WORDS}\n{WORDS} more"),
        (f"<div class='comments'><article>{COMMENTS}</article></div><div class='story'>{TWO}</div>", f"{WORDS}\n{WORDS} more"),
        ("<article></article><div><p>all there is on the page</p></div>", "all there is on the page"),
    ],
)
def test_what_stands_beside_an_article_stays_out(html, want):
    assert main_text(f"<html><body>{NAV}{html}<footer>end</footer></body></html>") == want


def test_articles_of_the_given_pages():
    """On every page of the smallest table the text is that of its one article element, block by block."""
    import html as entities
    import re

    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    block = r"</?(?:p|h[1-6]|ul|ol|li|div|article|section|blockquote|pre|table|tr|td|th|figure|figcaption|dl|dt|dd|hr)\b[^>]*>"
    for row in rows:
        (inner,) = re.findall(r"<article.*?</article>", row["html"], re.S)
        inner = re.sub(r"<!--.*?-->|<(script|style|aside|nav|form|button|noscript)\b.*?</\1>", "", inner, flags=re.S)
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in re.split(block, inner)]
        assert main_text(row["html"]) == "\n".join(x for x in parts if x), row["page_id"]
