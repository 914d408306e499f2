import html
import re

import pytest

from tests.conftest import DATA
from tidemark.llm import html_text

LONG = "This is a paragraph of plain running text that goes on for a good many words, as those of articles do, and holds no link at all."


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train_tree(spark)


def article(page: str) -> str:
    """The given pages' main text, told by their one article element."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_all_given_pages(spark, tree):
    pages = spark.read.parquet(f"{DATA}/sf0.1/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_text.extract_text(pages, tree).collect()
    assert len(got) == len(want) == 2500
    assert [r.page_id for r in got if r.text != want[r.page_id] or r.n_chars != len(r.text)] == []


def test_the_tree_has_learnt_its_table(tree):
    rows = html_text.labelled_blocks()
    assert len(rows) < 200 and all(html_text.is_main(tree, r[:-1]) == bool(r[-1]) for r in rows)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<!-- never closed", ""),
        ("<html><head><title>x</title><p>" + LONG, LONG),  # the head's end is left out
        (f"<article><header><h1>Title here</h1></header><p>{LONG}<aside><div class='content'>{LONG}</div></aside><p>a < b &amp;amp; c&nbsp;d &amp<div id=comments><article>{LONG}</article></div><footer>{LONG}</footer></article tail", f"Title here\n{LONG}\na < b &amp; c d &"),
        (f'<nav><ul><li><a href="/">Home</a><article class=post><p title="a>b">wor<b>ds</b> on<br>here<script>var a = "</p><p>no";</script></p></article>', "words on here"),  # an unclosed menu
        (f"<div class='cookie-notice'>{LONG}</div><main><h2>Two words</h2><ul><li>one<li>two</ul><form><p>{LONG}</p></form><table><tr><td>cell</td><td>more</td></tr></table></main><div class='siteFooter'>{LONG}</div>", "Two words\none\ntwo\ncell\nmore"),
        (f"<div><a href=/1>One</a> <a href=/2>Two</a></div><div class=x><h1>What the page is all about</h1><p>{LONG}</p><p>{LONG} <a href=/3>And so on</a>.</p></div><ul><li><a href=/4>Next one</a><li><a href=/5>Another one</a></ul>", f"What the page is all about\n{LONG}\n{LONG} And so on."),  # nothing is named
        (f"<body class='has-sidebar'><div class='content'><p>{LONG}</p><p hidden>gone</p><div style='display: none'>gone</div></div><div class='sidebar'><div class='content'>{LONG}</div></div>", LONG),
        (f"<article><p>{LONG}</p><p>cut <a href='x", f"{LONG}\ncut"),
        (f"<article><p>{LONG}</p><style>p{{}}</article><p>the style was not closed", LONG),
        (f"<div class='page-header'>{LONG}</div><article><div class='entry-header'><h1>Head</h1><p class='byline'>By me</p></div><p>{LONG}</p><div class='ad-slot'>{LONG}</div><div class='share-buttons'>Share</div></article><div class='copyright'>{LONG}</div>", f"Head\nBy me\n{LONG}"),
        (f"<ARTICLE><P CLASS=lead>{LONG}</P><TEXTAREA><p>{LONG}</TEXTAREA></ARTICLE>", LONG),
    ],
)
def test_pages_built_otherwise(tree, page, want):
    assert html_text.main_text(page, tree) == want


def test_odd_rows(spark, tree):
    rows = [(1, "u", None, "a"), (2, None, f"<article><p>{LONG}", None), (2, None, f"<article><p>{LONG}", None), (None, "v", "", "b"), (3, "w", "<article>" + f"<p>{LONG} " * 20_000, "c"), (4, "x", "<" * 100_000 + '<a "' * 20_000, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = html_text.extract_text(pages, tree)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id, r.url, r.text) for r in got.collect()), key=str)
    assert [r[:2] for r in found] == sorted([r[:2] for r in rows], key=str)
    texts = {r[0]: r[2] for r in found}
    assert texts[1] == "" and texts[None] == "" and texts[2] == LONG and texts[3] == "\n".join([LONG] * 20_000)
    assert html_text.extract_text(pages.limit(0), tree).count() == 0
