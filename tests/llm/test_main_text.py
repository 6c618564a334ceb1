"""Main text of pages against regular expressions on the given layout, and against written-down articles on others."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import main_text, plans
from folioscope.llm.markup import Page

SMALL = "/root/testdata/sf0.001"

FIRST = "The harbour was quiet that morning, and nobody saw the boat leave. It had been painted twice, once in green."
SECOND = "Later, people said that they had heard an engine; others spoke of oars, voices and a dog."
THIRD = "In the end the boat was found, empty, forty miles down the coast."
NAV = '<ul class="links"><li><a href="/">Home</a></li><li><a href="/news">News and views</a></li><li><a href="/about">About us</a></li></ul>'
REMARK = "I was there, and I can tell you that it was not quiet at all, not in the least. What a story, thank you for it!"
STORY = f"<p>{FIRST}</p><p>{SECOND}</p><p>Short.</p><p>{THIRD}</p>"
TEXT = [FIRST, SECOND, "Short.", THIRD]


def text_of(page):
    return [b.text for b in main_text.main_blocks(page)]


def test_query(spark):
    """The given layout: the article holds a heading and paragraphs, not all of them closed."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = plans.op12_html_text(spark, SMALL).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", p))).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><nav>{NAV}</nav><main><article><h1>A boat</h1>{STORY}</article><aside><p>{REMARK}</p></aside></main><footer>&copy; us, all rights reserved.</footer></body>", ["A boat", *TEXT]),
        (f"<header><h1>The Daily</h1><p>{REMARK}</p></header><article><header><h1>A boat</h1></header>{STORY}</article>", ["A boat", *TEXT]),
        (f'<article>{STORY}<section id="comments"><h2>Comments</h2><p>{REMARK}</p><p>{REMARK}</p></section></article>', TEXT),
        (f'<article class="post has-sidebar">{STORY}</article><div class="commentList"><article><p>{REMARK}</p></article></div>', TEXT),
        (f'<div id="top-nav">{NAV}</div><div class="content"><h2>A boat</h2>{STORY}<ul><li>Oars</li><li>A dog</li></ul></div><div class="sidebar-right"><p>{REMARK}</p></div>', ["A boat", *TEXT, "Oars", "A dog"]),
        (f"<body>{NAV}<h1>A boat</h1>{STORY}<hr><p class=x><a href=/>Home</a> <a href=/n>News</a></p><div>Small print</div></body>", ["A boat", *TEXT]),
        (f"<body><div>{NAV}</div><table><tr><td>{NAV}<td>{STORY}</table></body>", TEXT),
        (f'<form action="/"><main>{STORY}<form><input name=q><button>Find it, whatever it is.</button></form></main></form>', TEXT),
        (f'<div class="cookie-notice"><p>We use cookies, like everyone. {REMARK}</p></div><div role="alert">{REMARK}</div><div><div>{STORY}</div></div><div hidden>{REMARK}</div>', TEXT),
        (f'<nav>{NAV}<article><h3>A boat<p>{FIRST}<p>{SECOND}<ul><li>Oars<li>A <a href="#">dog</a></ul><blockquote>{THIRD}</blockquote></article>', ["A boat", FIRST, SECOND, "Oars", "A dog", THIRD]),
        (f"<ARTICLE><P>{FIRST}</P><SCRIPT>var a = '<p>no</p>';</SCRIPT><STYLE>p{{}}</STYLE><!-- <p>no</p> --><NOSCRIPT><p>no</p></NOSCRIPT><P>{SECOND}</P></ARTICLE>", [FIRST, SECOND]),
        (f'<div class="ad">{REMARK}</div><article><p>Yes.</p></article><footer>{REMARK}</footer>', ["Yes."]),
        (f"<article><p title='a > b' data-x=\"<p>\">{FIRST}</p>text between<div>{SECOND}</div></article>", [FIRST, "text between", SECOND]),
        ("<article><p>a&nbsp;&lt;b&gt; &amp; c&#8217;s &#x4e2d; &unknown; x < y</p></article>", ["a <b> & c’s 中 &unknown; x < y"]),
        ("<article><p>one<b>two</b> <i>three</i><br>four\n\n\tfive</p></article>", ["onetwo three four five"]),
        ("<article><p>left open <a href='/x", ["left open"]),
        ("plain words, without markup", ["plain words, without markup"]),
        (f"<nav>{NAV}</nav><script>1", []),
        ("<p> \n </p><div></div>", []),
    ],
)
def test_layouts(page, want):
    assert text_of(page) == want


def test_scores_of_paths():
    blocks = Page(f"<body><div>{NAV}</div>{STORY}</body>").blocks
    scores, links, every = main_text.path_scores(blocks)
    item, paragraph = blocks[0].element.path, blocks[-1].element.path
    assert len(every) == 7 and len(scores) == 2 and links[item] == pytest.approx(1, abs=0.2) and links[paragraph] == 0
    assert scores[paragraph] > 10 * scores[item]
    assert main_text.smoothed(main_text.np.array([0.0, 4.0, 0.0])).tolist() == [1.0, 2.0, 1.0]
    assert main_text.smoothed(main_text.np.array([3.0])).tolist() == [3.0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<li>", "<table>", "<td>", "</table>", "<a href='/'>", "</a>", "<b>", "<", ">", '"', "&amp;", "word ", "x.", "<!--", "-->", "<script>", "</script>", "<title", "<h1>"]), max_size=30))
def test_any_soup_is_read(parts):
    for block in Page("".join(parts)).blocks:
        assert block.text == " ".join(block.text.split()) != ""
    text_of("".join(parts))


def test_odd_rows(spark):
    long = f"<article>{'<p>' + FIRST + '</p>'}{'<p>word</p>' * 50000}</article>"
    pages = [(1, None), (2, ""), (3, f"<article>{STORY}</article>"), (3, f"<article>{STORY}</article>"), (4, long), (None, "<article>x</article>"), (5, "<div>" * 20000 + "deep" + "</div>" * 20000), (6, "<article>" + "<div>x" * 20000)]
    df = spark.createDataFrame([(i, h, 7, ["p"]) for i, h in pages], "page_id long, html string, n_chars int, row array<string>")
    got = main_text.extract_main(df).collect()
    assert [r["row"]["page_id"] for r in got] == [i for i, _ in pages] and {r["row"]["n_chars"] for r in got} == {7}
    assert [r["text"] for r in got[:4]] == ["", "", "\n\n".join(TEXT), "\n\n".join(TEXT)]
    assert got[4]["text"] == "\n\n".join([FIRST] + ["word"] * 50000) and got[4]["n_chars"] == len(got[4]["text"]) and got[4]["n_blocks"] == 50001
    assert got[5]["text"] == "x" and got[6]["text"] == "deep" and got[7]["n_blocks"] == 20000
    assert main_text.extract_main(df.limit(0)).count() == 0
