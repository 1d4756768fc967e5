"""HTML pages that are broken, nested without end or hold rare elements: read in linear time, with nothing dropped."""
import time

import pytest

from tablescope.llm import htmlextract

SENTENCE = "This is a long sentence of the article that says something. " * 6


def _page(inside: str, head: str = "") -> str:
    return (f'{head}<html><body><nav class="menu"><a href="/">Home</a></nav><article class="content"><h1>Heading here</h1><p>{SENTENCE}</p>{inside}'
            f'<p>{SENTENCE}</p></article><footer class="footer">Copyright</footer></body></html>')


def _text(html: str) -> str:
    return htmlextract.extract([html], *htmlextract.train())[0]


@pytest.mark.parametrize("inside,kept", [
    ("<p>We know that <math><mi>x</mi><mo>=</mo><mn>5</mn></math> holds in all cases.</p>", "We know that x=5 holds in all cases. "),
    ("<noscript><p>A paragraph of the article, long enough to be read.</p></noscript>", "A paragraph of the article, long enough to be read. "),
    ("<object><p>A fallback paragraph, part of the article as any other.</p></object>", "A fallback paragraph, part of the article as any other. "),
    ("<title>", ""), ("<textarea>", ""), ("<template>", ""), ("<p>one</p><!-- ", "one "),
    ("<script>var a = '<p>';</script>", ""), ("<title>closed</title>", ""), ("<!-- closed -->", "")])
def test_an_article_keeps_its_text_around_rare_and_unclosed_elements(inside, kept):
    assert _text(_page(inside)) == f"Heading here {SENTENCE}{kept}{SENTENCE}".strip()


def test_an_unclosed_title_or_comment_in_front_leaves_the_article():
    for head in ("<title>My page", "<!-- begin "):
        assert SENTENCE.strip() in _text(_page("", head))


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "</x>" * 100_000, "<p><table>" + "<div>" * 100_000, "<title>" * 140_000, "<!--" * 250_000,
                                  "<svg>" * 100_000, "<li>x" * 100_000, '<a ">' * 200_000, "<div><p></q2></section>" * 40_000])
def test_a_megabyte_of_broken_markup_is_read_in_linear_time(html):
    htmlextract.train()
    began = time.process_time()
    short = htmlextract.parse(html[:len(html) // 8])
    eighth = time.process_time() - began
    page = htmlextract.parse(html)
    assert time.process_time() - began < max(2.0, 30 * eighth)
    assert len(page.tags) >= len(short.tags)


def test_nodes_deeper_than_the_limit_hang_on_the_ancestor_at_it():
    page = htmlextract.parse("<div>" * 2000 + "deep" + "</div>" * 1990 + "up")
    depth = [0]
    for q in page.parents[1:]:
        depth.append(depth[q] + 1)
    assert max(depth) == htmlextract.MAX_DEPTH and [t for _, t in page.segments] == ["deep", "up"]
    assert page.segments[1][0] == 10                # end tags still close what they opened
