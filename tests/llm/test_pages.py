"""Main text of pages: exact marginals, layouts with names that training never saw, and pages written by hand."""

import math

import numpy as np
import pytest

from fluvia.llm import page_graph, page_layouts

#: Names that the training layouts do not use.
OTHER_NAMES = {
    "menu": ("mainnav", "hauptmenue", "primary-links", "siteMenu"),
    "banner": ("page-head", "kopf", "brandbar"),
    "advert": ("sponsor-slot", "ad-unit", "werbung"),
    "notice": ("gdpr-banner", "cookiebar", "overlay"),
    "side": ("rail", "right-column", "sideBarWidget", "aside-box"),
    "form": ("searchForm", "mail-form"),
    "comments": ("commentlist", "reader-comments", "feedback-thread"),
    "comment": ("commentItem", "kommentar"),
    "share": ("sharing-bar", "taglist", "authorline"),
    "foot": ("page-footer", "fuss", "imprint"),
    "article": ("articleText", "post-text", "copy"),
    "wrapper": ("outer", "canvas", "shell"),
    "plain": ("cf", "span8", "unit"),
}


@pytest.fixture(scope="module")
def model():
    return page_graph.trained()


def judged(model, page):
    nodes = page_graph.parse(page)
    forest = page_graph.Forest([nodes])
    unary = model.unaries(page_graph.features(forest))
    return nodes, unary, model.marginals(forest, unary)[0]


def brute_marginals(model, nodes, unary):
    n = len(nodes)
    total, one = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        s = sum(unary[i] * y[i] for i in range(n))
        s += sum(model.pairs[page_graph.kind(nodes[i].tag), y[nodes[i].parent], y[i]] for i in range(1, n))
        total += math.exp(s)
        one += math.exp(s) * np.array(y)
    return one / total


def test_marginals_are_exact(model):
    nodes, unary, found = judged(model, '<nav><a href="/">x</a></nav><article class=post><h1>T</h1><p>Some <b>bold</b> text</article><footer>c')
    assert np.allclose(found, brute_marginals(model, nodes, unary))


def test_pages_together_are_pages_alone(model):
    pages = [None, *page_layouts.labelled_pages(25, 11), "", "<p>x"]
    assert list(page_graph.extract_all(pages, model)) == [page_graph.extract(p, model) for p in pages]
    assert list(page_graph.extract_all(pages, model, most=50)) == [page_graph.extract(p, model) for p in pages]


@pytest.mark.parametrize(("names", "least"), [(page_layouts.NAMES, 0.99), (OTHER_NAMES, 0.98), (dict.fromkeys(page_layouts.NAMES, ("qx",)), 0.97)])
def test_held_out_layouts(model, names, least):
    """With the names of training, with others, and with the same one everywhere, which leaves structure alone."""
    right = n = 0
    for page in page_layouts.labelled_pages(80, 4711, names):
        nodes, _, p = judged(model, page)
        for node, a, b in zip(nodes, page_graph.labels(nodes), p, strict=True):
            if not node.tag:
                n, right = n + 1, right + ((b >= 0.5) == a)
    assert right / n > least


BLOG = (
    '<html><body class="home with-sidebar single"><header class="site-header"><a href="/">My Blog</a><nav><ul><li><a href="/a">Home</a></li>'
    '<li><a href="/b">About</a></li></ul></nav></header><article id="post-12" class="post-12 post type-post status-publish hentry category-news '
    'tag-spark author-jane"><header class="entry-header"><h1 class="entry-title">Spark at scale</h1></header><div class="entry-content"><p>First '
    "paragraph of a real article, with some words in it.</p><p>Second paragraph, which says a bit more about it.</p></div></article><aside "
    'class="widget-area"><h3>Recent</h3><ul><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul></aside><footer class="site-footer">'
    "Copyright me</footer></body></html>"
)
FORMED = (
    '<html><head><title>t</title></head><body><form method="post" action="./page.aspx" id="aspnetForm"><div class="aspNetHidden"><input '
    'type="hidden" name="__VIEWSTATE" value="x"></div><div id="nav"><a href="/">Home</a> <a href="/p">Products</a></div><div id="main"><h1>Annual '
    "report</h1><p>The company did well this year, as the figures show.</p><p>Next year should be better, says the board.</p></div><div "
    'id="footer">All rights reserved</div></form></body></html>'
)
LINKED = (
    "<article><h1>Reading list</h1><p>These are the books that I read this year:</p><ul><li><a href='/1'>The first book of the year</a></li><li>"
    "<a href='/2'>The second book, which was better</a></li><li><a href='/3'>A third book</a></li><li><a href='/4'>A fourth one</a></li><li>"
    "<a href='/5'>The fifth</a></li><li><a href='/6'>And the last</a></li></ul><p>That was all for this year.</p></article>"
)
READERS = (
    '<body><div id="page"><div id="comments-link"><a href="#c">3 comments</a></div><div class="post-body author-box-off"><h2>My trip</h2><p>We '
    "left in the morning, when it was still dark.</p><p>By noon we were there, tired but happy.</p></div><div id='comments'><h3>3 comments</h3>"
    '<div class="comment"><p>Nice one, thanks for sharing!</p></div><div class="comment"><p>I was there last year.</p></div></div></div></body>'
)
STATES = (
    '<body class="sidebar-right comments-open"><main class="content-with-sidebar"><article class="article has-advert"><h1>News of the day</h1>'
    '<div class="ad">Buy now</div><p>Something happened today in the city, officials said.</p><p>Nobody was hurt.</p></article></main></body>'
)
UNCLOSED = (
    "<article><h1>Maths</h1><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is simple.</p><p hidden>secret<p>After the hidden one "
    "comes text.</p><noscript><p>Still here at the end of it all.</p></article>"
)
TINY = "<nav><ul><li><a href='/a'>Du</a></li><li><a href='/b'>wo</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>A note.</h1><p><b>A note.<br></article><footer>&copy; x.example.com &middot; Some longer words of the owner stand here, for years.</footer>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<html><body></body></html>", ""),
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three</p><p>in<b>lin</b>e <i>x</i></p></article><footer>&copy; z</footer>", "A & B one two three inline x"),
        ("<nav><ul><li><a href=/>menu</a></li></ul></nav><article><h1>T</h1><p><b>open<br><p>next</article>", "T open next"),
        ('<article><h1>T</h1><p>Body text here.</p><div class="comments"><p>a reader says</p></div></article>', "T Body text here."),
        ('<script>var t="</p>";</script><article><!-- <p>no</p> --><p>yes &lt;b&gt; "a<5" end</article', 'yes <b> "a<5" end'),
        ("<p>one<xmp><b>raw &amp; text</b></xmp><p>two", "one <b>raw &amp; text</b> two"),
        ("<p>one <textarea>form</textarea>two<svg><title>picture</title></svg> three<script>lost", "one two three"),
        (BLOG, "Spark at scale First paragraph of a real article, with some words in it. Second paragraph, which says a bit more about it."),
        (FORMED, "Annual report The company did well this year, as the figures show. Next year should be better, says the board."),
        (
            LINKED,
            "Reading list These are the books that I read this year: The first book of the year The second book, which was better A third book "
            "A fourth one The fifth And the last That was all for this year.",
        ),
        (READERS, "My trip We left in the morning, when it was still dark. By noon we were there, tired but happy."),
        (STATES, "News of the day Something happened today in the city, officials said. Nobody was hurt."),
        (UNCLOSED, "Maths The formula x=2 is simple. After the hidden one comes text. Still here at the end of it all."),
        (TINY, "A note. A note."),
        ("<li hidden>no<li>yes, this one is seen.", "yes, this one is seen."),
        ("<body style='display:none'><p>Shown by a script later on.</p></body>", "Shown by a script later on."),
    ],
)
def test_pages(model, page, text):
    assert page_graph.extract(page, model) == text


def test_given_pages(spark, sf, model):
    """All pages of the given table have one plain layout: their article element is the text."""
    import html
    import re

    def article(page):
        inside = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", page, re.S).group(1), flags=re.S)
        return " ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", re.sub(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", " ", inside))).split())

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for row in page_graph.main_text(pages, model).collect():
        assert row["text"] == article(row["html"])


def test_pages_on_spark(spark, model):
    pages = spark.createDataFrame([(1, "<article><p>x y</p></article>", "u"), (2, None, None), (2, None, None)], "page_id long, html string, n_chars string")
    assert sorted((r["page_id"], r["text"]) for r in page_graph.main_text(pages, model).collect()) == [(1, "x y"), (2, ""), (2, "")]
    assert page_graph.main_text(pages.limit(0), model).count() == 0
    named = pages.withColumnsRenamed({"n_chars": "text"})
    assert page_graph.main_text(named, model).columns == ["page_id", "html", "text"]


def test_long_and_deep_pages(model):
    assert page_graph.extract("<div>" * 3000 + "deep" + "<p" * 2000, model) == "deep"
    assert page_graph.extract("<b>" * 20_000 + "deep", model) == "deep"
    assert page_graph.extract("<noscript>" * 20_000 + "<p>end of the page", model) == "end of the page"
    paragraphs = [f"This is sentence number {i}, one of many." for i in range(200_000)]
    page = "<article><h1>Long</h1><p>" + "<p>".join(paragraphs) + "</article>"
    assert len(page) > 8_000_000
    assert page_graph.extract(page, model) == " ".join(["Long", *paragraphs])
