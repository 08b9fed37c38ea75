"""HTML extraction on pages written by hand (not by the generator that trains the model), odd markup and large pages."""

import time

import numpy as np
import pytest

from lumenlake.llm import html_text


@pytest.fixture(scope="module")
def model():
    pages = [(html_text.parse(s), k) for s, k in html_text.generate_pages()]
    return html_text.Model(*html_text.fit([p for p, _ in pages], [html_text.generated_labels(p, k) for p, k in pages]))


def text_of(source, model):
    return html_text.extract_texts([source], model)[0]


PAGES = {
    "news": (
        """<!doctype html><html lang=en><head><title>Harbour reopens</title><body><header class=top><a href=/>The Gazette</a></header>
        <nav><ul><li><a href=/w>World</a><li><a href=/s>Sport</a></ul></nav>
        <article><h1>Harbour reopens after storm</h1><p>The harbour was opened again on Monday, two days after the storm.
        <p>Ships that had waited outside came in at <b>noon</b>; the first was a ferry.<aside><p>Subscribe to our letter</p></aside>
        <h2>What is next</h2><p>Repairs go on until spring &amp; will cost &euro;3&nbsp;million.</p></article>
        <footer>&copy; The Gazette. All rights reserved. <a href=/t>Terms</a></footer></body></html>""",
        "Harbour reopens after storm\nThe harbour was opened again on Monday, two days after the storm.\nShips that had waited outside came in at noon; the first was a ferry.\nWhat is next\nRepairs go on until spring & will cost €3 million.",
    ),
    "blog": (
        """<html><body><div id="header"><div class="logo"><a href="/">My blog</a></div></div><div class="menu"><a href="/a">About</a> <a href="/c">Contact</a></div>
        <div class="post-body"><h1>How I mend old clocks</h1><div>Most old clocks stop because of dust, not wear.</div><div>Take the back off first. Then let the spring down with care.</div>
        <ul><li>A small screwdriver</li><li>Clean oil, a few drops</li></ul><div>That is all you need to begin, and it costs little.</div></div>
        <div class="comments"><h3>Comments</h3><div class="comment"><p>Great post, thank you!</p></div><div class="comment"><p>I did the same with mine.</p></div></div>
        <div class="footer">Powered by words</div></body></html>""",
        "How I mend old clocks\nMost old clocks stop because of dust, not wear.\nTake the back off first. Then let the spring down with care.\nA small screwdriver\nClean oil, a few drops\nThat is all you need to begin, and it costs little.",
    ),
    "links in the text": (
        """<body><nav><a href="/">Home</a> <a href="/x">Index</a></nav><main><article><h1>Further reading</h1><p>These three pages explain the matter at more length than we can here.</p>
        <ul><li><a href="/1">The first page</a></li><li><a href="/2">The second page</a></li><li><a href="/3">The third page</a></li></ul><p>Read them in that order, if you can.</p></article></main>
        <form action="/s"><label>Search</label><input name=q><button>Go</button></form></body>""",
        "Further reading\nThese three pages explain the matter at more length than we can here.\nThe first page\nThe second page\nThe third page\nRead them in that order, if you can.",
    ),
    "clutter inside": (
        """<article><h1>Rain in the hills</h1><p>It rained for nine days without an hour's break.</p><div class="advert">Boots at half price! Order now.</div>
        <p>On the tenth day the river was over the road.</p><div class="share"><a href=#>Send</a> <a href=#>Print</a></div><section id="comments"><h3>2 comments</h3><ul><li>We saw it too, it was bad.</li></ul></section></article>""",
        "Rain in the hills\nIt rained for nine days without an hour's break.\nOn the tenth day the river was over the road.",
    ),
    "other elements": (
        """<article><h1>Areas</h1><p>A disc has the area <math><mi>π</mi><mo>r</mo></math> squared, as is well known.</p><pre>area = pi * r * r</pre><dl><dt>Disc</dt><dd>What lies within a circle of a plane.</dd></dl>
        <table><tr><td>radius one</td><td>area 3.14</td></table><object>A drawing of a disc should be here.</object></article>""",
        "Areas\nA disc has the area πr squared, as is well known.\narea = pi * r * r\nDisc\nWhat lies within a circle of a plane.\nradius one\narea 3.14\nA drawing of a disc should be here.",
    ),
    "a section and its comments": (
        """<html><body><header><a href='/'>Site name</a></header><section><h2>On rivers</h2><p>The river rises in the hills. It meets the sea after ninety miles.</p></section>
        <section class='comments'><h3>Comments</h3><div><p>Nice one, thanks!</p></div></section><footer>&copy; 2024 Site</footer></body></html>""",
        "On rivers\nThe river rises in the hills. It meets the sea after ninety miles.",
    ),
    "clutter under unknown names": (
        """<body><nav><a href='/'>Home</a></nav><main><div class='gdpr'><p>We use cookies to improve your visit.</p><button>Accept</button></div><h1>Bread at home</h1>
        <p>Flour, water, salt and time are all that it takes to bake a loaf.</p><aside>Related: <a href='/x'>Ten soups</a></aside><p>Let the dough rest overnight. It will double in size by the morning.</p>
        <div class='disqus'><h3>3 comments</h3><div><b>Ann</b><p>I tried it and it worked well.</p></div><div><b>Bob</b><p>Mine was a bit flat, sadly.</p></div></div></main><footer>Terms</footer></body>""",
        "Bread at home\nFlour, water, salt and time are all that it takes to bake a loaf.\nLet the dough rest overnight. It will double in size by the morning.",
    ),
    "words of notices in the text": (
        """<article><h1>What cookies do</h1><p>Cookies are small files that a site stores on your computer.</p><p>Some of them track you from site to site, which needs your consent.</p></article>""",
        "What cookies do\nCookies are small files that a site stores on your computer.\nSome of them track you from site to site, which needs your consent.",
    ),
    "sections that are built alike": (
        """<body><header><h1>City guide</h1></header><div id='c'><section><h2>Getting there</h2><p>Trains leave the capital every hour. The ride takes two hours.</p></section>
        <section><h2>Where to eat</h2><p>The old market has many stalls. Go early, as they close at two.</p></section></div><div class='legalbar'>All rights reserved.</div></body>""",
        "Getting there\nTrains leave the capital every hour. The ride takes two hours.\nWhere to eat\nThe old market has many stalls. Go early, as they close at two.",
    ),
    "only boxes": (
        """<div class='x1'><div class='q'><div><div>It was late when the train came in at last, and nobody was there.</div><div>She walked home alone through the snow, and slept.</div></div></div></div>""",
        "It was late when the train came in at last, and nobody was there.\nShe walked home alone through the snow, and slept.",
    ),
    "no text": ("<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><footer>&copy; 2024 Site. All rights reserved.</footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_hands(name, model):
    source, want = PAGES[name]
    assert text_of(source, model) == want


ODD = {
    "head left open": ("<head><title>t</title><body><article><h1>A title</h1><p>Some words of the text, as ever.</article>", "A title\nSome words of the text, as ever."),
    "apostrophe in a bare value": ("<article><p title=it's>Some words of the text.<p>It's more of it.</article>", "Some words of the text.\nIt's more of it."),
    "quotation mark left open": ('<article><p title="x>Some words of the text.<p>And more of them.</article>', "Some words of the text.\nAnd more of them."),
    "greater-than in a value": ('<article><p title="a > b">Some words of the text.</article>', "Some words of the text."),
    "inline around blocks": ("<article><b><p>Some words.</b> and the rest of it</p><p>Then more words.</p></article>", "Some words. and the rest of it\nThen more words."),
    "comment left open": ("<article><p>Some words of the text.</p><!-- no <p>more</article>", "Some words of the text."),
    "script with an end tag in a string": ("<article><p>Some words of the text.</p><script>var t='</p>';</script><p>And more of them.</p></article>", "Some words of the text.\nAnd more of them."),
    "signs": ("<article><p>If a < b &lt; c & d &#228;&#xe4; then it is so.</p></article>", "If a < b < c & d ää then it is so."),
    "upper case": ("<ARTICLE><P>Some words of the text.<BR>Then more of it.</P><SCRIPT>x</SCRIPT></ARTICLE>", "Some words of the text. Then more of it."),
    "end tags without a start": ("</div></p><article></section><p>Some words of the text.</p></article></b>", "Some words of the text."),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_markup(name, model):
    source, want = ODD[name]
    assert text_of(source, model) == want


def test_time_and_depth_stay_in_bounds(model):
    began = time.perf_counter()
    for piece in ("<b><p>x ", "<div>", "<a ", '<p a="', "<p a='x\" ", "<!--", "<script>", "</", "<", "<table><td>", "<li><a>", "&"):
        text_of(piece * (400_000 // len(piece)), model)
    assert time.perf_counter() - began < 60  # growth with the square would take hours
    deep = html_text.parse("<div>" * 3_000 + "word" + "</div>" * 3_000 + "<p>after")
    assert deep.depth.max() == html_text.MAX_DEPTH and [t for _, t in deep.blocks] == ["word", "after"]
    many = text_of("<article>" + "".join(f"<p>Line {i} of a very long text, which goes on.</p>" for i in range(30_000)) + "</article>", model)
    assert many.count("\n") == 29_999 and many.endswith("Line 29999 of a very long text, which goes on.")


def test_pages_without_a_likely_block():
    page = html_text.parse("<div>one</div><div>two</div><div>three</div>")
    assert html_text.likeliest(page, np.array([0.1, 0.4, 0.3, 0.1])) == ["one", "two"]
    assert html_text.likeliest(page, np.array([0.1, 0.02, 0.02, 0.01])) == []


def test_generated_pages_not_trained_on(model):
    hit = said = true = 0
    for source, kept in html_text.generate_pages(100, seed=99):
        page = html_text.parse(source)
        y = html_text.generated_labels(page, kept)
        want, got = {t for n, t in page.blocks if y[n]}, set(text_of(source, model).split("\n")) - {""}
        hit, said, true = hit + len(want & got), said + len(got), true + len(want)
    assert hit / said > 0.97 and hit / true > 0.97


def test_labels_of_articles():
    page = html_text.parse('<div><nav>n</nav><article><header>h</header><p>p</p><div class="ad">a</div><footer>f</footer></article></div>')
    kept = html_text.silver_labels(page)
    assert [t for n, t in page.blocks if kept[n]] == ["h", "p"]
    assert html_text.silver_labels(html_text.parse("<div>x</div>")) is None


def test_repeated_pages_train_once(spark):
    text = "One and the same page, again and again."
    page = f"<article><p>{text}</p></article>"
    pages = spark.createDataFrame([(i, "u", page, "x") for i in range(500)] + [(1000, None, None, "x")], "page_id long, url string, html string, n_chars string")
    out = html_text.extract(pages).collect()
    assert len(out) == 501 and {(r["text"], r["n_chars"]) for r in out if r["page_id"] < 1000} == {(text, len(text))}
