import pytest

from relspark.llm import html_text

LABELLED = '<html><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy this thing now</div><article><h1>Title</h1><p>Some words here.</p><p>More words of text.</p></article><footer>&copy; foot words</footer></body></html>'
WEIGHTS = html_text.learn(html_text.count_contexts(LABELLED))


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<!-- open", ""), ("<script>var a='</p>';", ""), ("<p>one<br>two</p><p>three", "one two three"),
    ("<div><b>bo</b>ld&nbsp; x\n\ty</div>", "bold x y"), ("<p>a &lt;b&gt; &#233;&eacute; &am &amp", "a <b> éé &am &"), (LABELLED, "Title Some words here. More words of text."),
    ("<main><h1>T</h1><p>First one.</p><aside>Side words</aside><form><label>Name</label><button>Go</button></form><p>Second one.</p></main><section class=comments><p>Reader comment text.</p></section>", "T First one. Second one."),
    ('<header><p>Site</p></header><div id="cookie-notice">We use cookies</div><div class=story><h2>H</h2><p>Body text here.</p></div>', "H Body text here."),
    ("<p title='a>b'>quoted</p>", "quoted"), ("</p></div>stray", "stray"), ("<style>p{}</style><title>no</title><p>yes</p>", "yes"), ("<article class='comment'><p>mine</p></article><p>text</p>", "text"),
    ("<nav>only <p>menus</p></nav>", ""),
])
def test_pages(page, text):
    assert html_text.main_text(page, WEIGHTS) == text


def test_best_region_equals_all_runs():
    import random

    r = random.Random(4)
    for _ in range(300):
        s = [r.randint(-4, 4) for _ in range(r.randint(0, 12))]
        a, b = html_text.best_region(s)
        sums = [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)]
        assert sum(s[a:b]) == max([0, *sums])


def test_table(spark):
    rows = [(1, "u", LABELLED), (1, "u", LABELLED), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 50_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "'y' n_chars", "'z' key")
    got = html_text.extract(pages, html_text.fit(pages)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.n_chars for r in got if r.page_id == 3} == {5 * 50_000 - 1}
    nothing = pages.where("page_id = 77")
    assert html_text.extract(nothing, html_text.fit(nothing)).count() == 0


@pytest.mark.parametrize("page,text", [
    ('<article><h2 id="related-work">Related work</h2><p>Some words.</p><section id="search-methods"><h3>Search</h3><p>Of methods.</p></section></article>', "Related work Some words. Search Of methods."),
    ('<article id="popular-science"><p>All of it.</p></article>', "All of it."), ('<main class="header-fixed"><p>All of it.</p></main>', "All of it."),
    ('<article><p>One.</p><p class="side-note">A note.</p><ul><li id="legal-search">A point of some more words than its tags cost.</li></ul></article>', "One. A note. A point of some more words than its tags cost."),
    ('<div role="main" id="search-results"><p>All of it.</p></div>', "All of it."), ('<section id="social-history"><p>No article here.</p></section>', "No article here."),
    ('<article><p>One, which has enough words of its own.</p><section class="comments"><p>Reader words.</p></section><div class="share-bar">Share it</div><p>Two, with some more words than all the tags before it cost.</p></article>', "One, which has enough words of its own. Two, with some more words than all the tags before it cost."),
])
def test_names_made_of_headings_are_no_furniture(page, text):
    assert html_text.main_text(page, WEIGHTS) == text


ARTICLE = "<article><h1>Head</h1><p>Words before it, more than the tags cost.</p>{}<p>Words after it, more than the tags cost as well.</p></article>"
AROUND = "Head Words before it, more than the tags cost.{} Words after it, more than the tags cost as well."


@pytest.mark.parametrize("inner,text", [
    ('<svg class="i"/>', ""), ("<svg viewBox='0 0 1 1'><title>icon</title><text>x</text></svg>", ""), ('<p>One <svg class="i" /> two.</p>', " One two."),
    ('<table class="side-effects"><tr><td>Nausea and other effects</td></tr></table>', " Nausea and other effects"),
    ('<p>It is <em class="notice">very important</em> to say.</p>', " It is very important to say."),
    ('<p>Where <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds.</p>', " Where a=2 holds."), ('<div class="side-story"><p>A story of its own.</p></div>', " A story of its own."),
    ('<div class="ad-slot">Buy it</div>', ""), ('<section class="user comments"><p>First!</p></section>', ""), ('<ul class="related-posts"><li>Other</li></ul>', ""),
    ('<div class="newsletter box">Sign up</div>', ""), ("<footer>Filed under things</footer>", ""),
])
def test_names_inside_an_article(inner, text):
    assert html_text.main_text(ARTICLE.format(inner), WEIGHTS) == AROUND.format(text)


def test_an_articles_header_keeps_its_headline():
    page = "<header><p>Site name</p></header><article><header><h1>Headline</h1></header><p>Some words here.</p></article>"
    assert html_text.main_text(page, WEIGHTS) == "Headline Some words here."


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BATCH_BYTES", 100)
    pages = spark.createDataFrame([(i, "u", f"<p>{'word ' * 30}{i}</p>" if i % 7 else None) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, WEIGHTS).collect()}
    assert got == {i: f"{'word ' * 30}{i}" if i % 7 else "" for i in range(40)}
