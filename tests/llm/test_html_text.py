import html
import re
import time

import pytest
from tessera.llm import html_text, queries

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice"><p>We use cookies, sorry, really.</p></div>
<div id="page"><div class="content"><h2>Title &amp; more</h2><p>One, two,&nbsp;three <a href=x>link</a>.<p>Four,
 five<br>six.</p><script>if (a<b) "</p>"</script><ul><li>item, one<li>item two</ul><table><tr><td>c1<td>c2</tr></table>
<form><p>Sign up, now</p></form><div class=ad>Buy, buy</div></div>
<aside><p>Side, bar, text</p></aside><section class="comments"><p>Nice, I like it, a lot, yes, indeed, so good.</p></section></div>
<footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Title & more\n\nOne, two, three link.\n\nFour, five six.\n\nitem, one\n\nitem two\n\nc1\n\nc2"),
        ("", ""),
        (None, ""),
        ("plain, text", "plain, text"),
        ("<p>a, b<p>c <!-- d --> e", "a, b\n\nc e"),
        ("<nav><p>only, menu</p></nav>", ""),
        ("<article><p><b>bold<br><p>next</p></article><footer>f</footer>", "bold\n\nnext"),
        ("<div><p>1 &lt; 2, &#233;</p></div><div class='sidebar'><p>x, y</p></div>", "1 < 2, é"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("names", ["content has-sidebar", "layout sidebar-right content", "entry no-comments", "post type-post category-social tag-search", "content sidebar"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_keep_the_article(names, tag):
    page = f"<body><ul class='nav'><li><a href=/>Home</a></ul><div class='{names}'><{tag}><p>One, two, three.</p><p>Four, five.</p></{tag}><div class='cookie-notice'><p>Yes, cookies.</p></div></div><div class='site-links widget'><p>Buy, now.</p></div></body>"
    assert html_text.main_text(page) == "One, two, three.\n\nFour, five."


def test_long_comments_beside_a_short_article_go():
    assert html_text.main_text("<article><p>One, two.</p></article><section class=comments><p>a, b, c, d, e, f, g, h, i, j</p></section>") == "One, two."


def test_deep_and_long_pages_take_linear_time():
    assert html_text.main_text("<div>x, y" * 20_000).count("x, y") == 20_000
    assert len(html_text.main_text("<p>" + "word, " * 200_000)) > 1_000_000


@pytest.mark.parametrize("piece", ["<!-- ", "<a '", '<a "', "<a b='", '<a b="x', "<script>", "<x", "</x>", "<div></x>", "a < b ", "<p class=", "&amp"])
def test_broken_markup_takes_linear_time(piece):
    began = time.perf_counter()
    html_text.main_text(piece * 60_000)
    assert time.perf_counter() - began < 10


def test_quotes_without_a_value_hide_nothing():
    assert html_text.main_text("""<article><p class=a">One, two.</p><p title="a > b" it's>Three, four.</p></article>""") == "One, two.\n\nThree, four."


def test_query_gives_each_article(spark, sf):
    rows = {r.page_id: r for r in queries.op9_html_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(x for x in parts if x)
        assert (rows[p.page_id].text, rows[p.page_id].url, rows[p.page_id].n_chars) == (text, p.url, len(text))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<p>a, b</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect()) == [(0, "a, b"), (1, ""), (1, "")]
    assert html_text.extract(df.limit(0)).collect() == []
