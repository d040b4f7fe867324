import re
import time

import pytest

from factlake.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.trained()


def text(page, model):
    return H.main_text(page, model)


def test_held_out_layouts(model):
    """Share of text runs of pages of another seed that get their known state."""
    right = total = 0
    for nodes in H.labelled_pages(150, 77):
        for n, p in zip(nodes, model.marginals(nodes, H.evidence(nodes)), strict=True):
            if n.tag == "#":
                total, right = total + 1, right + ((p >= 0.5) == (n.state == H.IN))
    assert right / total > 0.97


def brute(nodes, own, tie):
    """P(IN) of each node, summed over all assignments of states."""
    import itertools

    totals = [[0.0] * 3 for _ in nodes]
    for states in itertools.product(range(3), repeat=len(nodes)):
        w = own[0][states[0]] * (1e-6 if states[0] == H.IN else 1)
        for i in range(1, len(nodes)):
            w *= own[i][states[i]] * tie[states[nodes[i].parent]][states[i]]
        for i, s in enumerate(states):
            totals[i][s] += w
    return [t[H.IN] / sum(t) for t in totals]


@pytest.mark.parametrize("page", ["<div class=menu><a>x</a></div><article><p>One two. Three.<p>Four five</article>", "<p>a<ul><li>b<li>c</ul>"])
def test_messages_are_exact(page, model):
    nodes = H.parse(page)
    features = H.evidence(nodes)
    want = brute(nodes, model.own(features).tolist(), model.tie.tolist())
    assert model.marginals(nodes, features) == pytest.approx(want, abs=1e-9)


def test_tables_of_pages(spark, sf, model):
    """On the given pages the text is that of the article element, read by a plain pattern."""
    import html

    rows = spark.read.parquet(f"{sf}/pages.parquet")
    html_of = {r.page_id: r.html for r in rows.collect()}
    got = {r.page_id: r for r in H.op6_html_text(spark, sf).collect()}
    assert got.keys() == html_of.keys()
    for k, page in html_of.items():
        body = re.sub("</?b>", "", re.search("(?s)<article>(.*?)</article>", page)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[k].text == "\n".join(x for x in blocks if x)
        assert got[k].n_chars == len(got[k].text)


def test_parts_that_go(model):
    page = """<!doctype html><html><head><title>t</title><script>var a = "</p><article>";</script></head><body class="home">
    <div id="cookie-notice"><p>We use cookies on this site. Accept.</p></div><header><h1>Site name</h1><nav><a href=/>Home</a><a href=/x>News</a></nav></header>
    <div class="layout"><aside class="sidebar"><h3>Related</h3><ul><li><a href=1>One more</a><li><a href=2>And two</a></ul></aside>
    <div class="post-content"><h1>Title &amp; more</h1><p>First   paragraph,\nwith <a href=#>a link</a> and <b>bold</b> text.</p><p>Second one &lt;here&gt;, a bit longer than the first one was.
    <div class="ad">Buy now!</div><form><label>Mail</label><input><button>Go</button></form><p>Third one ends it.</div></div>
    <section id="comments"><h2>2 comments</h2><div class="comment"><b>Jo</b><p>I liked this very much, thanks.</p></div></section>
    <footer>&copy; someone, all rights reserved.</footer></body></html>"""
    assert text(page, model) == "Title & more\nFirst paragraph, with a link and bold text.\nSecond one <here>, a bit longer than the first one was.\nThird one ends it."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!-- open", "<script>x", "<div", "</p></div>", "<p title=\"a>b", "&#0;&bogus;", "<table><td><p>"])
def test_broken_pages_do_not_stop(page, model):
    assert isinstance(text(page, model), str)


def test_long_and_deep_pages(model):
    body = "<p>" + "word, and another. " * 20_000 + "</p>"
    assert len(text(f"<article>{body}</article>", model)) > 300_000
    assert isinstance(text("<div>" * 3000 + "deep", model), str)


@pytest.mark.parametrize(
    "unit",
    ['<a title="x ', "<a ", '<a ">"', "</b x=\"", "<a 'x\" ", "<head>", "<body>", "<button>a ", "<svg><p> ", "<", "<b class=q>", "&#1", "<a \">\" '>'", "<!x ", "<p title='", "<div>", "</script ", "</nav ", "</svg ", "<svg>"],
)
def test_time_follows_the_length(unit, model):
    """Hostile pages of 200 kB and one > at their end."""
    for page in (unit * (200_000 // len(unit)), unit * (200_000 // len(unit)) + ">", "<div>" * 20_000 + "</p>" * 20_000 + "<body>" * 20_000):
        start = time.process_time()
        assert isinstance(text(page, model), str)
        assert time.process_time() - start < 6


@pytest.mark.parametrize("first, unit", [("<p><td>", "<div>"), ("<p><td>", "<div></p>"), ("<li><ul>", "<li><p>"), ("<script>", "</script "), ("<svg>", "</svg "), ("<head>", "</head "), ("<select><td>", "<option>"), ("<svg>", "<svg><i>")])
def test_a_megabyte_of_open_elements(first, unit):
    start = time.process_time()
    assert H.parse(first + unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 8


def test_numbers_of_any_length(model):
    assert H._decoded("&#65;&#" + "0" * 9000 + "66;&#" + "9" * 9000 + ";c&#67") == "AB\ufffdcC"


def test_tags_end_where_quotes_say():
    tags = H.Tags("<a title='x>y' b=\"q'>\">t<p class=\"open>u</p ><3 <!-- > --><br/>")
    found, at = [], 0
    while x := tags.next(at):
        found.append(x[2:])
        at = x[1]
    assert found == [("", "a", " title='x>y' b=\"q'>\""), ("", "p", " class=\"open"), ("/", "p", " "), ("", "", ""), ("", "br", "/")]


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, f"<article>{BODY}</article>")], "page_id bigint, html string").selectExpr("*", "7 as text", "8 as c0", "9 as `a.b`")
    got = H.extract_text(pages)
    assert got.columns == ["page_id", "text", "c0", "a.b", "text"] and [tuple(r) for r in got.collect()] == [(1, 7, 8, 9, LINES)]


def test_rows(spark):
    rows = [(1, "u", "<article><p>One two three four, five six seven.</p></article>"), (1, "u", None), (None, None, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = H.extract_text(pages).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, "One two three four, five six seven."), (1, ""), (None, "")]
    assert H.extract_text(pages.limit(0)).count() == 0


BODY = "<p>First paragraph of the article, with enough words to be one.</p><p>The second paragraph, which is longer, ends the whole article.</p>"
LINES = "First paragraph of the article, with enough words to be one.\nThe second paragraph, which is longer, ends the whole article."


@pytest.mark.parametrize("open_tag", ["<button>", "<select><option>a<option>b", "<object data=x>", "<video src=x>", "<noscript>", "<canvas>", "<svg>", "<math>", "<template>", "<audio>"])
@pytest.mark.parametrize("around", ["{}<article>{}</article>", "<nav><a href=/>Home</a>{}</nav><article>{}</article>", "<article>{}{}</article>"])
def test_unclosed_parts_do_not_take_the_article(open_tag, around, model):
    got = text("<html><body>" + around.format(open_tag, BODY) + "</body></html>", model)
    assert LINES in got


def test_head_without_end(model):
    assert text(f"<head><title>t</title><article>{BODY}</article>", model) == LINES


def test_text_of_math_and_fallbacks_stays_in_its_paragraph(model):
    page = "<article><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is <object>an object</object> and <noscript>plain words</noscript>, as we know.</p><p>Another paragraph follows it, and it ends here.</p></article>"
    assert text(page, model) == "The sum x+1 is an object and plain words, as we know.\nAnother paragraph follows it, and it ends here."


def test_closed_parts_go(model):
    assert text(f"<article>{BODY}{'<button>Share</button>' * 8}</article>", model) == LINES
    page = f"<article>{BODY}<button>Send it</button><select><option>One<option>Two</select><video>No video here</video><svg><text>logo</text></svg></article>"
    assert text(page, model) == LINES
