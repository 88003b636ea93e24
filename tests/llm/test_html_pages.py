from collections import Counter

import pytest

from quillspark.llm import html_pages

NAV = '<nav><ul><li><a href="/a">menu a</a></li></ul></nav>'
FOOT = "<footer>&copy; site &middot; foot</footer>"


def page(inner, around="article"):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{NAV}<!-- ad --><div class="ad">buy</div>{inner}{FOOT}</body></html>'


CASES = [
    (page("<article><h1>A &amp;&amp; B</h1><p><b>one  two\n three.<br><p>four</p>&#233;t&eacute;</article>"), "A && B\none two three.\nfour\nété"),
    (page("<article><p>x &lt;b&gt; y</p><form>no</form><aside>no</aside><div class='comments'><p>no</p></div><ul><li>i<li>j</ul></article>"), "x <b> y\ni\nj"),
    (page("<div class='post-12'><p>long enough text of the post, with words</p><p>more</p></div>"), "long enough text of the post, with words\nmore"),
    ("just text & more", "just text & more"),
    ("", ""),
    (None, ""),
    ("<p>open <b>bold<p>next", "open bold\nnext"),
    ("<script>only</script>", ""),
    ("a < b and <a href='x'>c</a>", "a < b and c"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "a\nb"),
    ("<article><p>cut &am", "cut &am"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_page_alone(html, text):
    assert html_pages.Page(html or "").text([]) == text


def test_query(spark):
    rows = [(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(CASES)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, host int, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_pages.op1(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(CASES)}
    assert html_pages.op1(df.limit(0)).count() == 0


def rows_of(spark, *pages, host="one.example"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")


def texts(df):
    return {r.page_id: r.text for r in html_pages.op1(df).collect()}


BODY = "<div class='body-{0}'><p>" + "word " * 60 + "{0}</p></div>"
ODD = "<div class='body-9'><p>" + "short body " * 15 + "</p></div><div class='profile'><p>" + "long list " * 40 + "</p></div>"


def test_consensus_beats_a_page_of_its_own(spark, monkeypatch):
    """On one page a list outweighs the body; the host's other pages say where the body is."""
    rows = [(i, "http://one.example/" + str(i), page(BODY.format(i))) for i in range(8)] + [
        (9, "http://user@one.example:80/9", page(ODD)), (10, None, page(ODD)), (11, "no url", None)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (html_pages.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(html_pages, "BROADCAST_HOSTS", bound)
        got = texts(df)
        assert got[9] == ("short body " * 15).strip() and "long list" in got[10] and got[11] == ""
        assert Counter(x.split()[0] for i, x in got.items() if i < 8) == {"word": 8}


def test_a_rarer_template_keeps_its_own_text(spark):
    """Where the host's path holds only a teaser, the page's own best container counts."""
    teaser = "<div class='body-9'><p>read on</p></div><div class='story'><p>" + "long story " * 40 + "</p></div>"
    assert "long story" in texts(rows_of(spark, *(page(BODY.format(i)) for i in range(6)), page(teaser)))[6]


def test_siblings_of_the_body_stay(spark):
    """Headline and lead in containers of their own, also under names with header; two halves of different class."""
    post = "<div class='post-{0}'><div class='post-header'><h1>Head {0}</h1></div><div class='lead'>lead {0}</div><div class='entry-content'>" + "<p>some longer text here</p>" * 9 + "</div></div>"
    halves = "<div class='intro'><p>" + "first half " * 9 + "</p></div><div class='details'><p>" + "second half " * 30 + "</p></div>"
    inner = "<article><header><h1>Top</h1></header><p class='lead'>lead</p><div class='entry-content'>" + "<p>some longer text here</p>" * 9 + "</div><footer>by x</footer></article>"
    lines = ["some longer text here"] * 9
    got = texts(
        rows_of(spark, *(page(post.format(i)) for i in range(3)), host="a.example").unionByName(
            rows_of(spark, page(halves), host="b.example").selectExpr("page_id + 10 as page_id", "url", "html")
        ).unionByName(rows_of(spark, page(inner), host="c.example").selectExpr("page_id + 20 as page_id", "url", "html"))
    )
    assert all(got[i] == "\n".join([f"Head {i}", f"lead {i}", *lines]) for i in range(3))
    assert got[10] == ("first half " * 9).strip() + "\n" + ("second half " * 30).strip()
    assert got[20] == "\n".join(["Top", "lead", *lines])


NAMED = [
    ("<div class='content with-sidebar'><p>kept words</p><div class='sidebar'>no</div></div>", "kept words"),
    ("<div class='no-comments has-menu'><p>kept words</p></div>", "kept words"),
    ("<section class='press-announcement'><p>kept words</p></section>", "kept words"),
    ("<div class='search-guide'><p>kept words</p></div>", "kept words"),
    ("<div class='share-price-report'><p>kept words</p></div>", "kept words"),
    ("<div class='notice'><p>kept words, as it is all there is</p></div>", "kept words, as it is all there is"),
    ("<div class='text'><p>kept words of the page</p></div><div class='site-notice'><p>no</p></div><p class='share-buttons'>no</p>", "kept words of the page"),
    ("<p>kept <span class='share'>no</span>words</p><div id='ad-slot-3'>no</div><div class='comments'><p>" + "no " * 50 + "</p></div>", "kept words"),
    ("<div role='navigation'>no</div><p>kept words</p><div data-class='ad' title=\"class='ad'\">more</div>", "kept words\nmore"),
    ("<p>kept words</p><div class=\"a", "kept words"),
    ("<p>kept words</p><!-- no", "kept words"),
    ("<p title='a > b'>kept words</p>", "kept words"),
]


@pytest.mark.parametrize(("html", "text"), NAMED)
def test_names_and_broken_markup(html, text):
    assert html_pages.Page(f"<body>{html}").text([]) == text


def test_hosts_with_several_layouts(spark):
    """Made pages of known text: every block of it is found, and nothing else, also where the page alone would be wrong."""
    import random

    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet sed do ut enim ad minim".split()) for _ in range(n))
    layouts = [
        lambda b: "<div class='story-7'><h1>{}</h1>{}</div>".format(b[0], "".join(f"<p>{x}</p>" for x in b[1:])),
        lambda b: "<div id='main'><div class='entry-header'><h1>{}</h1></div><div class='entry n3'>{}</div></div>".format(b[0], "".join(f"<p>{x}<br>" for x in b[1:])),
        lambda b: "<table><tr><td class='story'><h2>{}</h2>{}</td></tr></table>".format(b[0], "".join(f"<div>{x}</div>" for x in b[1:])),
        lambda b: "<main><h1>{}</h1><section>{}</section><section>{}</section></main>".format(b[0], "".join(f"<p>{x}</p>" for x in b[1:3]), "".join(f"<p>{x}</p>" for x in b[3:])),
    ]
    rows, want = [], {}
    for i in range(80):
        blocks = [words(5), *(words(rng.randint(8, 60)) for _ in range(rng.randint(3, 8)))]
        extra = "<div class='sidebar'><p>" + words(80) + "</p></div><div class='related-posts'><a href='x'>" + words(30) + "</a></div><ul class='c-list'>" + "".join(
            f"<li><a href='y'>{words(3)}</a></li>" for _ in range(6)
        ) + "</ul>"
        bio = "<div class='profile'><p>" + words(3 * sum(map(len, blocks)) // 10 if i % 10 == 0 else 12) + "</p></div>"
        html = layouts[i % 4](blocks)
        rows.append((i, f"https://h{i % 4}.example/{i}", page(html + extra + (bio if i % 4 in (0, 3) else ""))))
        want[i] = "\n".join(blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert texts(df) == want
    alone = [i for i, _, h in rows if html_pages.Page(h).text([]) != want[i]]
    assert len(alone) >= 2


def test_pages_that_take_long_to_read():
    """Each within seconds: the work grows in proportion to the page."""
    import time
    import tracemalloc

    cases = [
        ("<article>" + "<p>a b</p>" * 50_000 + "</article>", 50_000), ("<div>" * 100_000 + "deep", 1), ("<div>text here " * 50_000, 50_000), ("<table>" + "<tr><td>some text</td></tr>" * 100_000 + "</table>", 100_000),
        ('<a "' * 100_000, 0), ('<p>x</p>' + '<a x="' * 100_001, 1), ("<" * 200_000, 1), ("<div>" * 50_000 + "</span>" * 50_000 + "x", 1), ("<p><caption>" + "<b>" * 30_000 + "<div>x</div>" * 30_000, 30_000),
    ]
    for html, n in cases:
        began = time.monotonic()
        p = html_pages.Page(html)
        text = p.text(list(p.votes()))
        assert (text.count("\n") + 1 if text else 0) == n and time.monotonic() - began < 60, html[:30]
    tracemalloc.start()
    html_pages.Page("<div class='abc def'>x" * 20_000).votes()
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
