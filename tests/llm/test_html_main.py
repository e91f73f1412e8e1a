import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.llm import html_main

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p><p>no";</script></head>
<body><nav><ul><li><a href="/a">Menu</a><li><a>More</a></ul></nav><!-- <p>no</p> --><div class="ad box">Advert</div>
<{tag}><h1>Title {n}</h1><p><b>First &amp; bold&nbsp;text {n}<br>goes  on<p>Second <i>block</i> of {n}.</p>
<aside>Side</aside><form><p>Form</p></form><div class="user-comments"><p>Great!</p></div>{last}</{tag}>
<div id="cookie-notice">We use cookies</div><footer>&copy; Site</footer>"""


def page(n, tag="article", last=""):
    return PAGE.format(n=n, tag=tag, last=last)


def text(n, last=""):
    return f"Title {n}\nFirst & bold text {n} goes on\nSecond block of {n}." + last


CASES = [
    (page(1), text(1)),
    (page(2, last="<p>Ünï 🎈</p>"), text(2, "\nÜnï 🎈")),
    (page(3).replace("</article>", ""), None),
    (None, ""),
    ("", ""),
    ("plain words only", "plain words only"),
    ("<p>a<p>b<br/>c", "a\nb c"),
    ("<script>never closed", ""),
    ("<article><p>1 < 2 and x &lt; y</p></article>", "1 < 2 and x < y"),
]


@pytest.mark.parametrize("html, want", [c for c in CASES if c[1] is not None])
def test_single_pages(html, want):
    assert html_main.main_text(html, None) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ('<h2><a class="header-link">#</a> Title</h2><p>x', "Title\nx"),
        ('<p>a <span class="search-term">b</span> c</p><p>d</p>', "a\nc\nd"),
        ('<article><a class="social-share">Share</a><p>one <i>two</i></p><p>three</p></article>', "one two\nthree"),
        ('<p>a <span class="ad">b <span>c</span> d</span> e</p>', "a\ne"),
        ('<p>a <b class="ad">b</b> <i>c</b> d</i> e</p>', "a\nc d e"),
        ('<p><b>open<p><a class="ad">no</a> yes</b> too', "open\nyes too"),
    ],
)
def test_marked_inline_elements_end(html, want):
    assert html_main.main_text(html, None) == want


def test_pages_of_hosts(spark):
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(30)]
    # a host without article elements: the template alone tells what repeats
    rows += [(100 + i, f"https://two.example/{i}", page(i, "div", f"<p>tail {i}</p>").replace('class="ad box"', "").replace("Advert", "Advert for all")) for i in range(30)]
    rows += [(200, None, page(7)), (201, "not a url", None), (202, "http://one.example/0", page(0))]
    got = {}
    for r in html_main.op1(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect():
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert all(got[i] == text(i) for i in range(30))
    assert all(got[100 + i] == text(i, f"\ntail {i}") for i in range(30))
    assert (got[200], got[201], got[202]) == (text(7), "", text(0))
    assert Counter(got.values())[""] == 1


def test_template_decides(spark):
    """An article outside <article>, a teaser inside one, boilerplate in the slot, a repeated block beside a title."""

    def html(i, boilerplate="This long notice is the same on every page of the host. " * 5):
        parts = "".join(f"<div class='part'>{'words of the article ' * 5}{i} {k}</div>" for k in range(2 + i % 3))
        return f"<body><article><p>Teaser of {i * 7}</p></article><div class='content'><h1>Title {i}</h1>{parts}<p>{boilerplate}</p></div></body>"

    rows = [(i, f"http://a.example/{i}", html(i)) for i in range(12)]
    # no template: a host of one page
    rows.append((100, "http://b.example/", html(100)))
    got = {r.page_id: r.text for r in html_main.op1(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(12):
        assert got[i].split("\n") == [f"Title {i}"] + [f"{'words of the article ' * 5}{i} {k}" for k in range(2 + i % 3)]
    assert got[100] == "Teaser of 700"


def test_classes_nest_as_a_whole():
    def of(once, *tokens):
        return {"pages": 9, "once": once, "tokens": [token(t) for t in tokens]}

    def token(t):
        path, text, _ = t.partition(" ")
        parent = path if text else path.rpartition(">")[0]
        return {"token": t.encode(), "parent": parent.encode(), "tag": "" if text else path.rpartition(">")[2], "depth": path.count(">"), "chars": 0, "fit": True}

    def names(classes):
        return sorted(sorted(t["token"].decode() for t in c["tokens"]) for c in html_main.nested(classes))

    root = of(True, ">body", ">body>ul", ">body>div")
    # a class in two slots is parted by slot, one of a single slot stays whole
    assert names([of(False, ">body>ul>li", ">body>div>p", ">body>div>p 0f"), of(False, ">body>ul>b", ">body>ul>b>i"), root]) == [
        [">body", ">body>div", ">body>ul"], [">body>div>p", ">body>div>p 0f"], [">body>ul>b", ">body>ul>b>i"], [">body>ul>li"],
    ]
    # a class in no slot of a valid class isn't valid, and what lies in it neither
    assert names([root, of(True, ">body>p>b"), of(True, ">body>p>b>i")]) == [[">body", ">body>div", ">body>ul"]]
    # two classes, each with a part in the other
    assert names([of(True, ">body", ">body>div>h1"), of(False, ">body>div", ">body>div>h1>i")]) == [[">body"], [">body>div"], [">body>div>h1"], [">body>div>h1>i"]]


@pytest.mark.parametrize(
    "html, want",
    [
        # layout classes of the body and of wrappers mark nothing
        ('<body class="page no-sidebar"><div class="content-with-sidebar"><h1>T</h1><p>x</p></div></body>', "T\nx"),
        ('<main class="search"><p>x</p></main>', "x"),
        # an article inside a marked wrapper, and a teaser beside an article
        ('<div class="search-results"><article><h1>T</h1><p>long text of it</p></article><article><p>y</p></article></div>', "T\nlong text of it\ny"),
        ('<div class="related"><article><p>teaser that is rather long</p></article></div><article><p>x</p></article>', "x"),
        ('<article><p>x</p><section class="comments"><article class="comment"><p>c</p></article></section></article>', "x"),
        ('<section class="comments"><article class="comment"><p>c</p></article></section><p>x</p>', "x"),
        # an article's own header, a site's header, menus by longer words
        ('<article><div class="article-header"><h1>T</h1></div><p>x</p></article>', "T\nx"),
        ('<div class="post-header"><h1>T</h1></div><div class="site-header">S</div><p>x</p>', "T\nx"),
        ('<div class="menubar">m</div><ul class="topnav"><li>n</ul><div id="sidebar2">s</div><p>x</p>', "x"),
        ("<p>a < b <i>c</p><p>d <e", "a < b c\nd <e"),
    ],
)
def test_marked_wrappers(html, want):
    assert html_main.main_text(html, None) == want


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    deep = 60_000
    assert html_main.main_text("<div>" * deep + "x" + "</div>" * deep + "</p>" * deep, None) == "x"
    assert html_main.main_text("<a " * 200_000, None).startswith("<a <a")
    assert html_main.main_text('<a "' * 100_001, None).startswith('<a "')
    assert html_main.main_text("<b>" * 100_000 + "x" + "</b>" * 100_000, None) == "x"
    many = "".join(f"<p>word {i} <b>bold</b></p>" for i in range(200_000))
    assert html_main.main_text(f"<article>{many}</article>", None).count("\n") == 199_999
    assert len(html_main.page_tokens("<div>" * deep + "x" * 9)) == deep + 1
    classes = [{"pages": 2, "once": True, "tokens": [dict(zip(("token", "parent", "tag", "depth", "fit", "times", "chars"), (k, *x))) for k, x in html_main.page_tokens("<div>" * 20_000 + "x").items()]}]
    assert len(html_main.nested(classes)[0]["tokens"]) == 20_001
    assert time.perf_counter() - began < 60


def plain_classes(pages):
    """host to its classes by exact occurrence vectors, as sets of tokens."""
    hosts = {}
    for i, (host, html) in enumerate(pages):
        for token, x in html_main.page_tokens(html).items():
            hosts.setdefault(host, ({}, set()))[0].setdefault(token, {})[i] = x[4]
    total = Counter(h for h, _ in pages)
    out = {}
    for host, (vectors, _) in hosts.items():
        classes = {}
        for token, v in vectors.items():
            if len(v) >= 2 and len(v) >= html_main.SUPPORT * total[host]:
                classes.setdefault(tuple(sorted(v.items())), set()).add(token)
        out[host] = {frozenset(c) for c in classes.values()}
    return out


def test_classes_equal_plain_vectors(spark):
    pages = [("one", page(i)) for i in range(7)] + [("two", page(i, "div", "<p>x</p>" * (i % 3))) for i in range(9)] + [("three", page(1)), ("two", None), ("four", "")]
    rows = [(h, i, t) for i, (h, t) in enumerate(pages)]
    got = html_main.templates(spark.createDataFrame(rows, "host string, page long, html string").repartition(3)).collect()
    assert {r.host: {frozenset(bytes(t.token) for t in c.tokens) for c in r.template} for r in got} == {h: c for h, c in plain_classes(pages).items() if c}


def test_no_rows(spark):
    assert html_main.op1(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_clashing_columns(spark):
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("row", "host", "page", "template", "token", "salt", "text"):
        pages = pages.withColumn(c, F.lit("x"))
    assert {r.page_id: r.text for r in html_main.op1(pages).collect()} == {i: text(i) for i in range(5)}
    assert html_main.extract(pages, pages.columns).select("row.*").columns == pages.columns
