"""Main text of pages written by hand."""

import html

from talus.llm import htmltext

ARTICLE = "<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text.</p><ul><li>one</li><li>two</li></ul></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a>Home</a></nav>
<script>var a = "<p>no</p>";</script><div class="cookie-notice">We use cookies</div>{ARTICLE}<aside>side</aside>
<div id="comments"><p>reader says</p></div><form><input name=q><button>Go</button></form><footer>&copy; 2024</footer></body></html>"""


def test_article_only():
    assert htmltext.main_text(PAGE) == "Title & more First bold text. one two"


def test_names_of_what_holds_the_page_do_not_drop_it():
    text = "Title & more First bold text. one two"
    named = ARTICLE.replace("<article>", '<article class="post related-none">')
    for before, after in [
        ('<html class="no-menu"><body class="single no-sidebar comments-open">', "</body></html>"),
        ('<body class="has-menu header-fixed topbar">', "</body>"),
        ('<body><div class="site has-sidebar"><main class="no-sidebar">', "</main></div>"),
        ('<body><div class="has-sidebar"><div id="widgets-off">', "</div></div><p>Posted on Monday</p>"),
        ('<body><main><div class="has-sidebar">', "</div></main>"),
    ]:
        for article in (ARTICLE, named):
            assert htmltext.main_text(f'{before}<div class="menu">no</div>{article}<div class="sidebar"><p>side</p></div>{after}') == text
    own = "<body class=no-sidebar><h1>Title</h1><p>The page itself, which is not in an article.</p>"
    said = '<div id="comments"><article class="comment"><p>A reader says far more than the page does, and goes on and on.</p></article></div>'
    assert htmltext.main_text(own + said) == "Title The page itself, which is not in an article."
    assert htmltext.main_text(f"<body>{ARTICLE[:-10]}{said}</article>") == text
    related = '<div class="related"><article><p>Another page</p></article></div>'
    assert htmltext.main_text(f"<body class=no-sidebar>{ARTICLE}{related}") == htmltext.main_text(f"<main>{ARTICLE}{related}</main>") == text


def test_broken_and_bare_pages():
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p>") == ""
    assert htmltext.main_text("just text &lt;3 &#x41;&nbsp;b") == html.unescape("just text &lt;3 A b")
    assert htmltext.main_text("<p>a<p>b<br>c<!-- no -->d</p><div>e") == "a b cd e"
    assert htmltext.main_text("<p>a < b</p><script>never closed <p>x") == "a < b"


def test_what_a_host_repeats_is_removed(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, f"http://h.example/{i}", f"<body><div class=x1><span>Read our paper every day</span></div><div class=main><p>{w} is {w * 2}</p></div></body>") for i, w in enumerate(words)]
    rows += [(100, "http://other.example/", "<body><div class=x1>Read our paper every day</div></body>"), (101, None, None), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as low", "2 as host", "'z' as text", "3 as path")
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).collect())
    assert got[:10] == [(i, f"{w} is {w * 2}", len(w) * 3 + 4) for i, w in enumerate(words)]
    assert got[10:] == [(100, "Read our paper every day", 24), (101, "", 0), (101, "", 0)]
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_importance_is_the_entropy_of_content(spark):
    rows = [(i, "http://h/", f"<div class=a>same</div><div class=b>text {i}</div>") for i in range(4)]
    tree = htmltext.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.pages, round(r.importance, 6)) for r in tree) == [(4, 0.0), (4, 1.0)]


def test_every_page_gives_a_row(spark, data):
    rows = htmltext.op9_html_text(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in rows)


def test_deep_and_long_pages_take_time_by_their_length():
    """A page of a million open elements, or of as many ends of none, is read in one pass; values are those of a walk of the stack."""
    import time
    import zlib

    from talus.llm import htmltext

    began = time.process_time()
    deep = "<div>x" * 180_000
    assert htmltext.main_text(deep) == " ".join("x" * 180_000)
    assert len(htmltext.tree_nodes(deep)) == 180_000
    assert htmltext.main_text("<div>x</p></td></section>" * 40_000).startswith("x x")
    assert time.process_time() - began < 60
    page = '<div class="a">one<p>two</p><p>three</div><div class="a">four<ul><li>five<li>six'
    plain: dict[int, int] = {}
    for stack, text in htmltext.pieces(page):
        if text and not text.isspace():
            for n in stack[1:]:
                plain[n.path] = (plain.get(n.path, 0) * 1_000_003 + zlib.crc32(text.encode()) + 1) & 0x7FFFFFFFFFFFFFFF
    assert {k: v[0] for k, v in htmltext.tree_nodes(page).items() if v[0]} == plain
