import re

from spanforge.llm import boilerplate as B

TREE = B.train()


def test_the_tree_learns_its_table():
    import numpy as np

    rows = np.array(B.LABELLED, float)
    assert (B.classify(TREE, rows[:, :-1]) == rows[:, -1]).all()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- x --><div class="ad">Buy this.</div>
<div id="cookie-notice"><p>We use cookies &mdash; a lot of them, for you.</p></div>
<article><header><h1>The   head&shy;line</h1></header><p><b>First &lt;para&gt; with <a href="#">a link</a> in it.<br>Next&nbsp;line<p>Second &#233;&#x41; para</p>
<form><p>Type here</p><button>Go</button></form><aside>Aside text that is long enough to look like something.</aside><section class="comments"><p>First! what a nice article, thank you all</p></section>
<p>End &am</p></article><div class="sidebar"><p>Other things</p></div><footer>&copy; me</footer></body></html>"""


def test_parts_of_a_page():
    assert B.main_text(TREE, PAGE).replace("\xad", "") == "The headline\n\nFirst <para> with a link in it. Next line\n\nSecond éA para\n\nEnd &am"


def test_edges(spark):
    assert B.main_text(TREE, None) == B.main_text(TREE, "") == B.main_text(TREE, "<p>") == B.main_text(TREE, "<article><script>x") == ""
    assert B.main_text(TREE, "<article><p>cut &am") == "cut &am" and B.main_text(TREE, "<article><p>a < b <p class=\"x") == "a < b"
    long = "<article>" + "<p>word and word</p>" * 20000
    assert B.main_text(TREE, long).count("\n\n") == 19999
    plain = "<div><a href=1>Home</a> | <a href=2>News</a></div><div>Headline of it</div><div>" + "Some words stand here. " * 20 + "</div><div>" + "More words stand there. " * 20 + "</div><div>Contact</div>"
    assert B.main_text(TREE, plain).split("\n\n")[0] == "Headline of it" and "Contact" not in B.main_text(TREE, plain) and "Home" not in B.main_text(TREE, plain)
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (None, None, None)], "page_id long, html string, text string")
    out = B.extract(df).collect()
    assert out[0] == out[1] and out[2].text == "" and B.extract(df.filter("false")).count() == 0
    assert B.extract(df, text="html").columns == ["page_id", "text", "html"]


def words(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


def test_the_last_paragraph_before_links_stays():
    texts = [words(n, i) for i, n in enumerate((60, 45, 70, 201))]
    body = "".join(f"<p>{t}</p>" for t in texts)
    for page in (f"<article>{body}</article><nav><a href=1>One</a> <a href=2>Two</a></nav>", f"<article><p>A</p>{body}</article><p><a href=1>Read on here</a></p>", f"<div>{body}<p><a href=1>a line of links</a></p></div>"):
        assert all(t in B.main_text(TREE, page) for t in texts), page[-60:]
        assert "One" not in B.main_text(TREE, page)
    assert words(51) in B.main_text(TREE, f"<p>{words(30, 7)}</p><p>{words(51)}</p><p><a href=1>a linked line of words</a></p>")
    assert B.main_text(TREE, f"<article><h1>Title</h1><p>{words(30)}</p><p>The end.</p></article><ul><li><a href=1>x</a></ul>").endswith("The end.")


def test_names_of_layouts_are_no_marks():
    text = f"<h1>Some title</h1><p>{words(40)}</p><p>{words(60, 5)}</p>"
    want = B.main_text(TREE, text)
    assert want.count("\n\n") == 2
    for name in ("no-sidebar", "has-sidebar", "content-with-ads", "no-comments", "hidden-title related-work", "share-price-story", "hidden-xs", "elementor-widget-container"):
        for page in (f'<body><div class="{name}">{text}</div></body>', f'<div id="{name}"><article>{text}</article></div>', f'<main class="{name}">{text}</main>'):
            assert B.main_text(TREE, page) == want, page[:60]
    for name in ("sidebar", "site-footer", "commentList", "comment-list", "ad ad-top", "cookie-notice", "related_posts", "main-nav", "post-comments"):
        assert B.main_text(TREE, f'{text}<div class="{name}"><p>{words(80, 900)}</p></div>') == want, name
        assert B.main_text(TREE, f'<article>{text}<div class="{name}"><p>{words(80, 900)}</p></div></article>') == want, name
    # a main part in a frame named like boilerplate; but not in comments or asides
    assert B.main_text(TREE, f'<div class="sidebar-right"><main>{text}</main></div>') == want
    assert B.main_text(TREE, f'{text}<section class="comments"><article><p>{words(50, 300)}</p></article></section><aside><article>{words(40, 600)}</article></aside>') == want


def test_forms():
    text = f"<h1>Some title</h1><p>{words(40)}</p><p>{words(60, 5)}</p>"
    want = B.main_text(TREE, text)
    asks = f"<form><p>Your name</p><p>{words(30, 500)}</p><button>Go</button></form>"
    for page in (f"<form>{text}</form>", f"<form><div><article>{text}</article></div></form>", f"<article>{text}{asks}</article>", f"{text}{asks}", f"{asks}<main>{text}</main>"):
        assert B.main_text(TREE, page) == want, page[:60]


def test_driver_pages_keep_their_articles(spark):
    """Against the plain reading of these pages' own articles."""
    import html

    n = 0
    for r in B.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), keep_html=True).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:p|h1)>|<footer>.*", re.sub(r"<[^>]*\Z", "", body[1])) if body else []
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in parts) if x)
        n += r.text == want
    assert n >= 249, n
