import re
import time

from testlattice.llm import html_text as ht


def test_article_with_everything_around_it(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- no -->
    <div id="sidebar"><p>side text that is long enough to look like an article, but it is a sidebar all the same</p></div>
    <main><article><header><h1>Title &amp; more</h1></header><p>First   par&nbsp;agraph
    goes on.<div class="ad">Buy!</div><p>Second <b>bold</b><i>er</i> &lt;tag&gt; &#233;<br>third<p>x</p><form><input><p>Mail</p></form>
    <aside>Pull</aside><ul><li>item</ul><script>if (a < b) {}</script></article>
    <section class="comments"><article class="comment"><p>Reader says</p></article></section></main><footer>&copy; no</footer></body></html>"""
    want = "Title & more\nFirst par agraph goes on.\nSecond bolder <tag> é\nthird\nx\nitem"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in ht.html_text(df).collect()} == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def test_hints_spare_the_article():
    """Classes of layout, of the article itself or of what holds it, and a form around the page, lose no text of the article."""
    for page in (
        "<article class='post has-sidebar'><p>one<p>two</article>",
        "<div id=page class=no-sidebar><article><p>one<p>two</article></div>",
        "<article class='comments-open category-social'><p>one<p>two</article>",
        "<div class=widget><div role=article class=ad><p>one<p>two</div></div>",
        "<div class='sidebar'><main class=menu><p>one<p>two</main></div>",
        "<form id=aspnetForm><div class=menu>m</div><article><p>one<form><p>mail</form><p>two</article></form>",
        "<form><h1>one</h1><p>two</p></form><p class=footer>no",
        "<div class=content-sidebar-wrap><form><div>one</div><div>two</div></form></div>",
        "<section class=comments><article class=comment><p>one<p>two</article></section>",
    ):
        assert ht.main_text(page).split("\n") == ["one", "two"], page
    for name in ("cookie-notice", "site-footer", "sidebar", "comment-list", "AD"):
        assert ht.main_text(f"<article><p>one<div class='x {name}'>no</div><p>two</article>") == "one\ntwo"
    assert ht.main_text("<article><p>one<div class=no-ads><p>two</div></article>") == "one\ntwo"
    assert ht.main_text("<aside><article>no</article></aside><div hidden><article>no</article></div><p>one") == "one"


def test_page_without_article():
    long = "a sentence of some length that goes on and on until it is long enough for the surge"
    page = f"<body><div class=menu><a href=/>Home</a></div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><div><p>{long}</p><p>short</p><p>{long}</p></div><div id=footer>f</div></body>"
    assert ht.main_text(page) == f"{long}\nshort\n{long}"
    assert ht.main_text("<p>tiny</p>") == "tiny"


def test_container_of_the_surge():
    """Without a marked article, adverts, bylines and links between its lines part nothing from the text."""
    long = "a sentence of some length that goes on and on until it is long enough for the surge"
    links = "<p><a>one</a></p><p><a>two</a></p><p><a>three</a></p>"
    adverts = "<div class=ad><p>buy<p>this<p>now</div>"
    menu = "<ul><li><a>a</a><li><a>b</a><li><a>c</a><li><a>d</a></ul>"
    text = lambda inner: ht.main_text(inner).split("\n")
    for head, tail in ((f"<body>{menu}<div>", f"</div>{menu}"), (f"<table><tr><td>{menu}</td></tr></table><section>", f"</section>{menu}")):
        assert text(f"{head}<h1>Title</h1>{links}<p>{long}</p>{tail}") == ["Title", "one", "two", "three", long]
        assert text(f"{head}<p>{long}</p>{adverts}<p>short</p><ul><li>x<li>y</ul>{adverts}<p>{long}</p>{tail}") == [long, "short", "x", "y", long]
        assert text(f"{head}<p>{long}</p><p><a>a paragraph that is one link</a></p><p>{long}</p>{tail}") == [long, "a paragraph that is one link", long]
        assert text(f"{head}<div>{long}</div>{links}<div>short</div>{links}<div>{long}</div>{tail}") == [long, "one", "two", "three", "short", "one", "two", "three", long]
    assert text(f"<body><h1>Title</h1>{menu}<p>{long}</p>{menu}") == ["Title", long]
    assert text(f"<body>{menu}<h1>Title</h1>{links}<p>short</p>{links}<p>{long}</p>{menu}") == ["Title", "one", "two", "three", "short", "one", "two", "three", long]
    assert text(f"<body>{menu}<div><h1>Title</h1><p>x</div>{links}<div><p>{long}<p>end</div>{menu}") == ["Title", long, "end"]
    part = f"<section><h2>Head</h2><p>{long}</section>"
    assert text(f"<body>{menu}<div id=content>{part}{links}<p>short</p>{links}{part}</div>") == ["Head", long, "short", "Head", long]


def test_broken_markup():
    assert ht.main_text("a < b <p class='x>y</p> z") == "a < b\ny\nz"
    assert ht.main_text("<article><p>open <b>tags") == "open tags"
    assert ht.main_text("<!-- never closed <p>a</p>") == ""


def test_the_distribution_decides_between_marked_articles():
    long = "a sentence of some length that goes on and on until it is long enough for the surge"
    card = "<article><h3>Teaser</h3><p>a few words</article>"
    assert ht.main_text(f"<main><h1>Head</h1>{card}<article><p>{long}<p>short</article>{card}{card}</main>") == f"Head\n{long}\nshort"
    assert ht.main_text(f"<main>{card}{card}</main>") == "Teaser\na few words\nTeaser\na few words"
    assert ht.main_text(f"{card}<article><p>{long}</article><article><p>{long}</article>") == f"{long}\n{long}"


def test_no_part_of_an_article_is_lost():
    long = "a sentence of some length that goes on and on until it is long enough for the surge"
    assert ht.main_text(f"<article><p>{long}<p>{long}</article><article><p>short second part</article>") == f"{long}\n{long}\nshort second part"
    assert ht.main_text(f"<article><h2>Story</h2><p>{long}</article><article><h2>Brief</h2><p>one line</article>") == f"Story\n{long}\nBrief\none line"
    assert ht.main_text(f"<article><p>{long}</article><article><p>a<p>b</article><article><p>c<p>d</article>") == f"{long}\na\nb\nc\nd"
    assert ht.main_text(f"<article><p>{long}</article><article><p><a>read on</a></article>") == long
    for name in ("menu", "menu-2", "social", "notice", "widget-3"):
        assert ht.main_text(f"<article><p>{long}<div class='{name}'><p>Starter: soup<p>Main: fish</div></article>") == f"{long}\nStarter: soup\nMain: fish"
        assert ht.main_text(f"<article><p>{long}<div class='{name}'><p><a>Home</a><p><a>About</a></div></article>") == long
    for name in ("promo-box-2", "ad", "newsletter-signup", "sidebar", "cookie-notice"):
        assert ht.main_text(f"<article><p>{long}<div class='{name}'>buy</div></article>") == long
        assert ht.main_text(f"<article><p>short<div class='{name}'><p>{long}<p>{long}</div></article>") == f"short\n{long}\n{long}"


def test_long_attributes():
    for n in (60_000, 70_000, 1_000_000):
        assert ht.main_text(f"<article><p data-x=\"{'>' * n}\">one<p data-y='{'y' * n}'>two</article>") == "one\ntwo"
    assert ht.main_text("<article><p title=it's>one</p><p>don't</p></article>") == "one\ndon't"


def test_broken_pages_take_no_longer():
    n = 1_000_000
    for piece in ("<i>", "<div>", "<a ", "</b>", "<a href='", "<p><i>", "<nav>", "<form><h1>", "<!x", "&amp", "<b =\"", "<", "<td><a>", "<li class=ad>", "x<br>"):
        page = piece * (n // 4 // len(piece))
        began = time.process_time()
        ht.main_text(page), ht.main_text(f"<article>{'<i>' * 20_000}{page}</article>"), ht.main_text(page + '<b x=">">')
        assert time.process_time() - began < 3, piece


def test_repeated_rows_clashing_columns_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "<p>a", 7, "x"), (1, "<p>a", 7, "x"), (2, "<p>" + "long words " * 200_000, 8, "y")], "page_id long, html string, n_chars int, text string")
    got = sorted((r["page_id"], r["n_chars"], r["text"][:3]) for r in ht.html_text(df).collect())
    assert got == [(1, 1, "a"), (1, 1, "a"), (2, 2_199_999, "lon")]
    assert ht.html_text(df.limit(0)).collect() == []


def test_test_pages(spark):
    """Against a plain reading of the test pages' own pattern: everything inside the article element, block by block."""
    import html

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in ht.html_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
