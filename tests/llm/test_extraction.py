from __future__ import annotations

from marquee.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="home menu"><header>Site</header><nav><ul><li><a href="/x">x</a></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy <b>now</b></div><article class="post"><h1>Title &amp; more</h1><p><b>First   para<br>line
two.<p>Second &lt;x&gt; &#8364; a<b class="q">bold</b>word</p><aside>side</aside><div class="share-links">tweet</div>
<ul><li>one<li>two</ul><form><p>mail</p></form><p hidden>secret</p><span style="display: none">gone</span>tail
</article><section id="comments"><article class="comment"><p>nice</p></article></section><p>outside</p>
<footer>&copy; foo"""


def test_blocks():
    assert extraction.blocks_of(PAGE) == [
        ("Title & more", True), ("First para line two.", True), ("Second <x> € aboldword", True),
        ("one", True), ("two", True), ("tail", True), ("outside", False),
    ]
    assert extraction.blocks_of("") == []
    assert extraction.blocks_of("a < b <p>c</p><p></p></div><b>d") == [("a < b", False), ("c", False), ("d", False)]


def test_repeats_of_a_host_are_boilerplate(spark):
    notice = "This site uses the following very long notice on all of its pages. " * 5
    body = "".join(f"sentence {i} that two pages of the host share word for word. " for i in range(12))
    pages = []
    for i in range(8):
        own = " ".join(f"own{i}x{k}" for k in range(60))
        inner = f"<p>{own}</p>" + (f"<p>{body}</p>" if i < 2 else "") + f"<p>{notice}</p>"
        pages.append((i, "http://a.example/p", f"<body><article>{inner}</article><p>outside</p></body>"))
        pages.append((100 + i, "https://WWW.b.example./q", f"<body><div>{own}</div><div>{notice}</div></body>"))
    pages += [(200, None, None), (201, "x", ""), (None, "http://c.example", f"<p>{notice}"), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {}
    for r in extraction.extract(df).collect():
        assert got.setdefault(r.page_id, r.text) == r.text and r.n_chars == len(r.text)
    for i in range(8):
        own = " ".join(f"own{i}x{k}" for k in range(60))
        assert got[i] == own + (f"\n\n{body.strip()}" if i < 2 else "")
        assert got[100 + i] == own
    assert got[200] == got[201] == "" and got[None] == notice.strip()
    assert extraction.extract(df.limit(0)).collect() == []


def test_all_of_an_article_is_kept(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        blocks = [b for b, _ in extraction.blocks_of(f"<article>{inner}</article>")]
        assert got[r.page_id] == "\n\n".join(blocks)


def test_names_inside_an_article_drop_whole_containers_only():
    html = """<article><h2 id="related-work">Related work</h2><section id="social-security"><p>Pensions</p></section>
<p id="notice-1">Notice one</p><p>code <span class="hljs-comment"># why</span> ends</p><div class="social-security">Law</div>
<label for="a">Label</label><button>Press</button><div class="ad">Buy</div><ul class="x share-links"><li>tweet</ul>
<div class="comments"><p>first!</p></div><p>last</p></article>"""
    assert [text for text, _ in extraction.blocks_of(html)] == [
        "Related work", "Pensions", "Notice one", "code # why ends", "Law", "Label", "Press", "last",
    ]


def texts_of(html):
    return [text for text, _ in extraction.blocks_of(html)]


def test_names_of_containers_inside_an_article():
    """One line that has to go for each way of naming it, between lines that have to stay."""
    gone = (
        '<div id="comments">x</div>', '<div class="post-comments">x</div>', '<div class="related-posts">x</div>',
        '<div class="ad-300x250">x</div>', '<div id="ad-slot-top">x</div>', '<p class="advert">x</p>',
        '<div id="newsletter">x</div>', '<ul class="social_share"><li>x</ul>', '<li class="comment">x</li>',
    )
    for i, one in enumerate(gone):
        assert texts_of(f"<article><p>before {i}</p>{one}<p>after {i}</p></article>") == [f"before {i}", f"after {i}"], one
        assert texts_of(f"<div><p>before {i}</p>{one}<p>after {i}</p></div>") == [f"before {i}", f"after {i}"], one


def test_headings_paragraph_ids_and_inline_elements_stay():
    for one, text in (
        ('<h2 id="related-work">Related work</h2>', "Related work"),
        ('<p id="notice-1">Notice one</p>', "Notice one"),
        ('<p>see <a class="social-link">the club</a> now</p>', "see the club now"),
        ('<div class="social-security">Pensions</div>', "Pensions"),
        ('<div id="menu-of-the-day">Soup</div>', "Soup"),
        ('<section class="alertness-study">Sleep</section>', "Sleep"),
    ):
        for shell in ("article", "div"):
            assert texts_of(f"<{shell}><p>a</p>{one}<p>b</p></{shell}>") == ["a", text, "b"], (shell, one)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_short_menus_of_plain_pages_go_and_single_lines_stay(spark):
    rows = []
    for i in range(8):
        own = " ".join(f"own{i}x{k}" for k in range(40))
        extra = "<div>Yes, indeed.</div>" if i in (2, 5) else ""  # on two pages of eight
        rows.append((i, "http://a.example/p", f"<div>Home News Contact us</div><div>{own}</div>{extra}<div>All rights are with the people of a.example</div>"))
    got = {r.page_id: (r.text, r.n_boilerplate) for r in extraction.extract(pages_of(spark, rows)).collect()}
    for i in range(8):
        own = " ".join(f"own{i}x{k}" for k in range(40))
        assert got[i] == (own + ("\n\nYes, indeed." if i in (2, 5) else ""), 2)


def test_long_strings_inside_different_blocks(spark):
    """A notice that carries the page's own number is no equal block, but mostly a repeated string."""
    notice = " ".join(f"clause{k} of the terms" for k in range(60))
    rows = [(i, "http://a.example/p", f"<p>page {i} says something of its own {i * 7919}</p><p>No. {i}: {notice} ({i})</p>") for i in range(4)]
    got = {r.page_id: r.text for r in extraction.extract(pages_of(spark, rows)).collect()}
    assert got == {i: f"page {i} says something of its own {i * 7919}" for i in range(4)}


def test_other_hosts_and_one_page_twice_are_no_repeats(spark):
    notice = " ".join(f"word{k}" for k in range(80))
    rows = [(1, "http://a.example/1", f"<p>{notice}</p>"), (1, "http://a.example/1", f"<p>{notice}</p>"), (2, "http://b.example/1", f"<p>{notice}</p>")]
    assert [r.text for r in extraction.extract(pages_of(spark, rows)).collect()] == [notice] * 3


def test_columns_of_any_name(spark):
    df = pages_of(spark, [(i, "http://a.example", f"<p>text {i}</p>") for i in range(3)])
    for name in ("row", "key", "unit", "host", "blocks", "symbols", "gone", "pages", "scope"):
        df = df.withColumn(name, df["page_id"])
    assert sorted(r.text for r in extraction.extract(df).collect()) == ["text 0", "text 1", "text 2"]
