import html
import re
import time

from corvida.llm import pagetext, queries

SCHEMA = "page_id long, url string, html string"


def text_of(source):
    return pagetext.Page(source).main_text()[0]


def test_what_is_main_text():
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title></head><body class="no-sidebar"><header>Site</header><div class="cookie-notice">We use</div>
      <form id=f><main><article class="post"><header><h1>Head</h1></header><p>One<b>bold</b> two&nbsp;x<br>y <p>Two<ul><li>a<li>b</ul><div class="shareBox share">Share</div>
      <section id="comments"><article class="comment"><p>nice</article></section><table><tr><td>c1<td>c2<tr><td>c3</table><script>if(a<b){"</p>"}</script>tail</article></main></form><footer>F</footer>"""
    assert text_of(page) == "Head\nOnebold two x y\nTwo\na\nb\nc1\nc2\nc3\ntail"


def test_broken_markup_and_references():
    cases = {
        "": "", "plain text": "plain text", "<p>a<p>b": "a\nb", "a < b and c > d": "a < b and c > d", '<p title="x > y">z</p>': "z", "<p don't>z</p> it's": "z\nit's", "<!-- x": "", '<a href="unclosed>text</a>': "text",
        "<div>a<span>b</span>c<div>d</div>e</div>": "abc\nd\ne", "&lt;p&gt; &amp &am &#65; &nope;": "<p> & &am A &nope;", "<p>x</div></b></i>y": "xy", "<p>a</p></article>b": "a\nb", "<p>cut <a hre": "cut",
        "<main>m<aside>s</aside></main>outside": "m", "<article></article><main>m</main>": "m", "<nav>n</nav>t<p hidden>h</p><p style='display: none'>h</p><div role=search>s</div>": "t", "<pre>a\n  b</pre>": "a b",
        "<article class=comment>c</article><p>body": "c", "<article>1</article>x<article>2</article>": "1\n2",
    }
    for source, want in cases.items():
        assert text_of(source) == want, source


def test_long_and_deep_pages_take_time_in_proportion():
    began = time.time()
    for source in ("<div>" * 100_000 + "x", '<p x="' * 50_000, "<b>" * 30_000 + "</i>" * 30_000, "<li>" * 50_000, "<b><p>x" * 10_000, "<p><table><td>" * 5000 + "<div>" * 20_000):
        pagetext.Page(source).main_text()
    assert time.time() - began < 60
    words = " ".join(f"w{i}" for i in range(200_000))
    assert text_of(f"<article><p>{words}</p></article>") == words


def brute_templates(pages, min_pages, min_share):
    """Hashes by host, counted in plain Python."""
    seen = {}
    for host, source in pages:
        text, trees, _ = pagetext.Page(source).main_text()
        for t in set(trees):
            seen.setdefault(host, {}).setdefault(t, set()).add(text)
        seen.setdefault(host, {}).setdefault(None, set()).add(text)
    return {h: {t for t, x in by.items() if t is not None and len(x) >= max(min_pages, min_share * len(by[None]))} for h, by in seen.items()}


def site():
    rows = []
    for i in range(60):
        host = "hot.example" if i % 3 else f"h{i % 2}.example"
        body = f"<h2>Title {i}</h2><p>Own text number {i} of the page, long enough to be its main part, and {i * 7} more.</p><p>Quoted by many.</p>"
        wrapped = f"<article>{body}<div>Subscribe <b>now</b></div></article>" if i % 2 else f"<div id=c>{body}</div><div><p>Powered by things</p></div>"
        rows.append((i, f"http://{host}/{i}", f"<body><div><ul><li>Home<li>About</ul></div>{wrapped}<div>Ad {i}</div></body>"))
    rows += [(100 + i, "http://hot.example/copy", "<div><p>The same article, published again and again.</p></div>") for i in range(30)]
    return rows


def test_templates_against_brute_force(spark):
    rows = site()
    df = spark.createDataFrame([(u.split("/")[2], h) for _, u, h in rows], "host string, html string")
    got = {r.host: {t % (1 << 64) for t in r.templates} for r in pagetext.host_templates(df).collect()}
    assert got == {h: t for h, t in brute_templates([(u.split("/")[2], x) for _, u, x in rows], 5, 0.02).items() if t}


def test_templates_go_and_articles_stay(spark):
    rows = site()
    got = {r.page_id: r for r in pagetext.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i in range(60):
        own = f"Title {i}\nOwn text number {i} of the page, long enough to be its main part, and {i * 7} more."
        # within an article a paragraph that many pages share stays, a container goes
        assert got[i].text == (own + "\nQuoted by many." if i % 2 else own + f"\nAd {i}"), i
        assert got[i].n_templates >= 1
    assert all(got[100 + i].text == "The same article, published again and again." for i in range(30))


def test_near_copies_without_an_article_are_no_template(spark):
    shared = "".join(f"<p>Paragraph {k} of a text that was published in many versions.</p>" for k in range(9))
    rows = [(i, "http://x.example/", f"<div>{shared}<p>Version {i}</p></div>") for i in range(40)]
    got = {r.page_id: r.text for r in pagetext.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].count("\n") == 9 and got[i].endswith(f"Version {i}") for i in range(40))


def naive(page):
    """Blocks between the tags of the tables' own pages."""
    article = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article)]
    return "\n".join(b for b in blocks if b)


def test_query_on_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op13_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert r.text == naive(p.html) and r.n_chars == len(r.text) and r.url == p.url


def test_odd_and_empty_tables(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "http://h/", None), (2, "", ""), (3, "no host", "<p>b</p>")]
    got = pagetext.main_texts(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", host string, templates string"))
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, "a"), (1, "a"), (2, ""), (3, "b")]
    assert pagetext.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0
