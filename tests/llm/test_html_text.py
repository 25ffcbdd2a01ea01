import re

import pytest

from edgelake.llm.html_text import main_text

LONG = "The house of the river is on the way to the town and it has been there for as long as they had known it. " * 3


def text(page):
    return main_text(page)[0]


def test_article_without_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>x";</script></head><body class="has-sidebar">
    <header><p>Site name</p></header><nav><ul><li><a href="/a>b">One</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div>
    <!-- <p>no</p> --><div id=adBanner>Buy</div><aside>{LONG}</aside><form><label>Mail</label></form>
    <article><header><h1>A &lt;b&gt; &amp;amp; c</h1></header><p>Short.<p><b>Two
      lines</b><br>of&nbsp;text &#233;</p><div class="share">Share</div><p>{LONG}</p><ul><li>x<li>y</ul>
    <section class="reader-comments"><h2>Comments</h2><p>{LONG}</p></section></article><div class="related">More</div><footer>&copy; me</footer></body></html>"""
    assert text(page) == "\n".join(["A <b> &amp; c", "Short.", "Two lines of text é", " ".join(LONG.split()), "x", "y"])


def test_links_are_menus_also_in_articles():
    assert text('<article><p>Short</p><p><a href="x">one</a> <a href="y">two</a></p></article>') == "Short"


def test_open_blocks_follow_their_neighbours():
    page = f"<body><div><h2>Head</h2><p>{LONG}</p><p>End.</p></div></body>"
    assert text(page).startswith("Head\n") and text(page).endswith("\nEnd.")
    listed = f"<body><p>{'<a href=q>go</a> ' * 5}</p><p>Near it</p><p>{'zzqx wvvk ' * 30}</p></body>"
    assert text(listed) == ""


def test_odd_pages():
    assert main_text("") == ("", 0, 0)
    assert text("   \n ") == "" and text("<p>") == "" and text("<") == "<"
    assert text("plain & simple < text") == "plain & simple < text"
    assert text("<html><head><title>x<body><p>Seen</p>") == "Seen"
    assert text("<article><p>open <i>and <b>never closed") == "open and never closed"
    assert text("<p>a</div></article></p>b") == "a\nb"
    assert text("<script>never closed <p>x</p>") == "" and text("<!-- never closed <p>x</p>") == ""
    assert text("<p title='a > b'>c</p>") == "c" and text("<p class=\"it's\">c</p>") == "c"
    assert len(text("<article>" + "<p>word" * 50_000)) == 5 * 50_000 - 1
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_rows(spark):
    from edgelake.llm.html_text import extract

    rows = [(1, "u", "<p>aé\U0001f600</p>", "t"), (None, None, None, "t"), (1, "u", "", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect()) == [(0, "", "", 0), (1, "u", "", 0), (1, "u", "aé😀", 3)]


def test_registered_query_equals_the_articles_of_the_table(spark, sf):
    import html
    import re

    from edgelake.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op7_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("tag", ["div", "section"])
def test_pages_keep_their_text_without_article_elements(spark, sf, tag):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert text(re.sub(r"<(/?)article\b", rf"<\1{tag}", r.html)) == text(r.html)


def test_pages_keep_their_text_without_names(spark, sf):
    named = r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        page = re.sub(r"<(/?)article\b", r"<\1div", r.html)
        assert text(re.sub(named, "", page)) == text(r.html)


def test_bare_blocks_follow_the_page():
    menu = '<ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul>'
    body = f"<div><h1>Head</h1><p>{LONG}</p><p>End.</p></div>"
    assert text(f"<body>{menu}<div>Buy this thing now.</div>{body}<div>More of it.</div><footer>Me</footer></body>") == text(body)
    assert text("<div>Only this.</div>") == "Only this."


def test_end_tags_without_an_element_cost_nothing():
    assert text("<div>" * 100_000 + "</p>" * 100_000 + "deep") == "deep"


def test_text_of_a_language_without_stop_words_is_kept():
    prose = "Дом у реки стоит на дороге в город, и он был там столько, сколько они его знали. " * 4
    menu = '<nav><a href="/a">Один</a></nav><div class="related"><a href="/b">Два</a></div>'
    page = f"<body>{menu}<div><h1>Дом</h1><p>{prose}</p><p>{prose}</p></div><footer>Конец</footer></body>"
    assert text(page) == "\n".join(["Дом", prose.strip(), prose.strip()])
