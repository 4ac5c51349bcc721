import html
import random
import re

import numpy as np
import pytest

from ridgeline.llm import html_text as H

SENT = "The river rose in the night, and by morning the lower road was gone; nobody had heard a sound. "


def article_of(page):
    """The article of a generated page, by its tags alone."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def soup(rnd, blocks):
    """A page without any telling tag or name: links, text, links, short lines."""
    links = "".join(f'<div class="x"><a href="/{k}">Go {rnd.randint(1, 99)} there</a></div>' for k in range(rnd.randint(5, 12)))
    text = "".join(f'<div class="q">{b}</div>' for b in blocks)
    return (f'<div class="l">{links}</div><div class="c"><h1>Title of it</h1><div class="t">{text}</div></div>'
            f'<div class="r">{links}</div><div class="z"><div>© 2021</div><div>Imprint</div></div>')


def test_whole_table_equals_the_articles(spark):
    sf = "/root/testdata/sf0.1"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op12_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], article_of(pages[r["page_id"]]["html"]), len(r["text"]))


def test_ratios_alone_find_the_text():
    rnd = random.Random(2)
    for _ in range(30):
        blocks = [(SENT * rnd.randint(1, 4)).strip() for _ in range(rnd.randint(3, 9))]
        blocks[1] = "Short one."
        assert H.main_text(soup(rnd, blocks)) == "\n".join(["Title of it", *blocks])


def test_scores_by_path():
    path = np.array([0, 0, 0, 1, 1, 1, 2, 2])
    chars, marks = np.array([8, 9, 7, 200, 20, 300, 10, 12.0]), np.array([0, 0, 0, 6, 1, 9, 1, 0.0])
    score, share, n = H.path_scores(path, chars, marks, np.array([8, 9, 7, 0, 0, 20, 0, 0.0]))
    assert score[0] == 0 and share[0] == 1 and list(n) == [3, 3, 2]
    assert score[1] > 20 * score[2]


def test_named_parts_go():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p > b {{}}</style><meta name="x" content="</head>"></head>
<body class="has-sidebar comments-open"><header class="site-header"><h1>Site</h1><p>{SENT * 3}</p></header>
<div id="cookie-notice"><p>{SENT * 4}</p></div><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="mainContent"><aside><p>{SENT * 3}</p></aside>
<article class="post has-comments"><header><h1>Head</h1><p>By A</p></header><p title="a > b">One &lt;b&gt; &amp; two.
 {SENT}</p><script>document.write("<p>no</p>")</script><!-- <p>no</p> --><p>Short<br>line<p>Open <b>bold<p>next</b>
<div class="advert">{SENT * 5}</div><form action="/s"><p>{SENT}</p><input><select><option>x</select></form>
<ul><li>first<li>second <a href="/x">link</a></ul><table><tr><td>a<td>b<tr><td>c</table><blockquote>Said&nbsp;so</blockquote>
<footer>tags</footer></article>
<section id="comments"><article class="comment"><p>{SENT * 6}</p></article></section></div>
<div class="sidebar">{SENT * 9}</div><footer>&copy; x</footer></body></html>"""
    assert H.main_text(page).split("\n") == [
        "Head", "One <b> & two. " + SENT.strip(), "Short line", "Open bold", "next", "first", "second link", "a", "b", "c", "Said so"]


def test_form_around_the_page_and_header_around_the_article():
    assert H.main_text(f"<form><div><main><p>{SENT}</p></main></div></form>") == SENT.strip()
    assert H.main_text(f"<div class='header'><article><p>{SENT}</p></article></div>") == SENT.strip()
    assert H.main_text(f"<main><nav><a href='/'>x</a></nav><article><p>{SENT}</p></article><div class='more'><p>{SENT * 9}</p></div></main>") == SENT.strip()


def test_lists_of_links_inside_the_article_are_menus():
    links = "".join(f"<li><a href='/{k}'>Read {k}</a></li>" for k in range(5))
    assert H.main_text(f"<article><p>{SENT}</p><ul>{links}</ul><p>End.</p></article>") == SENT.strip() + "\nEnd."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>x", "x"), ("a < b and c > d", "a < b and c > d"),
    ("<nav>only a menu</nav>", ""), ("<script>never closed", ""), ("<!-- never closed <p>x</p>", ""), ("<p>one</p><a href='x", "one"),
    ("<p>a</p></div></p></span><p>b</p>", "a\nb"), ("<p>&#0;&#x41;&eacute;&nosuch;</p>", "�Aé&nosuch;"), ("<p>日本語。</p>", "日本語。"),
    ("<P CLASS=Foo>Big</P>", "Big"), ("<p>a<![CDATA[x]]>b</p>", "ab"), ("<p title=\"never closed>some text</p> <p>more</p>", "some text\nmore")])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


def test_long_and_hostile_pages_end():
    assert H.main_text("<div>" * 100_000 + "x.") == "x."
    assert len(H.main_text("<p>" + "word. " * 1_000_000)) == 5_999_999
    assert H.main_text("<a \"" * 20_000 + ">") is not None
    assert len(H.main_text("<article><p>a.</p></article>" * 20_000)) == 3 * 20_000 - 1


def test_rows(spark):
    rows = [(1, "u", "<p>One.</p>", "t", 5), (1, "u", "<p>One.</p>", "t", 5), (None, None, None, None, None), (3, None, "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    want = [(1, "u", "One.", 4), (1, "u", "One.", 4), (3, None, "", 0), (None, None, "", 0)]
    for df in (pages, pages.repartition(7)):
        assert sorted(map(tuple, H.extract(df).collect()), key=str) == want
    assert H.extract(pages.limit(0)).count() == 0
