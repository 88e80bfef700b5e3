from __future__ import annotations

import html
import re
import time

import pytest

from broadsheaf.llm import html_blocks as H

from .helpers import SF

TREE = H.default_tree()
PAGES = {
    "plain": ("<body><article><h1>A &amp; B</h1><p>One\n two<br>three<p>Be.</article></body>", "A & B One two three Be."),
    "containers": ("<header class=site-header>Top</header><nav><a href=x>Home</a></nav><main><h1>Title</h1><p>Text with <a href=y>a link</a> and &lt;b&gt;.</p><aside>Side words</aside><form><label>Name</label></form><p>More.</p></main><section class='comments'><p>Great post, I really liked all of what you said here.</p></section><footer>c</footer>", "Title Text with a link and <b>. More."),
    "scripts": ('<article><script>var t="</p><p>no</p>";</script><style>p{}</style><p>Yes &eacute;&nbsp;é.</p><!-- <p>no</p> --><noscript>no</noscript></article>', "Yes é é."),
    "unclosed": ("<article><p>Kept text here.<!-- never ends <p>no</p>", "Kept text here."),
    "inside": ('<article><p>Words of the story.</p><div class="ad">Buy this now, it is very good.</div><div id="cookie-notice">We use cookies on this site.</div><ul class="related"><li>Other</li></ul><p>End of it.</p></article>', "Words of the story. End of it."),
    "no article": ("<div class=menu><a href=1>a</a> <a href=2>b</a></div><p>This page has no article element but rather long text that surely is the main text of it, with enough words.</p><div><a href=x>next</a> | <a href=y>prev</a></div>", "This page has no article element but rather long text that surely is the main text of it, with enough words."),
    "link list in the article": ("<article><p>Words of the story, some of them.</p><ul><li><a href=1>One</a></li><li><a href=2>Two more</a></li><li><a href=3>Three</a></li></ul><p>See <a href=x>this</a> too.</p></article>", "Words of the story, some of them. See this too."),
    "open head": ("<html><head><title>T</title><meta charset=utf-8><article><p>Text after a head that never ends.</p></article>", "Text after a head that never ends."),
    "names on small elements": ("<article><p>Words of the story.</p><p class=advert>Buy this.</p><ul><li class=comment>Nice one!<li>A point.</ul><h2 id=related>Other</h2><p>End.</p></article>", "Words of the story. A point. End."),
    "quotes": ("<article><p title='a > b'>One</p><p title=\"never ends>Two</p><p>Three</p></article>", "One Two Three"),
    "odd": ("<article>1 < 2 <p>a <3 b</p><button>no<p>Go</p><select><option>x</select></article>", "1 < 2 a <3 b no Go"),
    "none": ("<nav><a href=x>Home</a></nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert H.main_text(page, TREE) == want


def test_tree_learns_its_table():
    assert all(H.is_main(TREE, row[:-1]) == bool(row[-1]) for row in H.LABELLED)


def test_whole_table_against_the_article_element(spark):
    frame = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(frame).collect()}
    for r in frame.collect():
        inside = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", inside)).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_odd_rows(spark):
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", long, "x"), (3, "u", long, "x"), (None, "u", "<article>a</article>", "x"), (5, "u", "<" * 3000, "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6 and sorted(r["n_chars"] for r in got)[-2:] == [99999, 99999]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("piece", ["<a ", "<div", "<p \">", "<div class='x\" >", "<!-", "<button>", "<li><div>", "</span-x><div>", "<svg><a '>", "<p \"'>", "<![CDATA", "x<y "])
def test_time_follows_the_length_of_broken_pages(piece):
    began = time.process_time()
    H.main_text(piece * (1_000_000 // len(piece)), TREE)
    assert time.process_time() - began < 20


def test_very_long_pages():
    page = "<article>" + "<p>word one two</p>" * 270_000 + "</article>"
    assert len(page) > 5_000_000 and H.main_text(page, TREE) == " ".join(["word one two"] * 270_000)


def test_words_and_links_decide_without_flags():
    text, menu = " ".join(["word"] * 40), '<p><a href=x>one two</a></p>'
    page = f"<p>{text}</p>{menu}{menu}{menu}<p>{text}</p>"
    assert H.main_text(page, TREE) == f"{text} {text}"
    assert H.main_text(f"<article>{page}</article>", TREE) == f"{text} {text}"
