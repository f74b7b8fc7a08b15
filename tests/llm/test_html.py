"""Main text against pages whose article is known."""

import html
import re
import time
import tracemalloc

import pytest

from marginalia.llm import html_extraction
from marginalia.llm.html_extraction import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body>
<header><h1>Site</h1><p>A claim, and another, of the whole site.</p></header><nav><ul><li><a href=/a>Home</a><li><a href="/b">More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do. Accept?</p></div><div class="ad">Buy now, buy here.</div>
<article><h1>Title &amp; more</h1><p>First  paragraph,<br>with a <b>bold</b> word, and &lt;marks&gt;; it goes on.<p>Second one, unclosed, with text enough.
<form><p>Name, please: <input name=n></p></form><aside>A side note, not for the reader.</aside><ul><li>One item, short.</li><li>Two</li></ul>
<script>if (a < b) { x("</p>"); }</script><section id="comments"><p>Great article, thanks! Really, so good.</p></section></article>
<footer>&copy; all, 2020.</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == (
        "Title & more\n\nFirst paragraph, with a bold word, and <marks>; it goes on.\n\nSecond one, unclosed, with text enough."
        "\n\nOne item, short.\n\nTwo")


def test_content_found_by_path_ratios_alone():
    long = "A sentence, with marks; and a good deal of text that goes on, and on. "
    page = ("<body><table><tr><td><a href=x>Home</a></td><td><a href=y>About</a></td><td><a href=z>Help</a></td></tr></table>"
            f"<div><div><p>{long * 5}</p><p>{long * 4}</p><p>{long * 6}</p></div></div><div><span>Imprint</span></div>")
    assert main_text(page) == "\n\n".join((long * n).strip() for n in (5, 4, 6))


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<!-- only") == main_text("<script>x") == ""
    assert main_text("plain, text & more") == "plain, text & more"
    assert main_text("<article><p>One, two &am") == "One, two &am"
    assert main_text("<article><p>One, two.</p><p cla") == "One, two."
    assert main_text("<article><p>1 < 2, and a<b") == "1 < 2, and a"
    assert main_text("<article>" + "<p>a, b." * 5000).count("a, b.") == 5000


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in extract_main_text(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", page.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        r = found[page.page_id]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == page.url


def test_null_repeated_and_no_rows(spark):
    rows = [(None, None, None, 1), (1, "u", PAGE, 2), (1, "u", PAGE, 2), (2, None, "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    found = sorted((tuple(r) for r in extract_main_text(pages).collect()), key=repr)
    text = main_text(PAGE)
    assert found == sorted([(None, None, "", 0), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0)], key=repr)
    assert extract_main_text(pages.limit(0)).count() == 0


LONG = "A sentence, with marks; and a good deal of text that goes on, and on."


def test_attributes_by_name():
    page = f"""<article><p>{LONG} <a href="/hidden-gems">Gems, found.</a></p><p title="a hidden valley">{LONG}</p><p data-class="ad" x='id="ad"'>{LONG}</p>
<p hidden>Gone, one.</p><p class=ad>Gone, two.</p><p STYLE='x:y; display : none'>Gone.</p><p aria-hidden = true>Gone.</p><p id=x class="a ad b" id="c">Gone.</p></article>"""
    assert main_text(page) == f"{LONG} Gems, found.\n\n{LONG}\n\n{LONG}"


def test_whole_class_tokens():
    for name in ("overflow-hidden", "no-sidebar", "has-comments", "ad-hoc", "share-price", "research", "md:hidden"):
        assert main_text(f'<article><p>{LONG}</p><p class="x {name}">Kept, too.</p></article>') == f"{LONG}\n\nKept, too.", name
    for name in ("ad", "cookie-notice", "site-footer", "related_posts", "nav-2", "visually-hidden"):
        assert main_text(f'<article><p>{LONG}</p><p class="x {name}">Gone, this.</p></article>') == LONG, name


def test_wrappers_are_no_side_parts():
    side = f'<nav><p>{LONG}</p></nav><div class="sidebar"><p>Aside, really.</p></div>'
    article = f'<article><p>{LONG}</p><div id="comments"><p>{LONG * 9}</p></div><p>{LONG}</p></article>'
    for start, end in (('<div class="sidebar">', "</div>"), ("<form id=f>", "</form>"), ('<div hidden><div class="search main">', "</div></div>"),
                       ("<head><body>", "</body>"), ('<body style="display:none">', "</body>")):
        assert main_text(start + side + article + end) == f"{LONG}\n\n{LONG}", start
        assert main_text(f"{start}<div><p>{LONG * 2}</p><p>{LONG * 3}</p></div>{end}<p>Imprint</p>") == f"{LONG * 2}\n\n{LONG * 3}", start
    assert main_text(f'<main><p>{LONG}</p></main><div id="comments"><article><p>So good.</p></article></div><aside><article><p>More, here.</p></article></aside>') == LONG
    for start in ('<main><div class="search">', '<main>A, b.<div class="search">'):
        assert main_text(f"{start}{side}{article}</div></main>") == f"{LONG}\n\n{LONG}"
    assert main_text(f'<article><p>{LONG}</p><div id="comments"><article><p>So good.</p></article></div></article>') == LONG


def test_stray_quotes_in_mid_page():
    for tag in ("<p title=it's>", "<p it's>", "<p a=\"b\"'>", "<p 'x' \">", "<p title=\"never closed>", "<p a = 5\"6 b='c>d' >", "<p a='\"' b=\"'>\">", "</p'>", '<img alt="5" tall"><p>'):
        want = f"{LONG}\n\nBetween, all of it.\n\n{LONG}"
        assert main_text(f"<article><p>{LONG}</p>{tag}Between, all of it.</p><p>{LONG}</p></article>") == want, tag
    assert main_text(f"<article><p>{LONG}</p><p title=it's>It's, here.</p><p>{LONG}</p><p x=don't>Don't, go.</p></article>") == f"{LONG}\n\nIt's, here.\n\n{LONG}\n\nDon't, go."
    assert main_text(f"<article><p>{LONG}</p><p class='a' title=\"cut off") == LONG
    assert main_text("<article>" + "<p '>b, c.</p>" * 2000 + "<p>b, c.").count("b, c.") == 2001


def test_flat_scores_would_change_the_text(monkeypatch):
    """Without article, class or side tag only the ratios tell content from menus and imprint."""
    item = "".join(f"<div><a href=x{k}>Link {k}</a></div>" for k in range(12))
    page = (f"<body><div><div>{item}</div></div><div><div><h2>Title</h2><p>{LONG * 3}</p><p>{LONG * 2}</p><blockquote><p>Short quote</p></blockquote>"
            f"<ul><li>One</li><li>Two</li></ul><p>{LONG * 4}</p></div></div><table><tr><td>Imprint</td><td>Contact</td></tr></table>")
    want = "\n\n".join(["Title", LONG_TEXT(3), LONG_TEXT(2), "Short quote", "One", "Two", LONG_TEXT(4)])
    assert main_text(page) == want
    monkeypatch.setattr(html_extraction, "path_scores", lambda blocks: {n.path: 1.0 for _, n in blocks})
    flat = main_text(page)
    assert flat != want and "Link 3" in flat and "Imprint" in flat


def LONG_TEXT(n):
    return (LONG * n).strip()


def test_short_quotes_and_lists_stay():
    page = f"<div><h1>Title</h1><p>{LONG * 4}</p><blockquote><p>Short quote</p></blockquote><p>{LONG * 3}</p><ol><li>a</li></ol><p>{LONG}</p></div>"
    assert main_text(page) == "\n\n".join(["Title", LONG * 4, "Short quote", LONG * 3, "a", LONG])


@pytest.mark.parametrize("tag", ["div", "b", "p"])
def test_deeply_nested_tags(tag):
    n = 100_000
    tracemalloc.start()
    started = time.process_time()
    page = f"<{tag}>" * n + f"<p>{LONG}</p>" + f"x</{tag}>" * 1000 + f"</{tag}>" * n + "<i>" * 500 + "</b></p><p>" * 1000 + LONG
    assert LONG in main_text(page)
    assert time.process_time() - started < 60 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
