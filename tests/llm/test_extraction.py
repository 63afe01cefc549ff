import re
import time
from html import unescape

import pytest

from gleaner.llm import extraction
from gleaner.llm.extraction import main_text

ARTICLE = "<p>The first paragraph tells what happened, when &amp; to whom.</p><p>The second <b>one</b> says why it did,<br>in two lines.</p><ul><li>And a list<li>of two</ul>"
TEXT = "The first paragraph tells what happened, when & to whom. The second one says why it did, in two lines. And a list of two"

AROUND = {
    "menu": "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>",
    "menu by class": "<div class='main-menu'><a href=/a>Home</a> <a href=/b>News</a></div>",
    "menu without a name": "<div><ul><li><a href=/a>Home page</a></li><li><a href=/b>News of today</a></li></ul></div>",
    "header": "<header><h2>The Daily Site</h2><p>All that is worth knowing, every day.</p></header>",
    "footer": "<footer><p>&copy; The Daily Site, all rights reserved, 12 Main Street.</p></footer>",
    "sidebar": "<aside><p>Most read: nothing of what you look for is here.</p></aside>",
    "sidebar by id": "<div id=sideBar><p>Most read: nothing of what you look for is here.</p></div>",
    "notice": "<div class='cookie-consent'><p>We use cookies to give you the best experience.</p><button>OK</button></div>",
    "advert": "<div class=ad>Buy two, get three. Only today and only here.</div>",
    "advert by role": "<section role=complementary><p>Buy two, get three. Only today and only here.</p></section>",
    "form": "<form action=/s><label>Your name</label><input name=n><select><option>one<option>two</select></form>",
    "script": "<script>var t = '</p><p>no text</p>';</script><style>p { margin: 0 }</style><noscript><p>Please enable scripts.</p></noscript>",
    "comments": "<div id=comments><h3>2 comments</h3><div class=comment><p>I do not think that any of this is so, and I have been there.</p></div></div>",
    "comment of the markup": "<!-- <p>not shown</p> -->",
}


@pytest.mark.parametrize("name", AROUND)
@pytest.mark.parametrize("frame", ["<article><h1>A title</h1>{}</article>", "<main><h1>A title</h1>{}</main>", "<div class=wrap><div class=body><h1>A title</h1>{}</div></div>"])
def test_what_is_around_goes(name, frame):
    page = frame.format(ARTICLE)
    for html in (AROUND[name] + page, page + AROUND[name], AROUND["menu"] + page + AROUND[name] + AROUND["footer"]):
        assert main_text(f"<!DOCTYPE html><html><head><title>Other</title></head><body>{html}</body></html>") == f"A title {TEXT}"


@pytest.mark.parametrize("name", [n for n in AROUND if n not in ("menu without a name", "header")])
def test_what_is_inside_goes(name):
    cut = ARTICLE.index("<ul>")
    assert main_text(f"<body><article>{ARTICLE[:cut]}{AROUND[name]}{ARTICLE[cut:]}</article></body>") == TEXT


def test_names_that_mislead():
    assert main_text(f"<div class='content with-sidebar'><div class='article-header'><h1>A title</h1></div><div>{ARTICLE}</div></div>") == f"A title {TEXT}"
    assert main_text(f"<div class='page has-comments'><article class='post category-ads'>{ARTICLE}</article></div>") == TEXT
    assert main_text(f"<form id=aspnet><div class=x>{ARTICLE}<p>Third.</p></div></form>") == f"{TEXT} Third."
    assert main_text(f"<main><article>{ARTICLE}</article><article class=comment><p>I have been there.</p></article></main>") == TEXT


def test_title_beside_the_path():
    assert main_text(f"<body><h1>A title</h1><div class=c>{ARTICLE}</div></body>") == f"A title {TEXT}"


def test_parts_of_one_article():
    parts = "".join(f"<div class=part><h2>Part {i}</h2><p>{'Some words of it. ' * 9}</p><p>{'More words of it. ' * 5}</p></div>" for i in range(3))
    got = main_text(f"<body><div class=menu><a href=/>x</a></div><div class=c>{parts}</div></body>")
    assert got == " ".join(f"Part {i} {('Some words of it. ' * 9).strip()} {('More words of it. ' * 5).strip()}" for i in range(3))


def test_broken_markup():
    assert main_text("<p>a < b and 1<2 <b>bold<p>next <!-- c <p> --> end<script>x</script> tail <script>unclosed <p>gone") == "a < b and 1<2 bold next end tail"
    assert main_text("<table><tr><td>one<td>two<tr><td>three</table></b></div> after") == "one two three after"
    assert main_text("<p title='a > b' class=\"x\">&lt;p&gt;&nbsp;&#233;&eacute &am;</p>") == "<p> éé &am;"
    assert main_text("ima<i>gin</i>e\t\n two") == "imagine two"


@pytest.mark.parametrize("html", ["<" * 50_000, "<a " * 50_000, "<div>" * 50_000, "<i>" * 50_000 + "</b>" * 50_000, "<a b=\"'" * 50_000, "<!--" * 50_000, "<p><b>" * 30_000, "x " * 2_000_000])
def test_odd_and_long_pages_take_linear_time(html):
    began = time.time()
    main_text(html)
    assert time.time() - began < 10


def test_pages(spark):
    long = f"<article><p>{'word ' * 200_000}</p></article>"
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p>t</p>", "x"), (5, "l", long, "x")]
    got = extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "t", 1), (5, "l", ("word " * 200_000).strip(), 999_999)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert extraction.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    from gleaner.llm.queries import op11_extraction

    html = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in op11_extraction(spark, "/root/testdata/sf0.01").collect():
        own = re.search("<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub("<[^>]*>", " ", own)).split()) and r["n_chars"] == len(r["text"])
