"""HTML extraction on typed pages and on the pages table."""

import html as H
import re

import pytest

from statloom.llm.html import extract, main_text

ART = "<article><h1>A title &amp; more</h1><p>First paragraph, with commas, and words.</p><p>Second <b>bold</b>\n  paragraph<br>goes on.</p></article>"
TEXT = "A title & more First paragraph, with commas, and words. Second bold paragraph goes on."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav>{ART}<footer>&copy; foot</footer></body></html>",
        f"<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><div id=\"sidebar\"><p>Side text, long, long, long text here.</p></div>{ART}<section class=comments><p>A comment, by a reader, of some length.</p></section><form><p>Search</p><input></form>",
        f"<body><div class=\"ad\">Buy this, now, please, it is good.</div><!-- <p>hidden</p> --><main>{ART}</main><aside><p>Aside text, with commas.</p></aside></body>",
        f"{ART}",
        ART.replace("</article>", ""),
    ],
)
def test_the_article_alone(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize(
    "wrapper",
    ["class='content no-sidebar'", "id='page' class='has-header'", "class='post comments-open'", "class='entry share-enabled'", "class='layout-sidebar'", "class='widget main'"],
)
def test_a_furniture_word_on_a_wrapper_does_not_cut_the_article(wrapper):
    menu = "<div class='sidebar'><article class='teaser'><p>Other text.</p></article></div><div class='post-comments'><p>A comment, of words.</p></div>"
    assert main_text(f"<body><div {wrapper}>{ART}</div>{menu}</body>") == TEXT
    assert main_text(f"<body><div {wrapper}>{ART.replace('article>', 'div>')}</div></body>") == TEXT
    assert main_text(f"<body><div {wrapper} style='display:none'>{ART}</div></body>") == ""


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_titles_leads_and_quotes_beside_the_best_container(around):
    long = "<p>" + "Long text, with commas, goes on and on. " * 8 + "</p>"
    page = f"<body><nav><a href='/'>Menu</a></nav><{around}><h1>Title</h1><p>Short lead.</p><div class='body'>{long * 3}</div><blockquote>A quote.</blockquote><pre>code</pre><h2>More</h2><div>{long * 3}</div><p>The end.</p></{around}></body>"
    got = main_text(page)
    assert got.startswith("Title Short lead. Long text,") and got.endswith("The end.") and "on. A quote. code More Long" in got
    assert "Menu" not in got and got.count("Long text") == 48


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_title_and_lead_before_the_body(around):
    long = "<p>" + "Long text, with commas, goes on and on. " * 8 + "</p>"
    got = main_text(f"<body><{around}><h1>Title</h1><p>Short lead.</p><div class='body'>{long * 3}</div><blockquote>A quote.</blockquote></{around}></body>")
    assert got.startswith("Title Short lead. Long text,") and got.endswith("on. A quote.")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p data-x=o'clock>One two.</p><p class=it's>Three.</p></article>", "One two. Three."),
        ("<article><p>A, a.</p><script>for(i=0;i<n;i++){} // don't</script><p>B, b.</p><style>p:before{content:\"<p>\"}</style><p>C.</p></article>", "A, a. B, b. C."),
        ("<article><p>A.</p><script>if (a<b) x = '</p>' </script ><p>B.</p><textarea><p>no</textarea></article>", "A. B."),
        (f"{ART}<article class='comment'><p>Reader's words, quite long, with commas, and more of them.</p></article>", TEXT),
        (f"<div class='comments'><article><p>Reader's words, quite long.</p></article></div>{ART}", TEXT),
        ("<article><p class='share-price'>Price 3.</p><div class='search-results'><p>Found, it was.</p></div><div class='entry-header'><h1>T</h1></div></article>", "Price 3. Found, it was. T"),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><div class='share-buttons'>Share this</div></article>", "So x=2 holds."),
        ("<article><p>a < b && c <3 d</p><!-- > --><p>x</p><!--><p>y</p><? php ?></ p><p>z</p></article>", "a < b && c <3 d x y z"),
        ("<form id=aspnet><nav>Menu</nav><article><header><h1>T</h1></header><p>Text.</p></article><p>Send</p></form>", "T Text."),
        ("<article><p>kept<p class='x", "kept"),
        ("<ARTICLE><P TITLE='a>b'>One</P><BR><IMG alt=\"<p>\"><p/>Two</ARTICLE>", "One Two"),
    ],
)
def test_tags_by_the_rules(page, want):
    assert main_text(f"<body>{page}") == want


def test_title_and_list_around_a_body_without_article():
    long = "<p>" + "Long text, with commas, goes on and on. " * 8 + "</p>"
    page = f"<div class='header'>Site</div><div class='entry'><div class='entry-header'><h1>Title</h1></div><div class='body'>{long * 3}</div><ul><li>one</li><li>two</li></ul></div><div class='footer'>Foot</div>"
    got = main_text(page)
    assert got.startswith("Title Long") and got.endswith("on. one two")


def test_a_page_laid_out_by_a_table():
    long = "Long text, with commas, goes on and on. " * 4
    page = f"<table><tr><td colspan=2><a href=/>Home</a> | <a href=/b>About</a></td></tr><tr><td width=9><a href=1>L1</a><br><a href=2>L2</a></td><td><h2>Old page</h2><p>{long}<p>{long}</td></tr><tr><td>Copyright</td></tr></table>"
    assert main_text(page) == f"Old page {long.strip()} {long.strip()}"
    assert main_text(f"<article><p>{long}</p><table><tr><td>a</td><td><p>b</p></td></tr></table></article>") == f"{long.strip()} a b"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<<<>>>")[:0] == ""
    assert main_text("<article><p>cut off &amp") == "cut off &"
    assert main_text("<article><p>one<p>two<ul><li>three<li>four</ul>") == "one two three four"
    assert len(main_text("<article>" + "<div>" * 5000 + "<p>deep</p>")) == 4
    assert main_text("<article><p>" + "long text, " * 50000 + "</p></article>").count("long") == 50000


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        want = [re.sub(r"\s+", " ", H.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b)))).strip() for b in blocks]
        assert got[r.page_id] == " ".join(x for x in want if x)


def test_rows_are_kept(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, ART, "y")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or -1, r.text) for r in extract(df).collect())
    assert got == [(-1, TEXT), (1, ""), (1, "")]
    assert extract(df.limit(0)).count() == 0


LONG = "The town kept its records with care, year after year, and much of what we know of it comes from these. Nobody counted them."


@pytest.mark.parametrize("name", ["commentlist", "comment-list", "commentbox", "comments", "reader-comments", "sharebar"])
def test_glued_names_of_furniture_go(name):
    page = f"<article><p>{LONG}</p><p>{LONG}</p><ol class='{name}'><li>What a lovely text, thank you all, says a reader of it, who then writes on and on about the town.</li></ol></article>"
    assert main_text(page) == f"{LONG} {LONG}"


@pytest.mark.parametrize("open_,close", [("<p class='social-history'>", "</p>"), ("<div class='related-work'><p>", "</p></div>"), ("<div class='footer-note'><p>", "</p></div>")])
def test_names_that_are_only_about_furniture_stay_in_an_article(open_, close):
    other = "Prices of paper rose in those years, for reasons that were told in two chapters before this one, and fell again after the war."
    assert main_text(f"<article><p>{LONG}</p>{open_}{other}{close}<p>{LONG}</p></article>") == f"{LONG} {other} {LONG}"
    links = "<a href='/a'>One of our other fine articles about it</a> <a href='/b'>Another one that you may like as well as this</a> <a href='/c'>And a third one</a>"
    assert main_text(f"<article><p>{LONG}</p><div class='related-stories'>{links}</div><p>{LONG}</p></article>") == f"{LONG} {LONG}"


def test_of_equal_articles_the_first_is_given():
    assert main_text(f"<body><article><p>{LONG}</p></article><article><p>{LONG.upper()}</p></article></body>") == LONG
