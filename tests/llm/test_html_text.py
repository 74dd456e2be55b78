import re
from html import unescape

import pytest

from ctrkit.llm import html_text
from ctrkit.llm.html_text import main_text

LINE = "The article of the day is about the weather and it was told in the morning by a man from the town of old."


def test_pages_against_their_article(spark):
    """The given pages have one article element each; its text, tags taken out, is the expected text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def page(body, head=""):
    return f"<!doctype html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("junk", [
    "<nav><a href='/'>Home</a> <a>The news of the day</a></nav>", "<header><h1>The Site of the town</h1></header>",
    f"<footer>{LINE}</footer>", f"<aside><p>{LINE}</p></aside>", f"<div class='sidebar left'><p>{LINE}</p></div>",
    f"<div id=cookie-notice>{LINE}</div>", f"<div class=\"ad\">{LINE}</div>", f"<form><p>{LINE}</p><input></form>",
    f"<script>var x='<p>{LINE}</p>';</script>", f"<style>p::after{{content:'{LINE}'}}</style>", f"<!-- {LINE} -->",
    f"<section id='comments'><p>{LINE}</p></section>", f"<div hidden>{LINE}</div>", f"<noscript>{LINE}</noscript>"])
@pytest.mark.parametrize("wrap", ["<article><p>{0}</p><p>Short.</p><p>{0}</p></article>", "<div><p>{0}</p><p>Short.</p><p>{0}</p></div>"])
def test_boilerplate_goes_and_text_stays(junk, wrap):
    want = f"{LINE} Short. {LINE}"
    assert main_text(page(junk + wrap.format(LINE) + junk)) == want


def test_junk_inside_an_article_goes():
    assert main_text(page(f"<article><p>{LINE}</p><div class='advert'>{LINE}</div><p>End</p></article>")) == f"{LINE} End"


def test_references_space_and_broken_markup():
    assert main_text("<article><p>a &amp;amp; b&nbsp;&#39;c&#x27;\n\t d<b>e</b>f<br>g</article>") == "a &amp; b 'c' def g"
    assert main_text("<article><p><b>One<br><p>two</article><footer>no") == "One two"
    assert main_text("<article>kept <b") == "kept"
    assert main_text("<article>a < b and c > d</article>") == "a < b and c > d"
    assert main_text("") == "" and main_text("<p>") == ""


def test_page_without_article_short_lines_follow_their_neighbours():
    text = page(f"<div><p>Ad</p></div><ul><li><a>x y</a></li></ul><h2>Title</h2><p>{LINE}</p><p>Yes.</p><p>{LINE}</p><p>Tail</p>")
    assert main_text(text) == f"{LINE} Yes. {LINE}"


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>" + LINE + "</p>", "x"), (2, "v", "", "x"), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert [(r.text, r.n_chars) for r in got if r.page_id] == [("", 0)] * 3
    assert [r.text for r in got if r.page_id is None] == [LINE]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_main_text_outside_an_article_element_stays():
    teaser = "<article><a href='/x'>More of the news</a></article>"
    assert main_text(page(f"<div><p>{LINE}</p><p>Short.</p><p>{LINE}</p></div>{teaser}")) == f"{LINE} Short. {LINE}"


def test_boilerplate_neighbours_count_inside_an_article():
    ad = "<div class='advert'>Buy this now</div>"
    assert main_text(page(f"<article><p>{LINE}</p>{ad}<p>Notice</p>{ad}<p>{LINE}</p></article>")) == f"{LINE} {LINE}"


def test_text_in_a_language_without_listed_stop_words_stays(spark):
    lines = ["Hän oli jo ja se on nyt niin, ettei ole mitään, ja jos ei voi, se on ohi, ja hän oli jo pois.",
             "Ja se on nyt ohi, jos ei ole muuta, ja hän oli jo niin vanha, että se on jo ohi ja pois."]
    pages = spark.createDataFrame([(i, "u", page(f"<div><p>{t}</p></div>")) for i, t in enumerate(lines * 2)],
                                  "page_id long, url string, html string")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == sorted(lines * 2)


@pytest.mark.parametrize("html,want", [
    ("<article><p title=don't>P1</p><p>It's fine, P1</p><p>P3</p></article>", "P1 It's fine, P1 P3"),
    ("<article><p data-x='a\">P1</p><p>It's P2</p><p class=\"b>P3</p><p>P4</p></article>", "P1 It's P2 P3 P4"),
    ("<article><p title='a > b' data-y=\"<i>\">P1</p><p x = 'y'>P2</p></article>", "P1 P2"),
    ("<article><a href=\"x\"class='b'>it's</a> said</article>", "it's said")])
def test_stray_quotes_in_tags(html, want):
    assert main_text(html) == want


LONG = " ".join([LINE, LINE])


@pytest.mark.parametrize("tag", ["section id='related-work'", "div class='search-results-discussion'", "div class=related"])
def test_prose_overrules_weak_names_inside_an_article(tag):
    inner = f"<{tag}><h2>Title</h2><p>{LONG}</p></{tag.split()[0]}>"
    assert main_text(page(f"<article><p>{LINE}</p>{inner}<p>End</p></article>")) == f"{LINE} Title {LONG} End"
    teasers = f"<{tag}><h2>More</h2><p>Short.</p></{tag.split()[0]}>"
    assert main_text(page(f"<article><p>{LINE}</p>{teasers}<p>{LINE}</p></article>")) == f"{LINE} {LINE}"
    comments = f"<section id='comments'><p>{LONG}</p></section>"
    assert main_text(page(f"<article><p>{LINE}</p>{comments}</article>")) == LINE


def test_scripts_without_blanks():
    text = "昨日の朝、町の中央広場で新しい図書館が開館した。市長は挨拶の中で、建設に三年かかったと述べた。多くの人が列を作り、子供たちは本を手に取った。"
    menu = "会社概要採用情報問合先製品一覧店舗案内個人情報保護方針利用規約地図会員登録新着順位表価格表送料無料特集記事動画写真"
    assert main_text(page(f"<div><p>{menu}</p></div><div><p>{text}</p><p>{text}</p></div>")) == f"{text} {text}"


def test_stop_words_come_from_a_share_of_the_pages(spark):
    rows = [(f"<div><p>Ja se on nyt ohi {'sale' if i < 3 else 'niin'} {i}</p></div>",) for i in range(100)]
    words = html_text.stop_words_of(spark.createDataFrame(rows, "html string"))
    assert {"ja", "se", "nyt", "niin"} <= words and "sale" not in words
