"""Main text of pages: against the standard library's parser on real pages, and odd markup."""

import time
from html.parser import HTMLParser

import pytest

from meshloom.llm import html_text

PROSE = "This is a paragraph with a good many words in it, so that it counts as content of the page. " * 4


class Article(HTMLParser):
    """Text of the only article element, block by block; blocks are those of the table in html_text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        self.inside &= tag not in ("article", "footer")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_real_pages_give_their_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.add_main_text(pages).collect()}
    seen = 0
    for r in pages.collect():
        if r["html"].count("<article") != 1 or "</article>" not in r["html"] or "<aside" in r["html"]:
            continue
        parser = Article()
        parser.feed(r["html"])
        want = [" ".join(b.split()) for b in parser.blocks]
        assert got[r["page_id"]] == "\n\n".join(b for b in want if b), r["page_id"]
        seen += 1
    assert seen > 10


def test_a_quote_inside_a_bare_value_or_unclosed_swallows_nothing():
    assert html_text.extract_text("<p title=it's>Alpha..</p><p>Beta isn't..</p><p>Gamma</p>") == "Alpha..\n\nBeta isn't..\n\nGamma"
    assert html_text.extract_text('<p>One</p><p title="open>Two</p><p>Three</p>') == "One\n\nTwo\n\nThree"
    assert html_text.extract_text("<p>One <a href=/x/>two</a> three</p>") == "One two three"


def test_unlucky_names_inside_an_article_stay_and_what_stands_beside_goes():
    inside = f"<section id='toc-related-work'><p>Related. {PROSE}</p></section><section class=search><p>Searching. {PROSE}</p></section><div id=comment-theory><p>Ours.</p></div>"
    outside = f"<div class='share-buttons'>Tweet this</div><div id=comments><p>{PROSE}</p></div><div class='ad-box'><p>Buy {PROSE}</p></div>"
    page = f"<html><head><title>t<body><div class=menu-main><a href=1>one</a></div><article><h1>T</h1><p>{PROSE}</p>{inside}{outside}</article><div class=sidebar><p>{PROSE}</p></div></body>"
    assert html_text.extract_text(page).replace(PROSE.strip(), "PROSE").split("\n\n") == ["T", "PROSE", "Related. PROSE", "Searching. PROSE", "Ours."]


def test_a_page_whose_only_content_has_an_unlucky_name():
    page = f"<body><div id='search-results-with-sidebar'><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='related posts-about'><a href=1>x</a></div></body>"
    assert html_text.extract_text(page).replace(PROSE.strip(), "PROSE") == "T\n\nPROSE\n\nPROSE"


@pytest.mark.parametrize("part", ["<div>", "<b>", "<b></i>", "<ul><li><b>", "<div><p>", "<title>", '<p a="', "<table><tr><td>"])
def test_time_is_linear_in_the_depth(part):
    def seconds(n):
        start = time.perf_counter()
        assert html_text.extract_text(part * n + "x") in ("x", "")
        return time.perf_counter() - start

    seconds(100)
    assert seconds(24_000) < 40 * max(seconds(3_000), 0.02)


def test_clashing_columns_give_way(spark):
    df = spark.createDataFrame([(1, "<p>a b", "t", 5, "x")], "page_id long, html string, text string, n_chars int, _html string")
    out = html_text.add_main_text(df, keep=("page_id", "html", "text", "n_chars", "_html"))
    assert out.columns == ["page_id", "html", "_html", "text", "n_chars"] and tuple(out.first()) == (1, "<p>a b", "x", "a b", 3)


def _short(page):
    return html_text.extract_text(page).replace(PROSE.strip(), "PROSE").split("\n\n")


def test_readers_entries_go_wherever_they_stand():
    entries = "<p>First!</p><p>Nice text, I liked the part on words.</p>"
    assert _short(f"<body><article><h1>T</h1><p>{PROSE}</p><section class='user-comments'>{entries}</section></article></body>") == ["T", "PROSE"]
    assert _short(f"<body><div id=main><p>{PROSE}</p><p>{PROSE}</p></div><div class='discussion'>{entries}<p>{PROSE}</p></div></body>") == ["PROSE", "PROSE"]


def test_a_paragraph_of_the_content_stays_whatever_its_class():
    odd = "<p class='ad-hoc'>Ad hoc networks are nice.</p>"
    assert _short(f"<body><div id=main><p>{PROSE}</p>{odd}<p>{PROSE}</p></div></body>") == ["PROSE", "Ad hoc networks are nice.", "PROSE"]
    assert _short(f"<body><article><p>{PROSE}</p>{odd}</article></body>") == ["PROSE", "Ad hoc networks are nice."]


def test_unnamed_parts_beside_the_content_go_by_density():
    side = "<div><p>About us</p><p>We write texts.</p></div>"
    page = f"<body><div class=content><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>{side}<div>Copyright 2024 by us</div></body>"
    assert _short(page) == ["PROSE"] * 3
    assert _short(page.replace("div class=content", "div")) == ["PROSE"] * 3


def test_headings_and_repeated_parts_beside_the_densest_stay():
    long, part = f"<section><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></section>", "<section><h2>More</h2><p>Short.</p></section>"
    assert _short(f"<body><h1>T</h1>{long}{part}</body>") == ["T", "PROSE", "PROSE", "PROSE", "More", "Short."]
    div = f"<div class=part><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div class=part><p>Short.</p></div><div class=else><p>Aside.</p></div>"
    assert _short(f"<body>{div}</body>") == ["PROSE", "PROSE", "PROSE", "Short."]


def test_density_finds_the_article_without_the_class_words(spark, sf_dir, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    with_words = [html_text.extract_text(p) for p in pages]
    monkeypatch.setattr(html_text, "BESIDE_WORDS", frozenset())
    assert 10 * sum(a != html_text.extract_text(p) for a, p in zip(with_words, pages)) <= len(pages)
