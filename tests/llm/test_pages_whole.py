"""Main text of pages that are built without article elements, or whose markup is broken."""

from __future__ import annotations

import html
import re
import time

import duckdb
import pytest

from weftgraph.llm import queries
from weftgraph.llm.html_extract import extract, segments, window_sums

A, B, C = ("Alpha text of the page, long enough. " * 9).strip(), ("Beta goes on with it, a bit shorter. " * 3).strip(), ("Gamma ends the page's text at last. " * 3).strip()


@pytest.mark.parametrize("page", [
    f"<body><div>Site</div><nav>n</nav><div class=content><p>{A}</p><div class=ad>Buy</div><p>{B}</p><aside>x</aside><p>{C}</p></div><div class=footer>f</div></body>",
    f"<body><div><section><p>{A}</p></section><section><p>{B}</p></section><section><p>{C}</p></section></div></body>",
    f"<body><article><p>{A}</p></article><article><p>{B}</p></article><article>{C}</article></body>",
])
def test_no_part_is_dropped(page):
    assert extract(page) == f"{A} {B} {C}"


@pytest.mark.parametrize("page", [
    f"<body><div><p class=notice>Notice<p>{A}</p></div></body>",
    f"<body><div><ul><li class=ad>Buy<li>{A}</ul></div></body>",
    f"<body><article><div><p class=notice>Notice</div><p>{A}</p></article></body>",
    f"<body><article><svg viewBox='0' /><datalist><option value=a><option value=b></datalist><p>{A}</p></article></body>",
    f"<body><div class='content has-sidebar with-comments'><article><p>{A}</p></article><div class=comments>{B}</div></div></body>",
    f"<body><form><div class='with comments'><p>{A}</p><div class=comments>Nice</div></div></form></body>",
])
def test_skips_end(page):
    assert extract(page) == A


@pytest.mark.parametrize("piece", ['<div class="x ', "<a", "<p title='", "<!-- ", "<script>", "<div class=ad>x", "<div>", "<p a=", "</p", "<![CDATA[", "< ", "<div>" * 600 + "</p>x"])
def test_broken_markup_takes_linear_time(piece):
    times = []
    for size in (500_000, 2_000_000):
        began = time.process_time()
        extract(piece * (size // len(piece)))
        times.append(time.process_time() - began)
    assert times[1] < 8 * max(times[0], 0.1)


PROSE = "A story that goes on for more than eighty characters in one line, as stories surely do at times."


@pytest.mark.parametrize("page, text", [
    ("<article><p title=it's>one two</p><p>three's</p></article>", "one two three's"),
    ("".join(f"<div>{w}</div>" for w in "Home About Blog News Login".split()) + f"<p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><div>Contact us</div>", f"{PROSE} Short. {PROSE}"),
    (f"<article><p>{PROSE}</p><div class='notice-board search'>{PROSE}</div><p class=share>{PROSE}</p><p class=share>Tweet</p><p class=notice>{PROSE}</p></article>", " ".join([PROSE] * 3)),
    (f"<article><p>{PROSE}</p></article><article><p>Teaser</p></article><p>{PROSE}</p>", PROSE),
    (f"<div><h2>Title</h2><p>{PROSE}</p></div><div><p>one</p><p>two</p></div>", f"Title {PROSE}"),
    ("<article><p>a &amp; b &#233; &notit; 1 < 2</p><p>tail</article>", "a & b é ¬it; 1 < 2 tail"),
    ("text <b>only</b>", "text only"), ("<div", ""), ("<p>a</p", "a"), (None, ""), ("", ""),
])
def test_odd_pages(page, text):
    assert extract(page or "") == text


def test_sums_and_thresholds_decide():
    assert window_sums([1, 2, 3, 4], 3) == [6, 9, 7, 4]
    assert segments([0, 5, 5, 0, 0, 0, 50, 40, 0, 0, 0, 9], 3, 80) == [(6, 8)] and segments([0, 0, 3, 0, 2, 0, 0, 0, 5], 3) == [(2, 5), (8, 9)]


def plain_truth(page):
    """The one article of a generated page by another way: its text cut at block tags."""
    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article[1])]
    return " ".join(x for x in parts if x)


def test_query_against_the_articles_of_all_pages(spark):
    folder = "/root/testdata/sf0.01"
    want = {i: (u, plain_truth(h)) for i, u, h in duckdb.sql(f"select page_id, url, html from '{folder}/pages.parquet'").fetchall()}
    found = {r["page_id"]: (r["url"], r["text"]) for r in queries.op6_html_extraction(spark, folder).collect() if r["n_chars"] == len(r["text"])}
    assert found == want


def test_tables_without_rows_and_clashing_names(spark):
    from weftgraph.llm import html_extract

    pages = spark.createDataFrame([(1, "<p>x</p>", "c", "c", "c"), (1, "<p>x</p>", "c", "c", "c"), (None, None, None, None, None)], "page_id bigint, html string, text string, main string, path string")
    found = html_extract.extract_pages(pages)
    assert found.columns == ["page_id", "main", "path", "text"] and sorted(r["text"] for r in found.collect()) == ["", "x", "x"]
    assert html_extract.extract_pages(pages.where("false")).count() == 0
