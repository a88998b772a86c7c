"""Main text of pages and the content-addressed archive."""

import hashlib
import time
import uuid

import brute
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from metaloom.llm import html_extract, shared, warc

PARAGRAPH = "It was the first day of the long journey and all of them were ready to leave the old house by the sea, but the wind that came with the evening was too strong for the boats in the harbour."


def page(main, before="", after=""):
    return f"<html><head><title>T</title><style>p {{}}</style></head><body>{before}{main}{after}</body></html>"


POLISH = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, żeby porozmawiać o planach budowy nowego mostu, który ma połączyć obie części miasta i skrócić drogę do pracy."
CHINESE = "昨天晚上，市民们聚集在市政厅前，讨论新桥的建设计划。这座桥将连接城市的两个部分，并缩短上班的路程。"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News of the day and of the week</a></li></ul></nav>'
FOOTER = "<footer><p>Copyright 2024 by the owners of the site and all of their friends</p></footer>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page(f"<article><h1>A day</h1><p>{PARAGRAPH}</p><p>Yes.</p></article>", NAV, FOOTER), f"A day\n\n{PARAGRAPH}\n\nYes."),
        (page(f"<div><p>{PARAGRAPH}</p></div>", NAV, FOOTER), PARAGRAPH),
        (page(f"<p>{PARAGRAPH}</p><p>So it goes.</p><p>{PARAGRAPH} Again.</p>", NAV), f"{PARAGRAPH}\n\nSo it goes.\n\n{PARAGRAPH} Again."),
        (page(f"<article><p>{PARAGRAPH}</p></article>", after=f'<div class="comments"><p>{PARAGRAPH} I liked it.</p></div>'), PARAGRAPH),
        (page(f"<article><p>{PARAGRAPH}</p><aside><p>{PARAGRAPH} Buy.</p></aside><form><p>Your name</p></form></article>"), PARAGRAPH),
        (page(f"<article><p>{PARAGRAPH}</p></article>", '<div id="cookie-notice"><p>We use cookies and all of the rest of it to be of use.</p></div>'), PARAGRAPH),
        (page(f"<p>{PARAGRAPH}<script>if (a < b) x('<p>no</p>')</script></p><!-- <p>no</p> -->"), PARAGRAPH),
        (page("<article><p>Fish &amp; chips&nbsp;cost &#8364;5 &lt;now&gt;\n  and\tthen, so it is the same for all of them in the end.</p></article>"), "Fish & chips cost €5 <now> and then, so it is the same for all of them in the end."),
        (f"<p>{PARAGRAPH}", PARAGRAPH),  # never closed
        (f"<article><p>{PARAGRAPH}</p><p class='x", PARAGRAPH),  # cut off in a tag
        (f"<article><p>{PARAGRAPH}</p><!-- open", PARAGRAPH),
        (page(f'<div class="content no-sidebar"><p>{PARAGRAPH}</p></div>', NAV, FOOTER), PARAGRAPH),
        (f'<form id="aspnetForm">{NAV}<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><input name="a"></form>', f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        (f'<a name="top"><p>{PARAGRAPH}</p>', PARAGRAPH),
        (f'<div><a href="x">Open</div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>', f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        (page(f"<div><p>{POLISH}</p><p>{POLISH}</p></div>", NAV, FOOTER), f"{POLISH}\n\n{POLISH}"),
        (page(f"<form><p>{CHINESE}</p></form>", NAV, FOOTER), CHINESE),
        (f"<p>{PARAGRAPH}</p><pre>x = f(y); z = g(x); if z > 12 return else loop\n y = k(z) while true</pre><p>{PARAGRAPH}</p>", f"{PARAGRAPH}\n\nx = f(y); z = g(x); if z > 12 return else loop y = k(z) while true\n\n{PARAGRAPH}"),
        (page("", NAV, FOOTER), ""),
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<" * 50_000, ""),
        ("<a " * 20_000, ""),
        ("<div>" * 20_000, ""),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_stray_end_tags_take_no_time():
    start = time.perf_counter()
    assert html_extract.main_text("<div>" * 20_000 + "</section>" * 20_000 + f"<p>{PARAGRAPH}</p>") == PARAGRAPH
    assert time.perf_counter() - start < 3


COMMENTS = f'<div id="comments" class="comments-area"><article class="comment-body"><p>{PARAGRAPH} I liked it.</p></article><article><p>{PARAGRAPH} So did I.</p></article></div>'
ASIDES = f'<div class="promo"><p>{PARAGRAPH} Buy it.</p></div>'


@pytest.mark.parametrize("opens", ['<div class="content-sidebar-wrap">', '<div class="no-sidebar">', '<div class="sidebar">', '<div id="page" class="has-notice related-post">', '<form id="aspnetForm">', '<div role="form">', '<form><div class="widget">', '<body class="comments-open"><form>'])
@pytest.mark.parametrize("part", ["main", "article", "div"])
def test_wrappers_with_telling_names_exclude_nothing(opens, part):
    closes = "".join(f"</{x.split()[0].strip('>')}>" for x in reversed(opens.split("<")[1:]))
    inside = f"<{part}><h1>A day</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH} Again.</p><p>{PARAGRAPH} And again.</p></{part}>"
    text = f"A day\n\n{PARAGRAPH}\n\n{PARAGRAPH} Again.\n\n{PARAGRAPH} And again."
    assert html_extract.main_text(page(f"{opens}{NAV}{inside}{ASIDES}{COMMENTS}{closes}", after=FOOTER)) == text


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "comment-list", "siteFooter", "x related", "widget_2"])
def test_whole_names_exclude(name):
    inside = f'<p>{PARAGRAPH}</p><div class="{name}"><p>It is not a part of the text, but one of the things that are around all of it.</p></div>'
    assert html_extract.main_text(page(f"<article>{inside}</article>")) == html_extract.main_text(page(f"<div>{inside}</div>")) == PARAGRAPH


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p>One</p><svg class="i"/><p>Two</p><p>Three</p>', "One\n\nTwo\n\nThree"),
        ('<p>One</p><svg data-x="a>b" /><p>Two</p><svg><text>No</text></SVG ><p>Three</p>', "One\n\nTwo\n\nThree"),
        ('<p>One</p><svg class="i"><p>Two</p><svg><p>Three</p>', "One\n\nTwo\n\nThree"),  # never closed
        ("<p>One</p><svg-icon></svg-icon><style-guide></style-guide><p>Two</p>", "One\n\nTwo"),
        ("<p>One</p><math/><p>Two</p>", "One\n\nTwo"),
        ("<p>It is <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p><p>Two</p>", "It is x=1 here.\n\nTwo"),
        ("<p>It is <math><semantics><mi>x</mi><annotation>x_1</annotation></semantics></math>.</p>", "It is x x_1 ."),
        ("<p>One</p><script/><p>No</p>", "One"),  # a script is never empty
    ],
)
def test_drawings_and_formulas_take_no_text_with_them(html, text):
    assert html_extract.main_text(html) == html_extract.main_text(f"<article>{html}</article>") == text


@pytest.mark.parametrize("name", ["user-comments", "userComments", "sidebar-left", "ad-slot", "post-comments", "comment-text", "related-posts", "left_sidebar", "AdSlot", "site-navigation-top"])
def test_compound_names_exclude_by_their_head(name):
    html = page(f'<article><p>{PARAGRAPH}</p><div class="x {name}"><p>{PARAGRAPH} Not this.</p></div><p>{PARAGRAPH} On.</p></article>')
    assert html_extract.main_text(html) == f"{PARAGRAPH}\n\n{PARAGRAPH} On."


@pytest.mark.parametrize("name", ["with-sidebar", "has-sidebar", "nav-open", "content-sidebar-wrap", "comments-open", "elementor-widget", "elementor-widget-container", "no-sidebar", "address", "loading", "navy"])
def test_names_of_layouts_and_states_exclude_nothing(name):
    html = page(f'<article><p>{PARAGRAPH}</p><div class="{name}"><p>{PARAGRAPH} This too.</p></div><p>{PARAGRAPH} On.</p></article>')
    assert html_extract.main_text(html) == f"{PARAGRAPH}\n\n{PARAGRAPH} This too.\n\n{PARAGRAPH} On."


def test_drawings_that_never_end_are_looked_for_once():
    assert html_extract.main_text("<p>One</p>" + "<svg>" * 50_000) == "One"


def test_an_advert_longer_than_a_short_article_stays_out():
    assert html_extract.main_text(page("<article><h1>A day</h1><p>It was the first day of it.</p></article>", '<div class="ad">It is the best of all of them and it is for you, so buy one of it for the house.</div>')) == "A day\n\nIt was the first day of it."


def test_a_page_of_comments_alone_is_text():
    assert html_extract.main_text(page(f'<div class="comments"><p>{PARAGRAPH}</p><p>{PARAGRAPH} Again.</p></div>', NAV, FOOTER)) == f"{PARAGRAPH}\n\n{PARAGRAPH} Again."


def test_a_very_long_page_is_read_whole():
    many = [f"{PARAGRAPH} Number {i}." for i in range(3000)]
    assert html_extract.main_text(page("<article>" + "".join(f"<p>{x}</p>" for x in many) + "</article>", NAV, FOOTER)) == "\n\n".join(many)


def test_short_blocks_take_their_neighbours_label():
    b = [html_extract.Block(t, 0, False, 0, never) for t, never in ((PARAGRAPH * 2, False), ("Near.", False), ("between", False), ("menu", True), ("far", False), ("menu", True))]
    assert html_extract.labels(b) == [True, True, False, False, False, False]  # of equal distance to both: with the text before it


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", page(f"<article><p>{PARAGRAPH}</p></article>"), "x"), (3, "u", page(f"<article><p>{PARAGRAPH}</p></article>"), "x"), (None, "u", PARAGRAPH, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r["page_id"], r["n_chars"]) for r in got.collect()), key=repr) == [(1, 0), (2, 0), (3, len(PARAGRAPH)), (3, len(PARAGRAPH)), (None, len(PARAGRAPH))]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_pages_of_the_smallest_table(spark):
    got = html_extract.op2(spark, brute.SF).collect()
    assert len(got) == spark.read.parquet(f"{brute.SF}/pages.parquet").count()
    assert sum(r["n_chars"] > 0 for r in got) > 0.9 * len(got)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        for block in r["text"].split("\n\n") if r["text"] else ():
            assert block == " ".join(block.split()) != ""


# --- archive ---------------------------------------------------------------------------------------------------

BIG = "x" * 1000
PAGES = [(1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (3, None, BIG[1:]), (4, "c", BIG[1:]), (5, "d", None), (6, "e", ""), (7, "f", "é" * 500), (None, "g", BIG), (9, "h", BIG), (9, "h", BIG)]


@pytest.fixture
def archive(spark):
    pages = spark.createDataFrame([(*r, b"z", "q") for r in PAGES], "page_id bigint, url string, html string, digest binary, header string")
    return warc.write_archive(pages, f"{shared.shared_dir(spark)}/warc-test-{uuid.uuid4().hex}")


def test_archive_stores_each_payload_once_and_gives_records_back(spark, archive):
    stored = spark.read.parquet(archive.payloads).collect()
    assert sorted(r["digest"] for r in stored) == sorted({hashlib.sha256((h or "").encode()).digest() for _, _, h in PAGES})
    records = warc.read_records(spark, archive).collect()
    assert len(records) == len(PAGES)
    text = {p: (u, (h or "").encode()) for p, u, h in PAGES}
    kinds = {}
    for r in records:
        url, body = text[r["page_id"]]
        head = bytes(r["header"]).decode()
        kinds.setdefault(r["page_id"], set()).add("revisit" if "WARC-Type: revisit\r\n" in head else "response")
        assert head.startswith("WARC/1.1\r\n") and head.endswith("\r\n\r\n")
        assert f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n" in head
        assert ("WARC-Target-URI" in head) == (url is not None) and "\r\nX: y" not in head
        if r["payload"] is not None:
            assert bytes(r["payload"]) == body
        size = 0 if r["payload"] is None else len(body)
        assert f"\r\nContent-Length: {size}\r\n" in head
        assert bytes(r["record"]) == bytes(r["header"]) + (b"" if r["payload"] is None else body) + b"\r\n\r\n"
    assert kinds == {1: {"revisit"}, 2: {"revisit"}, 3: {"response"}, 4: {"response"}, 5: {"response"}, 6: {"response"}, 7: {"response"}, None: {"revisit"}, 9: {"response"}}


def test_a_damaged_payload_is_an_error(spark, archive):
    bad = spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit(b"!")))
    other = f"{archive.payloads}-bad"
    bad.write.parquet(other)
    with pytest.raises(PySparkException, match="damaged"):
        warc.read_records(spark, archive._replace(payloads=other)).collect()


def test_archive_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    made = warc.write_archive(pages, f"{shared.shared_dir(spark)}/warc-test-{uuid.uuid4().hex}")
    assert warc.read_records(spark, made).count() == 0


def test_every_page_comes_back_whole(spark, archive):
    got = warc.read_pages(spark, archive)
    assert sorted(((r["page_id"], bytes(r["payload"])) for r in got.collect()), key=repr) == sorted(((p, (h or "").encode()) for p, _, h in PAGES), key=repr)
    spark.read.parquet(archive.payloads).filter(F.octet_length("payload") < 1000).write.parquet(f"{archive.payloads}-less")
    with pytest.raises(PySparkException, match="missing or damaged"):
        warc.read_pages(spark, archive._replace(payloads=f"{archive.payloads}-less")).collect()
