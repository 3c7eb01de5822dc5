"""WARC archives and HTML extraction."""

import gzip
import hashlib
import itertools

import duckdb
import pytest
from hypothesis import given, strategies as st

from histlake.llm import warc
from histlake.llm.common import scratch
from histlake.llm.html_extract import best_stretch, extract, main_text, weights
from histlake.llm.labelled_pages import filler, pages as labelled

LONG, BREAK = "<p>" + "x é " * 60 + "</p>", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 10
ROWS = [(5, "http://www.A.example.org/p?q=1", LONG), (2, "http://b.example.org/", LONG), (9, "http://a.example.org/p?q=1", LONG), (1, "not a url\twith tab", "short"), (3, None, "short"), (4, "http://[bad", None), (6, "http://a.example.org/p", ""), (7, "https://a.example.org:8443/p/", BREAK), (None, "http://c.example.org", LONG), (8, "http://c.example.org", "z" * 300_000), (8, "http://c.example.org", "z" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, record_type string, start int")


@pytest.fixture(scope="module")
def archives(pages):
    manifest = warc.write_archives(warc.with_types(pages), scratch(pages.sparkSession, "warc-test"))
    return manifest, warc.build_index(manifest)


def expected(rows):
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((x for x in by[h or ""] if x is not None), default=None)
        again = len(data) >= 100 and first is not None and i != first
        yield i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None


def test_types(pages):
    got = [(r.page_id, len(r.payload), r.payload_digest, r.record_type, r.refers_to) for r in warc.with_types(pages).collect()]
    assert sorted(got, key=str) == sorted(expected(ROWS), key=str)


def test_round_trip_by_index(pages, archives, monkeypatch):
    manifest, blocks = archives
    requests = manifest.selectExpr("translate(url_key, '\t\n', '  ') AS url_key", f"coalesce(page_id, {warc.NOBODY}) AS page").distinct()
    got = warc.read_records(warc.resolve(requests, blocks)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(expected(ROWS), key=str)
    html = {r.page_id: r.html for r in got}
    assert all(html[i] == ("" if i in (5, 9, None) else h or "") for i, _, h in ROWS)


def test_lookup(archives):
    index = warc.CaptureIndex(archives[1])
    found = index.lookup("http://www.a.example.org/p?q=1")
    assert [(h["x-page-id"], h["warc-type"], b.decode()) for h, b in found] == [("5", "revisit", LONG), ("9", "revisit", LONG)]
    assert all(h["warc-profile"].endswith("identical-payload-digest") and h["warc-refers-to-target-uri"] == "http://b.example.org/" for h, _ in found)
    assert [b for _, b in index.records("http://www.a.example.org/p?q=1")] == [b"", b""]
    assert index.lookup("http://b.example.org")[0][1].decode() == LONG and len(index.lookup("http://c.example.org/")) == 3
    assert index.lookup("http://nowhere.example.org") == [] and len(index.lookup("http://[bad")) == 1 and len(index.lookup("")) == 1


def test_many_blocks(pages, archives, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 2)
    blocks = warc.build_index(archives[0])
    assert blocks.count() >= 5 and len(warc.CaptureIndex(blocks).lookup("http://c.example.org")) == 3


def test_resolve_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 2)
    rows = [(8, "http://c.example.org", f"repeated {i}") for i in range(7)] + [(None, None, f"nobody {i}") for i in range(6)] + [(i, "http://d.example.org", f"page {i}") for i in range(5)]
    manifest = warc.write_archives(warc.with_types(spark.createDataFrame(rows, "page_id long, url string, html string")), scratch(spark, "warc-edges"))
    blocks = warc.build_index(manifest)
    assert blocks.count() >= 9
    requests = manifest.selectExpr("url_key", f"coalesce(page_id, {warc.NOBODY}) AS page").distinct()
    got = warc.read_records(warc.resolve(requests, blocks)).collect()
    assert sorted((r.page_id or -1, r.html) for r in got) == sorted((i or -1, h) for i, _, h in rows)
    absent = spark.createDataFrame([("a", 1), ("org,example,d)/", 99), ("zzz", 1)], "url_key string, page long")
    assert warc.resolve(absent, blocks).count() == 0


def test_many_rows_of_one_key(spark, monkeypatch):
    """As many records come back as went in, from several reading tasks."""
    monkeypatch.setattr(warc, "BLOCK_ROWS", 40)
    monkeypatch.setattr(warc, "READ_BYTES", 50_000)
    rows = spark.range(0, 10_000, 1, 4).selectExpr("if(id % 3 = 0, null, 7) AS page_id", "'http://one.example.org/' AS url", "concat('text ', id) AS html")
    manifest = warc.write_archives(warc.with_types(rows), scratch(spark, "warc-one-key"))
    requests = manifest.selectExpr("url_key", f"coalesce(page_id, {warc.NOBODY}) AS page").distinct()
    read = warc.read_records(warc.resolve(requests, warc.build_index(manifest)))
    assert read.select("html").distinct().count() == read.count() == 10_000 and read.rdd.getNumPartitions() > 4
    heads = [h["warc-record-id"] for h, _ in (warc.read_range(r.archive, r.start, r.size) for r in manifest.limit(50).collect())]
    assert len(set(heads)) == 50


def test_archives_are_gzip(archives):
    for name in {r.archive for r in archives[0].collect()}:
        text = gzip.open(name.removeprefix("file://")).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_damage():
    raw = warc.record(1, "http://x", b"abc", "d", "response", None)
    assert warc.parse(raw)[1] == b"abc"
    for bad in (raw[:-1], raw + b"x", b"HTTP" + raw):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_keys():
    assert warc.url_key("HTTPS://www2.A.example.org:443/x/?b=1") == "org,example,a)/x?b=1" and warc.url_key("http://h:81") == "h:81)/"


def test_warc_empty(pages):
    manifest = warc.write_archives(warc.with_types(pages.filter("false")), scratch(pages.sparkSession, "warc-none"))
    blocks = warc.build_index(manifest)
    assert manifest.count() == blocks.count() == 0 and warc.CaptureIndex(blocks).lookup("http://x") == []
    assert warc.read_records(warc.resolve(manifest.selectExpr("url_key", "page_id AS page"), blocks)).count() == 0


def test_warc_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = con.sql(warc.SQL)
    got = warc.op2_warc(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in got)


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_stretch(scores):
    a, b = best_stretch(scores)
    sums = [sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)]
    assert sum(scores[a:b]) == max([0, *sums])


@pytest.mark.parametrize(("before", "after"), [('<body class="has-sidebar">', "</body>"), ('<main class="more">', "</main>"), ('<article id="comment">', "</article>"), ('<div class="has-sidebar">', "</div>"), ('<div class="content-sidebar-wrap">', "</div>"), ('<html class="no-cookies"><body>', "</body></html>")])
def test_layout_names_keep_the_article(before, after):
    article = "".join(f"<p>Paragraph {i} tells at length, in whole sentences, what happened on that day and why.</p>" for i in range(8))
    plain = main_text(f"<body>{article}</body>")
    assert "Paragraph 7" in plain and main_text(before + article + after) == plain


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<script>for (i=0; i<n; i++) { x('</p>') }</script>", ""), ("", "<script>if (a<b) c()</script>"), ("<style>p<a{}</style >", ""), ('<body class="has-sidebar">', ""), ('<div class="content with-sidebar">', "</div>"), ('<article class="popular-science">', "</article>"),
        ('<main class="search-page">', "</main>"), ('<form id="aspnetForm" action="/">', "</form>"), ('<div class="modal">', "</div>"), ('<body id="nav">', "</body>"), ('<main class="comments">', "</main>"), ('<section class="related">', "</section>"),
    ],
)
def test_whole_page_boxes(before, after):
    article = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i} tells at length, in whole <a href='/x'>linked sentences</a>, what happened on that day and why.</p>" for i in range(8))
    plain = main_text(f"<body>{article}</body>")
    assert "Paragraph 7 tells at length, in whole linked sentences, what" in plain and main_text(before + article + after) == plain


BOILERPLATE = [("<nav><ul><li><a href='/'>home</a></li><li><a href='/b'>boil</a></li></ul></nav>", ""), ('<div class="cookie-notice"><p>boil boil boil</p></div>', ""), ("<header>boil</header>", "<footer>boil boil</footer>"), ("", '<div id="comments"><p>boil boil boil boil</p></div>'), ("", "<form><label>boil</label></form>"), ('<aside class="sidebar"><p>boil boil</p></aside>', '<div class="ad">boil boil</div>'), ('<div class="ad">boil</div>', '<p class="copyright">boil</p>')]


@pytest.mark.parametrize(("before", "after"), BOILERPLATE)
@pytest.mark.parametrize("hold", ["article", "main", "div", "section"])
def test_boilerplate_goes(before, after, hold):
    for n in (3, 30, 300):
        body = f"<h1>head line</h1><p>{filler(n)}</p>{after * (n > 30)}<p>{filler(n)}</p>"
        page = f"<html><head><title>t</title></head><body>{before}<{hold}>{body}</{hold}>{after}</body></html>"
        assert main_text(page) == f"head line {filler(n)} {filler(n)}"


@pytest.mark.parametrize("unit", ["<a ", "<", '<a "', "<a '\">", "<!-- ", "<script>", "<b>", "<![CDATA[", "<p class=x ", "&", "<a class   ", "</", "<i \"> <i '>"])
def test_a_megabyte_of_anything(unit):
    import time

    # Against a tenth of it, so that a slow machine doesn't count: what grows with the square takes a hundred times as long.
    def took(n):
        began = time.process_time()
        main_text(unit * (n // len(unit)) + "<p>x")
        return time.process_time() - began

    took(1000)
    assert took(1_000_000) < 40 * took(100_000) + 1


@pytest.mark.parametrize("i", range(0, 60, 3))
def test_labelled_page(i):
    parts = labelled()[i]
    assert main_text("".join(m for _, m in parts)) == main_text("<main>" + "".join(m for inside, m in parts if inside) + "</main>") != ""


def test_unlabelled_page():
    page = f'<div id="top-nav"><ul><li><a href="/">{filler(2)}</a></li></ul></div><div class="entry"><h1>Title &amp; more</h1><p>One <b>two</b>three\n four&nbsp;five {filler(20)}</p><div class="advert">Buy now</div><p>Last &lt;part&gt; {filler(20)}</p></div><section id="comments"><p>{filler(30)}</p></section><div class="footer-links">{filler(12)}</div>'
    assert main_text(page) == f"Title & more One twothree four five {filler(20)} Last <part> {filler(20)}"


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<script>x", ""), ("<style>p{}</style>", ""), ("a<br>b", "a b"), ("<!-- <p>no</p> -->yes", "yes"), ("<p>a<p>b", "a b"), ("&am &amp &#233;", "&am & é"), ("<" * 50, "<" * 50), ('<p title="a>b">c', "c"), ("<b>" * 3000 + "x" + "</i>" * 10, "x"), ("<![CDATA[z]]>", "z")])
def test_small_pages(html, text):
    assert main_text(html) == text


def test_weights():
    w = weights()
    assert w["word plain"] > 0 and all(v < 0 for f, v in w.items() if f[0] == "<" or (f.startswith("word ") and f != "word plain" and "wide" not in f))


def test_extract(spark, pages):
    got = extract(pages).collect()
    assert len(got) == len(ROWS) and all(r.n_chars == len(r.text) for r in got) and {r.url for r in got if r.page_id is None} == {"http://c.example.org"}
    assert extract(pages.filter("false")).count() == 0


def test_driver_pages_by_their_article(spark):
    """The article element's own text, block by block, is what extraction finds without being told of it."""
    import html as h
    import re

    def article(source):
        blocks = re.split(r"</?(?:p|h1|br)>", re.search(r"<article>(.*?)</article>", source, re.S).group(1))
        return " ".join(t for b in blocks if (t := " ".join(h.unescape(re.sub(r"<[^>]+>", "", b)).split())))

    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    assert [main_text(x) for (x,) in rows] == [article(x) for (x,) in rows]
