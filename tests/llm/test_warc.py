import base64
import gzip
import hashlib
import html
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenqc.llm import warc as w

PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One <b>two</b>&nbsp;three<br>four</p><a href="/z">link</a></body></html>'


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_are_linked_and_digested():
    source = w.response(7, "http://a.example/x", PAGE)
    head, block = w.parse(source)
    metadata, conversion = map(w.parse, w.derive(source))
    assert conversion[0]["warc-type"] == "conversion"
    assert metadata[0]["warc-type"] == "metadata"
    for h, b in (metadata, conversion):
        assert h["warc-refers-to"] == head["warc-record-id"]
        assert h["warc-target-uri"] == "http://a.example/x"
        assert h["warc-date"] == head["warc-date"]
        assert h["warc-block-digest"] == sha(b)
        assert int(h["content-length"]) == len(b)
    assert len({head["warc-record-id"], metadata[0]["warc-record-id"], conversion[0]["warc-record-id"]}) == 3
    assert head["warc-payload-digest"] == sha(PAGE.encode())
    assert conversion[1].decode() == "A & B\nOne two three\nfour\nlink"
    about = metadata[1].decode()
    for line in (f"source-warc-payload-digest: {sha(PAGE.encode())}", "http-content-type: text/html; charset=utf-8", "title: A & B", "outlink: /z"):
        assert line in about.split("\r\n")
    assert w.derive(conversion_bytes := w.derive(source)[1]) is None
    assert conversion_bytes == w.derive(source)[1]


def test_odd_rows_and_files(spark, tmp_path):
    rows = [(1, "http://a/", PAGE, "x"), (2, None, None, "x"), (3, "http://b/\r\nX: y", "<p>unclosed <script>", "x"), (1, "http://a/", PAGE, "x"), (4, "http://c/", "<p>" * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    made = w.derivatives(w.responses(pages)).collect()
    assert len(made) == 5
    assert {r.text_bytes for r in made if r.page_id == 2} == {0}
    assert len({r.conversion_id for r in made}) == 4
    derived = w.derivatives(w.responses(pages))
    files = w.write_files(derived, f"file://{tmp_path}/out").collect()
    assert sum(f.n_records for f in files) == 10
    data = b"".join(gzip.decompress((tmp_path / "out" / f.file).read_bytes()) for f in files)
    assert data.count(b"WARC/1.1\r\n") == 10
    assert w.derivatives(w.responses(pages.where("false"))).count() == 0


def by_expressions(page):
    """The plain text by whole expressions, one after the other: slow on hostile pages, simple on short ones."""
    page = re.sub(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)(?![a-zA-Z0-9:-])[^>]*>.*?(?:</\1\s*>|\Z)|</?head(?![a-zA-Z0-9:-])[^>]*>", " ", page, flags=re.I | re.S)
    page = re.sub(r"</?(?:p|div|br|li|h1|title|body|html)(?![a-zA-Z0-9:-])[^>]*>", "\n", page, flags=re.I)
    page = html.unescape(re.sub(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>", "", page))
    return "\n".join(x for x in (re.sub(r"[^\S\n]+", " ", line).strip() for line in page.split("\n")) if x)


PIECES = st.sampled_from(["<p>", "</p>", "<br/>", "<b x='1'>", "</b>", "<title>", "</title>", "<script a>", "</script >", "<style>", "</style>", "text ", "a&amp;b", "\n", "<!-- ", " -->", "<head>", "</head>", "<div class=q>", "&#65;", "&nbsp;", "3 < 4 ", "<!doctype x>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_plain_text_against_expressions(pieces):
    page = "".join(pieces)
    assert w.plain_text(page) == by_expressions(page)


def test_hostile_pages_take_linear_time():
    for x in ("<script ", "<a ", "<title>", "<a href=", "<!--", "</script", "<", "&#9", "&#0", "<p>"):
        began = time.process_time()
        w.derive(w.response(1, "u", x * (1_000_000 // len(x))))
        assert time.process_time() - began < 8, x
    assert w.unescaped("&#" + "9" * 6000 + "; &#" + "0" * 9000 + "65;") == "\ufffd A"


def test_query_against_brute_force(spark):
    rows = [(1, "http://a/  b", PAGE), (2, None, None), (3, "http://b/\r\nX: y", "<p>unclosed <script>"), (1, "http://a/  b", PAGE), (None, "http://c/", "<p>" * 50_000), (5, "http://d/", "<title>T</title><a href='x y'>z</a>\x00é")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, source_id string, key string")
    got = w.build(pages).collect()
    want = []
    for key, url, page in rows:
        payload = (page or "").encode()
        source = next(line for line in w.response(key, url, page).decode().split("\r\n") if line.startswith("WARC-Record-ID: "))[16:]
        want.append((key, source, re.sub("[\r\n]+", " ", url or ""), sha(payload), sha(by_expressions(page or "").encode()), by_expressions(page or "")))
    order = lambda x: str(x)
    assert sorted(((r.page_id, r.source_id, r.target_uri, r.payload_digest, r.conversion_digest, r.text) for r in got), key=order) == sorted(want, key=order)
    assert all(r.sound and r.metadata_digest == sha(r.about.encode()) and r.text_bytes == len(r.text.encode()) for r in got)
    assert len({r.metadata_id for r in got} | {r.conversion_id for r in got}) == 10
    assert {r.page_id: "source-warc-target-uri: http://a/  b\r\n" in r.about for r in got}[1]
    assert w.build(pages.where("false")).count() == 0
