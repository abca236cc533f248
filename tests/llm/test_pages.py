"""WARC round trips and text extraction."""

import gzip
import hashlib
import io

import pytest

from locusframe.llm import html_text, warc
from locusframe.llm.common import new_path

PAGES = "page_id long, url string, html string, payload_bytes string"


def test_archives_give_back_what_was_written(spark):
    big, other = "<p>é</p>" * 40, "<p>x</p>" * 40
    rows = [(3, "http://a/b c", big), (1, "http://a/é\r\nX: y", big), (7, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (8, "u", other), (8, "u", other), (None, "u", other), (None, "u", "z" * 200)]
    path = new_path(spark, "warc-test")
    warc.write_pages(spark.createDataFrame([(*r, "clash") for r in rows], PAGES), path)
    got = warc.read_archives(spark, path)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    response = sorted(((r.page_id, bytes(r.payload).decode()) for r in got.where("warc_type = 'response'").collect()), key=key)
    assert response == sorted([(1, big), (2, "short"), (4, "short"), (5, ""), (6, ""), (8, other), (8, other), (None, "z" * 200)], key=key)
    revisits = {r.page_id: (r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_archives(spark, path, payload=False).where("warc_type = 'revisit'").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert revisits == {3: (1, 360, digest(big), None), 7: (1, 360, digest(big), None), None: (8, 320, digest(other), None)}
    plan = got.where("warc_type = 'revisit' and page_id in (3, 7)")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert {r.page_id for r in got.where("warc_type = 'revisit' and page_id in (3, 7)").collect()} == {3, 7}
    assert got.where("target_uri like 'http://a/%'").count() == 2


def test_empty_tables_and_compressed_archives(spark, tmp_path):
    path = new_path(spark, "warc-empty")
    warc.write_pages(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0
    record = warc._record({"warc_type": "response", "target_uri": "u", "payload_digest": "d", "payload_bytes": 5, "page_id": 1, "refers_to": None, "payload": b"a\r\n\r\nb"}, "2020-01-01T00:00:00Z")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    assert [bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path)).collect()] == [b"a\r\n\r\nb"] * 2
    with pytest.raises(ValueError):
        list(warc.records(__import__("io").BytesIO(b"junk\r\n")))


def test_broken_records_raise_and_digests_bear_a_label():
    records = lambda raw, **how: list(warc.records(io.BytesIO(raw), **how))
    record = warc._record({"warc_type": "response", "target_uri": "u", "payload_digest": "ab12", "payload_bytes": 4, "page_id": 1, "refers_to": None, "payload": b"body"}, "2020-01-01T00:00:00Z")
    assert b"WARC-Payload-Digest: sha256:ab12\r\n" in record and warc._value(records(record)[0][0], "payload_digest") == "ab12"
    for raw, how in ((record.replace(b"Content-Length: 7", b"X: 7").replace(b"\r\nContent-Length: ", b"\r\nY: "), {}), (record[:-8], {}), (record[:-8], {"payload": False}), (record[:-8], {"wanted": lambda h: False})):
        with pytest.raises(ValueError):
            records(raw, **how)


def test_a_very_long_payload_goes_round(spark):
    path, long = new_path(spark, "warc-long"), "<p>é</p>" * 2_000_000
    warc.write_pages(spark.createDataFrame([(1, "u", long, "c"), (2, "u", long, "c")], PAGES), path)
    got = {r.page_id: (r.warc_type, r.payload_bytes, r.n) for r in warc.read_archives(spark, path).selectExpr("page_id", "warc_type", "payload_bytes", "length(payload) as n").collect()}
    assert got == {1: ("response", 18_000_000, 18_000_000), 2: ("revisit", 18_000_000, 0)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<!-- <p>no</p> --><script>var a = "<p>no</p>";</script><div class="cookie-notice"><p>no</p></div><article><h1>Head &amp; &eacute;</h1><p>One<br>two   three</p><div class='ad'>no</div>
<p>Short.<p>1 &lt; 2 <b>bold</b> <form>no<input></form><blockquote>Quoted</blockquote><ul><li>item <a href="/y">link</a></li></ul><section class="comments"><p>no</p></section></article><aside>no</aside><footer>no</footer></body></html>"""


def test_the_article_is_kept_and_nothing_else(spark):
    want = "Head & é\nOne two three\nShort.\n1 < 2 bold\nQuoted\nitem link"
    assert html_text.extract(PAGE) == want
    rows = [(1, "u", PAGE, "c"), (2, "u", None, "c"), (3, "u", "", "c"), (4, "u", "<p>", "c"), (5, None, "<div>" + "<p>word word</p>" * 60_000, "c"), (1, "u", PAGE, "c")]
    got = html_text.extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert [r.text for r in got[:4]] == [want, "", "", ""] and got[4].n_chars == 60_000 * 10 - 1 and got[5].text == want
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_without_an_article_the_surge_is_kept():
    body = "".join(f"<p>{'Sentence of the text. ' * 8}</p>" for _ in range(5))
    page = f"<body><div id=menu><a href=a>a</a></div><div><a href=b>Just a link</a></div><div id=content><h2>Title</h2>{body}</div><div class=sidebar>side</div><footer>foot</footer></body>"
    got = html_text.extract(page).split("\n")
    assert len(got) >= 6 and "Title" in got and "side" not in got and "foot" not in got
    assert html_text.extract("<article><p>a</article><article><p>much longer text here</p>") == "much longer text here"
    assert html_text.extract("<div class=ad>x<article><p>kept</p></article>") == "kept"
