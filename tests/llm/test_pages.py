import base64
import hashlib
import re
from html import unescape

from roadweave.llm import html, warc
from roadweave.llm.common import table

from .conftest import DATA

PAGES = "page_id bigint, url string, html string, text string, host string, digest string"
ODD_PAGES = [
    (1, "http://a.example/x y", "<p>One</p>"), (2, None, None), (3, "not an address", ""), (4, "http://a.example/2", "<p>One</p>"), (5, "http://b.example/", "one\r\n\r\ntwo"), (5, "http://b.example/", "one\r\n\r\ntwo"),
    (None, "http://c.example/", "<p>no id</p>"), (6, "http://c.example/", None), (7, "http://d.example/", "<div>" * 3000 + "deep" + "é" * 70_000), (8, "http://d.example/", "WARC/1.1\r\nContent-Length: 5\r\n\r\n\n\n"),
]


def odd_pages(spark, rows=ODD_PAGES):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[digest(h)] = min(first.get(digest(h), i), i)
    return first


def test_archives_of_a_table(spark):
    pages = table(spark, DATA, "pages")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    first = expected(rows)
    got = {r["page_id"]: r for r in warc.convert_pages(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        d, r = digest(h), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), d)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[d] == i else ("revisit", first[d]))


def test_archives_of_odd_pages(spark):
    got = warc.convert_pages(odd_pages(spark)).collect()
    assert len(got) == len(ODD_PAGES)
    by = {r["page_id"]: r for r in got}
    assert by[4]["refers_to"] == 1 and by[3]["refers_to"] == 2 and by[6]["refers_to"] == 2 and by[5]["record_type"] == "response" and by[None]["record_type"] == "response"
    assert by[8]["payload_digest"] == digest(ODD_PAGES[-1][2]) and by[7]["payload_bytes"] == len(ODD_PAGES[-2][2].encode())
    assert warc.convert_pages(odd_pages(spark, [])).count() == 0


def test_round_trip_of_payloads_and_both_versions(spark):
    pages = odd_pages(spark)
    for version in (1, 2):
        back = warc.read_arc(spark, warc.write_arc(pages, version))
        want = sorted((i or -1, (h or "").encode()) for i, _, h in ODD_PAGES)
        assert sorted((r["id"] or -1, bytes(r["payload"])) for r in back.collect()) == want
        small = warc.read_warc(spark, warc.write_warc(back, least_bytes=1000))
        assert {r["record_type"] for r in small.collect()} == {"response"}


def test_addresses_that_look_like_lines_of_the_format(spark):
    """Only a file's first record can be its version block."""
    rows = [(2, "http://a/x", "<p>1</p>"), (4, "filedesc://b/y", "<p>2</p>\nnot field names"), (6, "http://a/z", "<p>1</p>"), (8, "filedesc:", ""), (3, "filedesc://c", "<p>2</p>\nnot field names"), (5, "WARC/1.1", "warcinfo")]
    for some in (rows, rows[1:2], rows[3:5]):
        got = {r["page_id"]: r for r in warc.convert_pages(odd_pages(spark, some)).collect()}
        assert {i: r["payload_digest"] for i, r in got.items()} == {i: digest(h) for i, _, h in some}
    assert got[8]["record_type"] == "response"
    got = {r["page_id"]: r["refers_to"] for r in warc.convert_pages(odd_pages(spark, rows)).collect()}
    assert got == {2: None, 4: 3, 6: 2, 8: None, 3: None, 5: None}


def test_files_are_converted_as_their_records_are(spark):
    folder = warc.write_arc(odd_pages(spark), 2)
    told = lambda path: sorted(tuple(bytes(v) if isinstance(v, bytearray) else str(v) for v in r) for r in warc.read_warc(spark, path).collect())
    for least in (0, 10):
        assert told(warc.convert_arc(spark, folder, least_bytes=least)) == told(warc.write_warc(warc.read_arc(spark, folder), least))


def test_arc_records_by_field_names():
    one = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain 73\n1 0 o\nURL IP-address Archive-date Content-type Archive-length\n"
    body = one.split(b"\n", 1)[1]
    one = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain %d\n%s\nhttp://a/ 1.2.3.4 20010203040506 text/html 5\nhello\n" % (len(body), body)
    assert list(warc.arc_records(one)) == [({"URL": "http://a/", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html", "Archive-length": "5"}, b"hello")]


def test_articles_of_a_table(spark):
    pages = table(spark, DATA, "pages")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(unescape(re.sub(r"<[a-z/][^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
    assert {r["page_id"]: r["text"] for r in html.main_text(pages).collect()} == want


def test_odd_pages_have_texts(spark):
    rows = html.main_text(odd_pages(spark)).collect()
    assert len(rows) == len(ODD_PAGES)
    texts = sorted((r["page_id"] or -1, len(r["text"])) for r in rows)
    assert (2, 0) in texts and (3, 0) in texts and (1, 3) in texts and (7, 70_004) in texts
    assert html.main_text(odd_pages(spark, [])).count() == 0


LAYOUT = """<html><head><title>T</title></head><body><header><p>Site name and claim</p></header><nav><a href=/>Home</a></nav>
<div class="page p{n}"><div class="entry e{n}"><h2>Title {n}</h2><p>{text}</p><p>a &lt; b&nbsp;&amp;&#33;</p><form><p>Your mail <input></p></form>
<aside class="sidebar"><p>Other stories of the day that are read a lot</p></aside></div>
<div id="comments"><p>{comment}</p></div></div><p class="cookie-notice">We use cookies</p><footer><p>All rights</p></footer><script>var a = "<p>x</p>";</script></body></html>"""


def test_host_votes_beat_a_misleading_page(spark):
    body = "The story goes on with many words that tell what happened there. " * 4
    rows = [(n, "http://h.example/p", LAYOUT.format(n=n, text=body, comment="Nice. " * 300)) for n in range(5)]
    odd = '<html><body><div class="entry"><p>Short note.</p></div><div class="teasers"><p>' + "Something else that is much longer than the note itself. " * 9 + "</p></div></body></html>"
    rows.append((9, "http://h.example/q", odd.replace('<div class="entry">', '<div class="page p9"><div class="entry e9">').replace("note.</p></div>", "note.</p></div></div>")))
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for n in range(5):
        assert got[n] == f"Title {n} " + " ".join(body.split()) + " a < b &!"
    assert got[9] == "Short note."
