import base64
import gzip
import hashlib
import io
import json
import os
import random
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import got

from glyphmill.llm import warc

HTML = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><!-- no --><p>Hi <b>there</b> &lt;you&gt;</p><a href='/x?a=1&amp;b=2'>go</a><script>var a;</script><img src=\"i.png\"><br>end</body></html>"


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data.encode()).digest()).decode()


def test_text_and_outline():
    assert warc.plain(HTML) == "Hi there <you>\ngo\nend"
    o = warc.outline(HTML)
    assert o["title"] == "A & B" and {"path": "A@/href", "url": "/x?a=1&b=2"} in o["links"] and {"path": "IMG@/src", "url": "i.png"} in o["links"]


def test_derivatives_refer_to_their_source():
    r = warc.response(7, "http://a/b", HTML)
    meta, conv = warc.derive(r)
    for d in (meta, conv):
        source = json.loads(d["headers"])
        assert d["refers_to"] == r["record_id"] == source["WARC-Record-ID"]
        assert source["WARC-Block-Digest"] == r["block_digest"] == sha(r["content"]) and source["WARC-Payload-Digest"] == r["payload_digest"] == sha(HTML)
        assert source["HTTP-Status"].endswith("200 OK") and "Content-Type" in source["HTTP-Headers"]
        assert d["block_digest"] == sha(d["content"]) and d["content_length"] == len(d["content"].encode())
    assert json.loads(meta["content"])["text_digest"] == conv["block_digest"] and conv["content"] == warc.plain(HTML)
    assert len({r["record_id"], meta["record_id"], conv["record_id"]}) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.text(alphabet="ab\r\n<>é&; WARC/1.0", max_size=60)), max_size=4))
def test_records_round_trip(pages):
    records = [warc.response(i, f"http://h/{i}", p) for i, p in pages]
    back = list(warc.unpack(b"".join(map(warc.pack, records))))
    assert back == records


def test_derived_files_keep_source_headers():
    source = warc.response(7, "http://a/b", HTML) | {"headers": json.dumps({"WARC-IP-Address": "192.0.2.1"})}
    first = next(warc.unpack(warc.pack(source).replace(b"X-Source-Headers: {\"WARC-IP-Address\": \"192.0.2.1\"}", b"WARC-IP-Address: 192.0.2.1")))
    assert first == source
    for d in warc.derive(first):
        data = warc.pack(d)
        assert next(warc.unpack(data)) == d
        head = data.partition(b"\r\n\r\n")[0].decode().split("\r\n")
        assert f"WARC-Refers-To: {source['record_id']}" in head
        own = json.loads(next(x for x in head if x.startswith("X-Source-Headers: ")).partition(": ")[2])
        assert own["WARC-Headers"] == {"WARC-IP-Address": "192.0.2.1"} and own["WARC-Payload-Digest"] == source["payload_digest"] and own["HTTP-Headers"]["Content-Type"].startswith("text/html")


def test_records_are_streamed():
    """A compressed file larger than what is held: one record at a time comes out before the rest is read."""

    class Counting(io.RawIOBase):
        def __init__(self, data):
            self.data, self.at = data, 0

        def readable(self):
            return True

        def readinto(self, into):
            part = self.data[self.at : self.at + min(len(into), 8192)]
            into[: len(part)] = part
            self.at += len(part)
            return len(part)

    data = b"".join(gzip.compress(warc.pack(warc.response(k, "u", random.Random(k).randbytes(20_000).hex()))) for k in range(40))
    f = Counting(data)
    seen = 0
    for k, r in enumerate(warc.records(f)):
        assert r["page_id"] == k and f.at < (k + 3) * len(data) / 40 + 200_000
        seen += 1
    assert seen == 40 and len(list(warc.records(Counting(data[:-30])))) == 39 and list(warc.records(Counting(b""))) == []


class Visible(HTMLParser):
    """The words of a page, by the library's own parser."""

    def __init__(self, page):
        super().__init__()
        self.hidden, self.out = 0, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "head")
        self.out.append(" " if tag in ("p", "div", "br", "li", "ul", "ol", "tr", "table", "article", "section", "header", "footer", "nav", "main", "body", "h1", "h2", "h3") else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template", "head")
        self.out.append(" " if tag in ("p", "div", "li", "ul", "ol", "tr", "table", "article", "section", "header", "footer", "nav", "main", "body", "h1", "h2", "h3") else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_broken_tails_end_a_file():
    data = warc.pack(warc.response(1, "u", "page")) + warc.pack(warc.response(2, "v", "page two"))
    assert [r["page_id"] for r in warc.unpack(data[:-9])] == [1]
    assert list(warc.unpack(b"no records")) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-apbscript =\"'&;\n", max_size=80))
def test_any_markup(page):
    assert isinstance(warc.plain(page), str)
    warc.derive(warc.response(None, None, page))


def pages(spark):
    rows = [(1, "http://a", HTML, "x", "z"), (1, "http://a", HTML, "x", "z"), (2, None, None, None, None), (None, "http://b", "", "y", "z"), (3, "http://c", "<p>" + "word " * 60_000, "y", "z"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, content string, headers string")


def test_awkward_rows(spark, tmp_path):
    df = pages(spark)
    out = warc.page_derivatives(df)
    assert out.count() == 2 * df.count()
    flat = lambda x: got(x.select(*(x[c].cast("string") for c in warc.NAMES)).fillna(""))
    assert flat(out) == flat(warc.derivatives(warc.responses(df)))
    ids = [r.record_id for r in out.filter("page_id = 1").collect()]
    assert len(ids) == 4 and len(set(ids)) == 2
    long = out.filter("page_id = 3 and record_type = 'conversion'").first()
    assert long.content == ("word " * 60_000).strip()
    assert warc.page_derivatives(df.limit(0)).count() == 0
    key = lambda x: got(x.select("record_id", "content", "block_digest").fillna(""))
    path = str(tmp_path / "w")
    assert sum(r.records for r in warc.write(out, path).collect()) == 12
    assert key(warc.read(spark, path)) == key(out)


def test_query_against_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no data")
    source = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = entry.queries()["op9_warc_derivatives"](spark, sf).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == sorted((k, t) for k in source for t in ("conversion", "metadata"))
    for r in rows:
        own = source[r.page_id]
        head = json.loads(r.headers)
        assert r.target_uri == own.url == head["WARC-Target-URI"] and r.refers_to == head["WARC-Record-ID"] and r.payload_digest == sha(own.html) == head["WARC-Payload-Digest"]
        assert r.block_digest == sha(r.content) and r.content_length == len(r.content.encode())
        if r.record_type == "conversion":
            assert r.content.split() == "".join(Visible(own.html).out).split()
    assert len({r.record_id for r in rows}) == len(rows) and len({r.refers_to for r in rows}) == len(source)
