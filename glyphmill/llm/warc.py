"""WARC records: reading, writing, and derivatives of responses.

From every response come two linked records: ``metadata`` (JSON on the source's
headers, title and links) and ``conversion`` (its plain text). Both refer to the
response by WARC-Refers-To and hold the source's headers and digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length long, headers string, content string"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
EPOCH = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6f1c1f0e-7a52-5a43-9a0c-2d0d5f6f5a11")

DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|aside|main|blockquote|pre|hr|dd|dt|dl|form|title|body|html)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?]?[a-zA-Z][^>]*>|<!doctype[^>]*>", re.I)
BLANKS, LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<(a|img|link|script|iframe)\b[^>]*?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record's id follows from its content, so a repeated task gives the same one."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(map(str, parts)))}>"


def plain(page: str) -> str:
    """The visible text of a page, one line a block."""
    s = DROP.sub(" ", page)
    s = TAG.sub("", BLOCK.sub("\n", s.replace("\n", " ")))
    if "&" in s:
        s = entities.unescape(s)
    return LINES.sub("\n", BLANKS.sub(" ", s)).strip()


def outline(page: str) -> dict:
    """Title and links of a page."""
    t = TITLE.search(page)
    links = [{"path": f"{m[1].upper()}@/{m[2].lower()}", "url": entities.unescape(m[3] or m[4] or m[5] or "")} for m in LINK.finditer(DROP.sub(lambda d: d[0] if d[0][:5].lower() == "<head" else " ", page))]
    return {"title": entities.unescape(t[1]).strip() if t else None, "links": links}


#: The field that holds the source's headers, as JSON, in a record that was made from another one.
SOURCE = "X-Source-Headers"
FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest", "WARC-Payload-Digest", "X-Page-ID", "Content-Length")


def pack(r: dict) -> bytes:
    """A record as its bytes in a WARC file."""
    body = r["content"].encode()
    values = (r["record_type"], r["record_id"], r.get("refers_to"), r.get("target_uri"), r["warc_date"], r["content_type"], r["block_digest"], r.get("payload_digest"), r.get("page_id"))
    head = [*zip(FIELDS, values), (SOURCE, r.get("headers"))]
    # no value may end its line
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in head if v is not None)
    return f"WARC/1.0\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def records(stream) -> Iterator[dict]:
    """The records of a WARC file that is open for reading, plain or compressed, one at a time. A broken tail ends it; a record without length is passed over.

    ``headers`` are the source's, where the record holds them, else those of its own named fields that have no column; null without any.
    """
    stream = io.BufferedReader(stream)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while (line := stream.readline()).strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip()] = v.strip()
            if not line:
                return
            low = {k.lower(): v for k, v in head.items()}
            if not low.get("content-length", "").isdigit():
                continue
            size = int(low["content-length"])
            body = stream.read(size)
            if len(body) < size:
                return
            page = low.get("x-page-id")
            known = {f.lower() for f in FIELDS}
            own = low.get(SOURCE.lower()) or json.dumps(rest, ensure_ascii=False, sort_keys=True) if (rest := {k: v for k, v in head.items() if k.lower() not in known}) else None
            yield {
                "page_id": int(page) if page and page.lstrip("-").isdigit() else None, "record_type": low.get("warc-type"), "record_id": low.get("warc-record-id"), "refers_to": low.get("warc-refers-to"), "target_uri": low.get("warc-target-uri"), "warc_date": low.get("warc-date"),
                "content_type": low.get("content-type"), "block_digest": low.get("warc-block-digest"), "payload_digest": low.get("warc-payload-digest"), "content_length": size, "headers": own, "content": body.decode("utf-8", "replace"),
            }
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def unpack(data: bytes) -> Iterator[dict]:
    """:func:`records` of the bytes of a file."""
    return records(io.BytesIO(data))


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def response(page_id: int | None, url: str | None, page: str | None, date: str = EPOCH) -> dict:
    """A page as the response record that a crawler would have written."""
    body = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    block = http + (page or "")
    return {
        "page_id": page_id, "record_type": "response", "record_id": record_id("response", page_id, url, digest(body)), "refers_to": None, "target_uri": url, "warc_date": date, "content_type": "application/http; msgtype=response",
        "block_digest": digest(block.encode()), "payload_digest": digest(body), "content_length": len(block.encode()), "headers": None, "content": block,
    }


def derive(r: dict) -> tuple[dict, dict]:
    """The metadata and the conversion record of a response."""
    head, split, page = r["content"].partition("\r\n\r\n")
    if not split or not head.startswith("HTTP/"):
        head, page = "", r["content"]
    status, *lines = head.split("\r\n")
    http = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}
    source = {"WARC-Record-ID": r["record_id"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["warc_date"], "WARC-Block-Digest": r["block_digest"], "WARC-Payload-Digest": r["payload_digest"], "HTTP-Status": status, "HTTP-Headers": http}
    if r.get("headers"):  # the response's further fields, as a file had them
        source["WARC-Headers"] = json.loads(r["headers"])
    headers = json.dumps(source, ensure_ascii=False, sort_keys=True)
    out = []
    text = plain(page)
    meta = json.dumps({"source": source} | outline(page) | {"text_digest": digest(text.encode())}, ensure_ascii=False, sort_keys=True)
    for kind, mime, content in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
        data = content.encode()
        out.append({
            "page_id": r["page_id"], "record_type": kind, "record_id": record_id(kind, r["record_id"], digest(data)), "refers_to": r["record_id"], "target_uri": r["target_uri"], "warc_date": r["warc_date"], "content_type": mime,
            "block_digest": digest(data), "payload_digest": r["payload_digest"], "content_length": len(data), "headers": headers, "content": content,
        })
    return out[0], out[1]


def batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "content_length": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in NAMES], NAMES)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = EPOCH) -> DataFrame:
    """Pages as response records. Null fields stay null; a null page is empty."""
    prepare(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 512):
                yield batch([response(*x, date) for x in zip(*(c.to_pylist() for c in b.slice(at, 512).columns))])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response, in one pass without a shuffle.

    Records of other types are left out. Null content is empty; a response
    without HTTP headers is taken as the page itself; repeated responses give
    repeated derivatives with equal ids; an empty table gives none.
    """
    prepare(records.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                rows = [d for r in b.slice(at, 256).to_pylist() for d in derive(r | {"content": r["content"] or ""})]
                yield batch(rows)

    need = ["page_id", "record_id", "target_uri", "warc_date", "block_digest", "payload_digest", "headers", "content"]
    return records.filter(records["record_type"] == "response").select(*(records[c] for c in need)).mapInArrow(run, RECORD)


def page_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = EPOCH) -> DataFrame:
    """:func:`derivatives` of :func:`responses`, fused so that the page crosses to Python once.

    Null ids and urls stay null; a null or empty page gives two records with empty content and no links; pages are read
    whole, however long; repeated rows give repeated records with equal ids; an empty table gives none. Other columns play no part.
    """
    prepare(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                yield batch([d for x in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)) for d in derive(response(*x, date))])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).mapInArrow(run, RECORD)


def write(records_: DataFrame, path: str) -> DataFrame:
    """Write ``path/part-*.warc.gz``, one member a record; returns (file, records).

    Names follow from the partition, and a file is moved into place when whole,
    so a repeated task replaces its own file. ``path`` is a folder or a URI that all workers reach. Fields that are
    null are left out, null content is empty, source headers stand in a field of their own; repeated rows are written
    as often; an empty partition gives an empty file.
    """
    prepare(records_.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = file_system(path)
        system.create_dir(folder, recursive=True)
        ctx = TaskContext.get()
        name = f"{folder}/part-{ctx.partitionId():05d}.warc.gz"
        n = 0
        with system.open_output_stream(tmp := f"{name}.{ctx.taskAttemptId()}", compression=None) as f:
            for b in it:
                for at in range(0, b.num_rows, 256):
                    for r in b.slice(at, 256).to_pylist():
                        f.write(gzip.compress(pack(r | {"content": r["content"] or ""}), 6, mtime=0))
                        n += 1
        system.move(tmp, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "records"])

    return records_.select(*(records_[n] for n in NAMES)).mapInArrow(run, "file string, records long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files below ``path``, by :func:`records`.

    A file is read as a stream, so only one record and the batch of at most 256 records or 16 MB that it is in are in memory, whatever the size
    of the file. Empty files have no records; a folder without WARC files gives an empty table.
    """
    prepare(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name in b.column(0).to_pylist():
                system, at = file_system(name)
                held, size = [], 0
                with system.open_input_file(at) as f:
                    for r in records(f):
                        held.append(r)
                        size += r["content_length"]
                        if len(held) == 256 or size > 1 << 24:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    # paths only: contents are opened where they are read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("path").rlike(r"\.warc(\.gz)?$")).select("path").mapInArrow(run, RECORD)
