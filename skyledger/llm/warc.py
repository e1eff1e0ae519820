"""WARC archives: a writer with revisit records, and a reader whose tasks split files at any byte.

Every record is a gzip member of its own. A reading task scans its byte range for the gzip magic,
takes a place for a member only if a WARC header can be decoded from it, and owns the records that
start inside its range, wherever they end.

The reader takes any archive of gzip members, with one record or several in each. Records of other kinds (warcinfo,
request, metadata and so on) are rows too, with their whole block as payload; what a record doesn't
say is null. A record is held whole by the task that owns it.

Defined results: a null html is an empty payload; a null id is written as an empty header value and
read as null; an empty file has no records; repeated rows give repeated records; an html of any length is one record; extra columns
are not read; an empty table gives no archives and no records.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
#: Bytes read at once while a task looks for members.
BLOCK = 4 << 20


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One WARC record as a gzip member."""
    head = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in [*headers, ("Content-Length", str(len(block)))]) + CRLF
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + block + CRLF + CRLF) + z.flush()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _said(page: int | None) -> str:
    return "" if page is None else str(page)


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def response(page: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    return member([("WARC-Type", "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", _said(page)), ("Content-Type", "application/http;msgtype=response")], _http(len(payload)) + payload)


def revisit(page: int | None, url: str | None, length: int, digest: str, first: int) -> bytes:
    """A revisit has the HTTP header of the full payload, not the payload."""
    return member([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page", str(first)), ("X-Page-Id", _said(page)), ("Content-Type", "application/http;msgtype=response")], _http(length))


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least_bytes: int = 100) -> DataFrame:
    """Writes archives below ``path`` (a URI all executors share) and returns their list (file, bytes, records).

    Payloads of at least ``least_bytes`` that are equal are stored once, in the record with the
    smallest id. Records are compressed before the shuffle that brings in what they refer to. Files
    of a task get their name only when complete, and those of a lost attempt are not in the list.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.col(url_col).cast("string").alias("url"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                out = defaultdict(list)
                for page, html, url in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns)):
                    payload = html.encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    for name, value in (("page_id", page), ("url", url), ("digest", digest), ("length", len(payload)), ("record", response(page, url, payload, digest))):
                        out[name].append(value)
                yield out

    records = common.map_batches(rows, full, "page_id long, url string, digest string, length long, record binary")
    # Digests are computed from the table by Spark's own function for the small side, so the records are not made twice.
    payload = F.encode("html", "UTF-8")
    firsts = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", F.sha2(payload, 256).alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    joined = records.join(firsts, "digest", "left")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        fs, base = _fs(path)
        out, n, size = None, 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                for digest, page, url, length, record, first in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns)):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}.open")
                    raw = revisit(page, url, length, digest, first) if first is not None and page != first else record
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            fs.move(f"{base}/{name}.open", f"{base}/{name}")
            yield {"file": [f"{path}/{name}"], "bytes": [size], "records": [n]}

    return common.saved(common.map_batches(joined.select("digest", "page_id", "url", "length", "record", "first"), archive, "file string, bytes long, records long"), "warc-list")


def _headers(raw: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that starts with a space or tab goes on with the one before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw).decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def _number(said: str | None) -> int | None:
    return int(said) if said and re.fullmatch(r"-?[0-9]+", said) else None


def fields(head: dict[str, str], block: bytes) -> dict:
    """The row of a record. Only HTTP messages have a header before their payload; a revisit says how long its payload was, and its digest, if at all."""
    kind = head.get("warc-type", "").lower() or None
    http, payload = b"", block
    if block.startswith(b"HTTP/") or head.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(CRLF + CRLF)
    length, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if kind == "revisit":
        name, _, said = head.get("warc-payload-digest", "").partition(":")
        length, digest, payload = _number(_headers(http).get("content-length")), said.lower() if name.lower() in ("sha256", "sha-256") and re.fullmatch("[0-9a-fA-F]{64}", said) else None, None
    return {"page_id": _number(head.get("x-page-id")), "url": head.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": _number(head.get("x-refers-to-page")), "payload": payload}


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a member's bytes; one without a length takes the rest."""
    while data.startswith(b"WARC/1."):
        head, sep, rest = data.partition(CRLF + CRLF)
        if not sep:
            return
        headers = _headers(head)
        length = _number(headers.get("content-length"))
        if length is None:
            yield headers, rest.removesuffix(CRLF + CRLF)
            return
        yield headers, rest[:length]
        data = rest[length:].lstrip(CRLF)


def read_member(f, at: int) -> tuple[int, list[tuple[dict[str, str], bytes]]] | None:
    """End and records of the member at a byte, or None if no WARC record starts there."""
    z = zlib.decompressobj(31)
    f.seek(at)
    chunks, end = [], at
    try:
        while not z.eof:
            raw = f.read(1 << 14)
            end += len(raw)
            if not raw:
                return None
            part = z.decompress(raw)
            if not chunks and part and not part.startswith(b"WARC/1."[: len(part)]):
                return None
            if part:
                chunks.append(part)
    except zlib.error:
        return None
    found = list(records(b"".join(chunks)))
    return (end - len(z.unused_data), found) if found else None


def members(f, start: int, end: int) -> Iterator[tuple[int, int, list[tuple[dict[str, str], bytes]]]]:
    """(first byte, end, records) of the members that start in [start, end) of an open file. One may lie inside a member that began before, if that stores an archive as it is."""
    at = start
    while at < end:
        f.seek(at)
        # Two bytes more, so that a magic across the border of two blocks is seen.
        block = f.read(min(BLOCK, end - at) + 2)
        k, done = block.find(MAGIC), 0
        while k >= 0 and at + k < end:
            if found := read_member(f, at + k):
                done = found[0] - at
                yield at + k, *found
            k = block.find(MAGIC, max(k + 1, done))
        at += max(1, len(block) - 2, done)


def splits(files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """(file, bytes, start, end), one row per byte range; empty files have none."""
    return files.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "bytes"))


def scan(files: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """Records of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A split may start inside a member that stores another archive and take that one's members for its
    own. Members follow each other, so one that starts before the end of an earlier one is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for file, _, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                fs, base = _fs(file)
                out = defaultdict(list)
                with fs.open_input_file(base) as f:
                    for at, until, found in members(f, start, end):
                        for head, block in found:
                            for k, v in (fields(head, block) | {"member_file": file, "member_start": at, "member_end": until}).items():
                                if k != "payload" or with_payload:
                                    out[k].append(v)
                        if len(out["page_id"]) >= 500:
                            yield out
                            out = defaultdict(list)
                if out:
                    yield out

    ranges = splits(files, split_bytes)
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    place = ["member_file", "member_start", "member_end"]
    rows = common.saved(common.map_batches(ranges.repartition(4 * n), run, f"{schema}, member_file string, member_start long, member_end long"), "warc-records")
    before = F.max("member_end").over(Window.partitionBy("member_file").orderBy("member_start").rangeBetween(Window.unboundedPreceding, -1))
    inner = rows.select(*place).distinct().withColumn("_before", before).filter("_before > member_start").select(*place[:2])
    inner = common.small_or_not(common.saved(inner, "warc-inner"))
    return rows.join(inner, place[:2], "left_anti").drop(*place)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back."""
    return scan(write(pages, common.scratch(spark, "warc")))
