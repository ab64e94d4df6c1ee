r"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

A response's two derivatives name it in ``WARC-Refers-To`` and carry its target and date on. The metadata record lists
the source's record headers and HTTP headers as they were, with the payload's digest, and links to the conversion by
``WARC-Concurrent-To``; the conversion holds the page's text, with digests of its own. Record identifiers follow from
the response's, so that a repeated task makes the same records.

Each response is derived where it is read: one Arrow pass without any exchange. :func:`write_files` packs records into
gzip members (a record each) of files of bounded size, and :func:`read_files` reads them in any order.

Defined results: a null payload is an empty one; a response that isn't HTML keeps its text if its type is text, and has
an empty conversion otherwise; broken markup is read as far as it goes; responses without an identifier get one from
their target and digest; responses without a date get the epoch's; line breaks within header values are percent-encoded, so that no value can add a header; payloads are
read without their transfer and content codings (chunked, gzip, deflate), as far as those are whole, and digested as they are then; repeated headers are kept, in order;
repeated responses give repeated derivatives; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path

VERSION, EPOCH = "WARC/1.1", "1970-01-01T00:00:00Z"
#: Records of a batch that a reader gives, at most.
READ_ROWS = 200
RECORD = "record_id string, type string, target_uri string, date string, refers_to string, headers string, content binary"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_DROPPED = re.compile(r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>|<!doctype[^>]*>")
_BLOCK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|title|head|body|html|blockquote|pre|hr|dd|dt|dl|form|main|aside|figure|figcaption|option|select|td|th)\b[^>]*>")
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")


def digest(raw: bytes) -> str:
    """A labelled SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    """The identifier of a record derived from another."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def plain_text(page: str) -> str:
    """A page's text: a line for each block, single blanks within."""
    text = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub(" ", page)))
    return "\n".join([line for x in html.unescape(text).split("\n") if (line := " ".join(x.split()))])


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers in order, payload) of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
    return status, pairs, body


def _unchunked(raw: bytes) -> bytes:
    """The data of a chunked body; what isn't chunked ends it."""
    out, at = [], 0
    while (end := raw.find(b"\r\n", at)) >= 0:
        try:
            size = int(raw[at:end].split(b";", 1)[0].strip() or b"0", 16)
        except ValueError:
            break
        if size <= 0:
            return b"".join(out)
        out.append(raw[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out else raw


def _inflated(raw: bytes, bits: tuple[int, ...]) -> bytes:
    """What a compressed body holds, as far as it is whole; the body itself if it isn't compressed."""
    for b in bits:
        machine = zlib.decompressobj(b)
        try:
            return machine.decompress(raw) + machine.flush()
        except zlib.error:
            continue
    return raw


def decoded(pairs: list[tuple[str, str]], body: bytes) -> bytes:
    """A body without its transfer and content codings."""
    value = lambda name: ",".join(v for k, v in pairs if k.lower() == name).lower()
    if "chunked" in value("transfer-encoding"):
        body = _unchunked(body)
    for coding in reversed([x.strip() for x in value("content-encoding").split(",")]):
        if coding in ("gzip", "x-gzip"):
            body = _inflated(body, (31,))
        elif coding == "deflate":
            body = _inflated(body, (15, -15))
    return body


def header_value(text: str) -> str:
    """A header's value on one line."""
    return text.replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00")


def serialise(kind: str, record_id: str, headers: list[tuple[str, str]], content: bytes) -> bytes:
    """A record as the format writes it."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {header_value(record_id)}", *(f"{header_value(k)}: {header_value(v)}" for k, v in headers), f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + content + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers in order, content) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        headers: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.append((name.strip(), value.strip()))
        yield headers, stream.read(int(next((v for k, v in headers if k.lower() == "content-length"), 0)))


def derive_one(record_id: str | None, target: str | None, date: str | None, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata and the conversion of a response, as rows of RECORD."""
    status, http, body = http_parts(block)
    payload = decoded(http, body)
    payload_digest = digest(payload)
    source = record_id or derived_id(f"{target}|{payload_digest}", "response")
    kind = next((v for k, v in http if k.lower() == "content-type"), "text/html").lower()
    charset = (re.search(r"charset=[\"']?([\w.:-]+)", kind) or [None, "utf-8"])[1]
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = plain_text(page) if "html" in kind else page if kind.startswith("text/") else ""
    content = text.encode("utf-8", "replace")
    meta_id, text_id = derived_id(source, "metadata"), derived_id(source, "conversion")
    date = date or EPOCH
    common = [("WARC-Target-URI", target or ""), ("WARC-Date", date), ("WARC-Refers-To", source)]
    envelope = {"source": {"WARC-Record-ID": source, "headers": headers}, "http": {"status": status, "headers": http}, "payload": {"digest": payload_digest, "length": len(payload)}, "conversion": {"WARC-Record-ID": text_id, "digest": digest(content), "length": len(content)}}
    about = json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace")
    made = [
        ("metadata", meta_id, [*common, ("WARC-Concurrent-To", text_id), ("WARC-Block-Digest", digest(about)), ("Content-Type", "application/json")], about),
        ("conversion", text_id, [*common, ("WARC-Block-Digest", digest(content)), ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", "text/plain; charset=utf-8")], content),
    ]
    return [(own, k, target, date, source, json.dumps(h), c) for k, own, h, c in made]


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for own, target, date, headers, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += derive_one(own, target, date, [tuple(x) for x in json.loads(headers or "[]")], content or b"")
            if len(out) >= 1_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def derivatives(records: DataFrame) -> DataFrame:
    """The derived records of the response records among ``records`` (columns of RECORD)."""
    return bounded_batches(records).filter("type = 'response'").select("record_id", "target_uri", "date", "headers", "content").mapInArrow(_derive, RECORD)


def responses_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stored pages as response records, with their number in the identifier."""
    body = F.encode(F.coalesce(F.col(f"`{page}`"), F.lit("")), "UTF-8")
    number = F.coalesce(F.col(f"`{page_id}`").cast("string"), F.lit("none"))
    hexed = F.sha2(F.concat(F.lit("page|"), number, F.lit("|"), F.coalesce(F.col(f"`{url}`"), F.lit(""))), 256)
    own = F.concat(F.lit("<urn:uuid:"), *[x for a, b, tail in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">")) for x in (F.substring(hexed, a, b), F.lit(tail))])
    head = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")), "UTF-8")
    headers = F.to_json(F.array(F.array(F.lit("Content-Type"), F.lit("application/http; msgtype=response")), F.array(F.lit("X-Page-Id"), number)))
    return pages.select(own.alias("record_id"), F.lit("response").alias("type"), F.col(f"`{url}`").alias("target_uri"), F.lit(date).alias("date"), F.lit(None).cast("string").alias("refers_to"), headers.alias("headers"), F.concat(head, body).alias("content"))


def _write(batches: Iterator[pa.RecordBatch], path: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(path)
    part, made = TaskContext.get().partitionId(), []
    parts: list[bytes] = []
    size = records = 0

    def flush() -> None:
        name = f"part-{part:08d}-{len(made):05d}.warc.gz"
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own, compression=None) as out:
            for p in parts:
                out.write(p)
        store.move(own, f"{root}/{name}")
        made.append((name, records))

    for batch in batches:
        for own, kind, target, date, refers, headers, content in zip(*(batch.column(k).to_pylist() for k in _NAMES), strict=True):
            pairs = [tuple(x) for x in json.loads(headers or "[]")]
            have = {k.lower() for k, _ in pairs}
            pairs = [(k, v) for k, v in (("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Refers-To", refers)) if v and k.lower() not in have] + pairs
            parts.append(gzip.compress(serialise(kind, own, pairs, content or b""), 6, mtime=0))
            size, records = size + len(parts[-1]), records + 1
            if size >= file_bytes:
                flush()
                parts, size, records = [], 0, 0
    if parts:
        flush()
    if made:
        names, counts = zip(*made, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], names=["file", "records"])


def write_files(records: DataFrame, path: str, file_bytes: int = 256 << 20) -> list[str]:
    """Write records (columns of RECORD) as ``.warc.gz`` files under ``path``; returns the files' names."""
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    return sorted(r.file for r in records.mapInArrow(functools.partial(_write, path=path, file_bytes=file_bytes), "file string, records long").collect())


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(path)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                rows: list[tuple] = []
                for headers, content in parse(stream):
                    rest = [[k, v] for k, v in headers if k not in ("WARC-Type", "WARC-Record-ID", "Content-Length")]
                    first = {k: v for k, v in reversed(headers)}
                    rows.append((first.get("WARC-Record-ID"), first.get("WARC-Type"), first.get("WARC-Target-URI"), first.get("WARC-Date"), first.get("WARC-Refers-To"), json.dumps(rest), content))
                    if len(rows) >= READ_ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "content" else pa.string()) for n, x in zip(_NAMES, zip(*rows, strict=True), strict=True)], names=_NAMES)


def read_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The records of ``.warc.gz`` files; each file is read in one task, as a stream."""
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return files.mapInArrow(functools.partial(_read, path=path), RECORD)


def written_and_read(records: DataFrame) -> DataFrame:
    """``records`` as files in a fresh shared folder, as read back."""
    path = shared_path(records.sparkSession, "warc-files")
    return read_files(records.sparkSession, path, write_files(records, path))


def linked(records: DataFrame) -> DataFrame:
    """A row for each derived record: what it is, what it refers to, and its digests, as its headers have them."""
    pairs = F.from_json("headers", "array<array<string>>")
    value = lambda name: F.get(F.filter("pairs", lambda p: F.get(p, 0) == name), 0)[1]
    text = F.decode("content", "UTF-8")
    return records.withColumn("pairs", pairs).select("record_id", "type", "target_uri", "date", "refers_to", value("WARC-Concurrent-To").alias("concurrent_to"), value("WARC-Block-Digest").alias("block_digest"), value("WARC-Source-Payload-Digest").alias("payload_digest"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content_sha256"), F.when(F.col("type") == "conversion", text).alias("text"))
