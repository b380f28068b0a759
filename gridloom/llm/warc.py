"""WARC archives with a two-level capture index.

Archives: each record is a gzip member of its own, so it can be read by
(file, offset, length). Of equal payloads one record is a response; the others
are revisit records that refer to it.

Index: capture lines `key file offset length` are sorted by key (URL with its
host reversed, then the page id) and cut into compressed blocks. Each index
file ends with a sparse directory that has the first key and the place of each
block; the first keys of the files form the level above. A lookup searches the
files' first keys, then the file's directory, then one block, and only then
reads the record's byte range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_uri

BLOCK_LINES = 512
MAGIC = b"GLCX0001"
LEVEL = 4


def reversed_host_key(url: str | None) -> str:
    """com,example,m)/path?query: lower-case host, labels reversed, no scheme, user, fragment or default port.

    A null url, or one that can't be split, gives its own text (spaces and
    control characters escaped).
    """
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(clean)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return clean
    if not host:
        return clean
    shown = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{shown}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{reversed_host_key(url)} {0 if page_id is None else page_id + (1 << 63) + 1:020d}"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict[str, Any]:
    """Headers of a record, its HTTP headers and its payload; raises on a broken record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "null") else int(text)


def _names(path: str, prefix: str) -> tuple[pafs.FileSystem, str, str, str]:
    from pyspark import TaskContext

    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    context = TaskContext.get()
    name = f"{prefix}-{context.partitionId():06d}"
    return fs, base, name, f"{base}/.{name}.{context.taskAttemptId()}"


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of (page_id, url, html); returns the capture lines (key, file, offset, length).

    Payloads of at least `least_bytes` that are equal are stored once, with the
    largest page_id; rows that repeat that page_id are responses too. A null
    html is an empty payload, a null page_id is smaller than any other; an empty
    table gives no files. Other columns are not read, whatever their names. A
    payload is one record, however long. Payloads are equal when their SHA-1,
    their length and a second hash are. Equal
    payloads are found by a count of digests with partial sums; only digests
    that occur twice join back, so a page that a third of all rows share is
    dealt over tasks by the skew join.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("n"), F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("second"))
    alike = ["digest", "n", "second"]
    shared = rows.where(F.col("n") >= least_bytes).groupBy(*alike).agg(F.count("*").alias("copies"), F.max("page_id").alias("refers_to")).where("copies > 1").select(*alike, "refers_to", F.lit(True).alias("shared"))
    marked = rows.join(materialise(shared), alike, "left").select("page_id", "url", "payload", "digest", "refers_to", (F.coalesce("shared", F.lit(False)) & (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).alias("again"))
    marked = marked.sortWithinPartitions("page_id", "url", "digest")  # a task that runs again writes the same bytes at the same places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base, name, temporary = _names(path, "archive")
        name += ".warc.gz"
        at, keys, offsets, sizes = 0, [], [], []
        with fs.open_output_stream(temporary, compression=None) as out:
            for b in batches:
                for k in range(b.num_rows):
                    page_id, url, payload, digest, refers_to, again = (b.column(c)[k].as_py() for c in range(6))
                    member = gzip.compress(record("revisit" if again else "response", page_id, url, payload, digest, refers_to, date), LEVEL, mtime=0)
                    out.write(member)
                    keys.append(capture_key(url, page_id))
                    offsets.append(at)
                    sizes.append(len(member))
                    at += len(member)
        if not keys:
            fs.delete_file(temporary)
            return
        fs.move(temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([name] * len(keys)), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "file", "offset", "length"])

    return materialise(marked.mapInArrow(run, "key string, file string, offset long, length long"))


def write_index(captures: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """Sort capture lines into index files of compressed blocks; returns (file, first key, last key, lines)."""
    n = parts or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base, name, temporary = _names(path, "index")
        name += ".cdx"
        directory: list[list[Any]] = []
        waiting: list[bytes] = []
        at, lines, last = len(MAGIC), 0, ""
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(MAGIC)

            def flush() -> None:
                nonlocal at
                block = zlib.compress(b"\n".join(waiting), LEVEL)
                out.write(block)
                directory.append([waiting[0].rsplit(b" ", 3)[0].decode(), at, len(block)])
                at += len(block)
                waiting.clear()

            for b in batches:
                for key, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    waiting.append(f"{key} {file} {offset} {length}".encode())
                    lines, last = lines + 1, key
                    if len(waiting) == BLOCK_LINES:
                        flush()
            if waiting:
                flush()
            foot = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        if not lines:
            fs.delete_file(temporary)
            return
        fs.move(temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last]), pa.array([lines], pa.int64())], names=["file", "first", "last", "lines"])

    return materialise(ordered.mapInArrow(run, "file string, first string, last string, lines long"))


class CaptureIndex:
    """Lookups in one index file: a binary search in its directory, then in one block."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream = stream
        size = stream.size()
        stream.seek(size - 16)
        tail = stream.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a capture index")
        (length,) = struct.unpack("<Q", tail[:8])
        stream.seek(size - 16 - length)
        self.directory = json.loads(zlib.decompress(stream.read(length)))
        self.firsts = [d[0] for d in self.directory]
        self.number, self.keys, self.lines = -1, [], []

    def _load(self, number: int) -> None:
        if number != self.number:
            _, at, length = self.directory[number]
            self.stream.seek(at)
            split = [x.rsplit(" ", 3) for x in zlib.decompress(self.stream.read(length)).decode().split("\n")]
            self.number, self.keys, self.lines = number, [x[0] for x in split], [(x[1], int(x[2]), int(x[3])) for x in split]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        number = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while number < len(self.firsts) and self.firsts[number] <= key:
            self._load(number)
            lo, hi = bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)
            yield from self.lines[lo:hi]
            number += 1


def look_up(keys: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """(key, file, offset, length) of every capture of the distinct `keys`.

    `index` has one row for each index file: its first and last keys go to every
    task, which deals each key to the files that can hold it.
    """
    top = sorted((r["first"], r["last"], r["file"]) for r in index.collect())
    firsts = [t[0] for t in top]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found_keys, files = [], []
            for key in b.column(0).to_pylist():
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(top) and firsts[k] <= key:
                    if key <= top[k][1]:
                        found_keys.append(key)
                        files.append(top[k][2])
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(found_keys, pa.string()), pa.array(files, pa.string())], names=["key", "index_file"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        opened, index_file = None, None
        for b in batches:
            rows: list[tuple[str, str, int, int]] = []
            for name, key in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                if name != opened:
                    index_file, opened = CaptureIndex(fs.open_input_file(f"{base}/{name}")), name
                rows += [(key, *where) for where in index_file.find(key)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    routed = keys.select("key").distinct().mapInArrow(route, "key string, index_file string")
    return routed.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "index_file").sortWithinPartitions("index_file", "key").mapInArrow(search, "key string, file string, offset long, length long")


def read_records(places: DataFrame, path: str) -> DataFrame:
    """Range-read the records at (file, offset, length) and check them against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        opened, stream = None, None
        for b in batches:
            rows = []
            for name, offset, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name != opened:
                    stream, opened = fs.open_input_file(f"{base}/{name}"), name
                stream.seek(offset)
                got = parse(gzip.decompress(stream.read(length)))
                fields = got["fields"]
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha1(got["payload"]).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(got["http"]["Content-Length"]), digest, kind, _page(fields.get("WARC-Refers-To"))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = places.select("file", "offset", "length").repartitionByRange(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write archives and their index into the shared folder, look every page up and read its record.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to:
    a row for each record, so repeated rows come again and an empty table gives
    none. write_archives says what nulls, ties and very long payloads give.
    """
    path = shared_uri(pages.sparkSession)
    captures = write_archives(pages, path, least_bytes)
    index = write_index(captures, path)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    wanted = pages.select(F.col("page_id").cast("long"), "url").mapInArrow(keyed, "key string")
    return read_records(look_up(wanted, index, path), path)
