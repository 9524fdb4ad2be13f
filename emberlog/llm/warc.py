"""WARC archives: written by Spark tasks, read back sequentially.

One gzip member per record. Each task writes the records of its partition to archives of bounded
size under a name of its own, and returns a manifest row per finished archive; the manifest is a
Parquet table that Spark commits. A task that is run again writes new files, and files that no
manifest names do not count, so lost executors leave no half archives.

The reader streams each archive: it inflates a chunk at a time, frames records by their
content-length, checks that a record ends where its gzip member ends, and verifies block and
payload digests as the bytes pass. It never holds more than one record's header and, on request,
its payload. Archives are opened with pyarrow's file systems (file, hdfs, s3, gs), by URI.

It reads other writers' archives too: records of any type (their payload is the block, or what follows the headers of an HTTP
message), with or without digests, in base 32 or hexadecimal, of SHA-1, SHA-256, SHA-512 or MD5 (others are passed over), and HTTP
messages with or without a content-length. A response that is not cut short and has no digest is held to its content-length; of an encoded
body the stored bytes are the payload. Records that don't have our ids get a null page_id.

Equal payloads of ``min_revisit`` bytes or more are stored once: the record with the largest id is a
response, others are revisits that refer to it. The choice is an aggregate on digests (combined
before the shuffle, only digests that occur twice remain) and a join back.

Defined results: null html is an empty payload; a null id is less than any other; rows that
repeat the largest id with the same payload are responses all; other columns are not stored; a very long payload is inflated and
hashed a chunk at a time when it is read, and is in memory once when its record is written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import IO, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import fresh_path, materialise

ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


#: Bytes of an HTTP message's headers that are looked into at most; the rest is passed over, as long as it may be.
HEAD_BYTES = 1 << 20
_DIGESTS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}


class Record(NamedTuple):
    """``payload_bytes`` and ``payload_digest`` (SHA-1) are those of the full payload, of a revisit too if its headers say them."""

    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str | None
    payload: bytes | None


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.removeprefix("-").isdecimal() else None


def _one_line(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member. A revisit (``payload`` is None) has HTTP headers only, and the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    revisit = payload is None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_one_line(url or '')}", f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(CRLF.join(x.encode() for x in head) + CRLF + CRLF + block + CRLF + CRLF) + squeeze.flush()


class _Members:
    """The inflated bytes of a file of gzip members, in chunks, with an end after each member."""

    def __init__(self, file: IO[bytes]):
        self.file, self.rest, self.inflate, self.buffer = file, b"", None, bytearray()

    def start(self) -> bool:
        """Opens the next member; False at the end of the file."""
        self.rest = self.rest or self.file.read(CHUNK)
        if not self.rest:
            return False
        self.inflate, self.buffer = zlib.decompressobj(31), bytearray()
        return True

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.file.read(CHUNK)
        if not data:
            raise ValueError("archive ends within a record")
        self.buffer += self.inflate.decompress(data, CHUNK)
        self.rest = b"" if not self.inflate.eof else self.inflate.unused_data
        return True

    def line(self) -> bytes:
        while (at := self.buffer.find(CRLF)) < 0:
            if not self._more():
                raise ValueError("record ends within its header")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in chunks."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("record is shorter than its content-length")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            if out:
                yield out

    def finish(self) -> None:
        while self._more():
            pass
        if bytes(self.buffer) != CRLF + CRLF:
            raise ValueError("record does not end where its content-length says")


def _hex_digest(value: str | None) -> tuple[str, str] | None:
    """Algorithm and lower-case hex of a labelled digest, or None if there is none that can be checked."""
    name, _, text = (value or "").partition(":")
    name = name.strip().lower()
    if name not in _DIGESTS or not text:
        return None
    width = 2 * _DIGESTS[name]().digest_size
    if len(text) == width:
        return name, text.lower()
    try:
        return name, base64.b32decode(text.upper() + "=" * (-len(text) % 8)).hex()
    except ValueError:
        return None


class _Checked:
    """Digests of bytes as they pass: SHA-1, and the one that a header says."""

    def __init__(self, said: str | None):
        self.said = _hex_digest(said)
        self.sha1 = hashlib.sha1()
        self.other = _DIGESTS[self.said[0]]() if self.said and self.said[0] != "sha1" else self.sha1

    def update(self, chunk: bytes) -> None:
        self.sha1.update(chunk)
        if self.other is not self.sha1:
            self.other.update(chunk)

    def wrong(self) -> bool:
        return self.said is not None and self.other.hexdigest() != self.said[1]


class _Http:
    """Finds the end of an HTTP message's headers in chunks, and the content-length that they say."""

    def __init__(self):
        self.head, self.open, self.length = bytearray(), True, None

    def body(self, chunk: bytes) -> bytes:
        if not self.open:
            return chunk
        self.head += chunk
        at = self.head.find(CRLF + CRLF, max(0, len(self.head) - len(chunk) - 3))
        if at < 0:
            if len(self.head) > HEAD_BYTES:
                del self.head[:-3]  # too long to look into; its end still counts
            return b""
        self.open, rest = False, bytes(self.head[at + 4 :])
        for line in bytes(self.head[:at]).split(CRLF)[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                self.length = int(value)
        self.head = bytearray()
        return rest


def read_records(file: IO[bytes], with_payload: bool = False) -> Iterator[Record]:
    members = _Members(file)
    while members.start():
        if not members.line().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while line := members.line():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        kind, named = headers.get("warc-type", ""), headers.get("warc-record-id", "a record")
        if not headers.get("content-length", "").isdecimal():
            raise ValueError(f"{named} has no content-length")
        http = _Http() if headers.get("content-type", "").lower().startswith("application/http") else None
        block, payload, size, held = _Checked(headers.get("warc-block-digest")), _Checked(headers.get("warc-payload-digest")), 0, []
        for chunk in members.take(int(headers["content-length"])):
            block.update(chunk)
            if http:
                chunk = http.body(chunk)
            payload.update(chunk)
            size += len(chunk)
            if with_payload:
                held.append(chunk)
        members.finish()
        if block.wrong():
            raise ValueError(f"block digest of {named} is wrong")
        full, digest = size, payload.sha1.hexdigest()
        if kind == "revisit":  # the payload is elsewhere; the headers say what it is
            full = http.length if http and http.length is not None else size
            digest = payload.said[1] if payload.said and payload.said[0] == "sha1" else None
        elif "warc-truncated" not in headers:
            if payload.wrong():
                raise ValueError(f"payload of {named} is not what its digest says")
            if payload.said is None and kind == "response" and http and http.length not in (None, size):
                raise ValueError(f"payload of {named} is not as long as its content-length says")
        yield Record(headers, full, digest, b"".join(held) if with_payload else None)


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    done: list[tuple[str, int, int]] = []
    out, name, n, size = None, "", 0, 0
    for batch in batches:
        for i in range(batch.num_rows):
            page, url, html, digest, length, refers = (batch.column(k)[i].as_py() for k in range(6))
            if out is None:
                name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            data = record(page, url, (html or "").encode() if refers is None else None, digest, length, refers)
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= ARCHIVE_BYTES:
                out.close()
                done.append((f"{folder}/{name}", n, size))
                out = None
    if out is not None:
        out.close()
        done.append((f"{folder}/{name}", n, size))
    paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    for b in batches:
        for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, at = pafs.FileSystem.from_uri(path)
            rows, n = [], 0
            with fs.open_input_stream(at, compression=None) as file:
                for r in read_records(file):
                    refers = r.headers.get("warc-refers-to")
                    rows.append((_page(r.headers.get("warc-record-id", "")), r.payload_bytes, r.payload_digest, r.headers.get("warc-type"), _page(refers) if refers else None, r.headers.get("warc-target-uri")))
                    n += 1
                    if len(rows) == 5000:
                        yield batch(rows)
                        rows = []
            if n != expected:
                raise ValueError(f"{path} has {n} records; its manifest says {expected}")
            if rows:
                yield batch(rows)


def with_revisits(pages: DataFrame, min_revisit: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, html, digest, bytes, refers_to``; refers_to is null for responses, and html for revisits."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    # No id sorts before any other, also in groups without ids
    order = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("last"))
    repeated = rows.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max(order).alias("o"), F.min(order).alias("p")).filter("o != p")
    repeated = materialise(repeated.select(F.col("digest").alias("r_digest"), F.col("o.last").alias("last")), "repeated")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("r_digest").isNotNull(), F.col("last"))
    joined = rows.join(repeated, F.col("digest") == F.col("r_digest"), "left").withColumn("refers_to", refers)
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "bytes", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """Writes the pages as archives under ``folder`` (a URI that all executors share) and returns the committed manifest."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = with_revisits(pages, **names)
    return materialise(rows.mapInArrow(lambda it: _write(folder, it), MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url``, one row per record. Archives are dealt out one by one."""
    n = max(1, manifest.count())
    return manifest.repartition(n, F.xxhash64("path")).mapInArrow(_read, RECORDS)
