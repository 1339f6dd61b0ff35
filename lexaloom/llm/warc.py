"""WARC archives: one gzip member per record, read back sequentially with bounded memory.

The writer packs each task's records into `.warc.gz` files of some megabytes in a folder that all
executors reach, named by their content, and gives their paths: what an ended task left behind isn't
listed. The reader takes such paths, or the bytes of files (`binaryFile`); it feeds a streaming
decompressor from the open file, frames records by Content-Length and verifies block and payload
digests; truncated or altered archives raise. It holds a record at a time. It reads archives of other
producers, too: any record type, header names in any case, with or without a blank after the colon,
folded header lines, HTTP heads without a length, files without compression or in one gzip member.

Of rows with equal payloads of at least `min_revisit` bytes, those with the largest page_id are
responses and the others revisits of it. Defined results: null html is an empty payload; a null
page_id counts as the smallest and refers to the largest like any other; where all are null, all are
responses; rows that repeat the largest page_id are responses too; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, utf8

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, FEED = 4_000_000, 65_536


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit's block has the HTTP head only, with the full payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """An archive's bytes in pieces, inflated if they are gzip members; EOFError where the last member is cut short."""
    piece, d = source.read(FEED), None
    if piece and piece[:2] != b"\x1f\x8b":
        while piece:
            yield piece
            piece = source.read(FEED)
        return
    while piece:
        while piece:
            d = d or zlib.decompressobj(31)
            yield d.decompress(piece)
            piece, d = (d.unused_data, None) if d.eof else (b"", d)
        piece = source.read(FEED)
    if d:
        raise EOFError("an archive ends inside a gzip member")


_HEAD_END = re.compile(rb"\r?\n\r?\n")


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the lines of a folded field are one value."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    pieces, held = inflated(io.BytesIO(source) if isinstance(source, bytes) else source), b""
    while True:
        held = held.lstrip(b"\r\n")
        while not (end := _HEAD_END.search(held)):
            piece = next(pieces, None)
            if piece is None:
                if held:
                    raise EOFError("an archive ends inside a record's head")
                return
            held = (held + piece).lstrip(b"\r\n")
        version, _, head = held[: end.start()].partition(b"\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = headers_of(head)
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record without a Content-Length")
        need, parts, have = int(headers["content-length"]) + 2, [held[end.end() :]], len(held) - end.end()
        while have < need:
            piece = next(pieces, None)
            if piece is None:
                break
            parts.append(piece)
            have += len(piece)
        body = b"".join(parts)
        block, held = body[: need - 2], body[need - 2 :]
        if len(block) < need - 2 or not held:
            raise EOFError("an archive ends inside a record")
        if not held.startswith((b"\r\n", b"\n")):
            raise ValueError("a record doesn't end where its Content-Length says")
        if not digest_fits(headers.get("warc-block-digest"), block):
            raise ValueError("a block digest differs")
        yield headers, block


def digest_fits(said: str | None, data: bytes) -> bool:
    """False if a SHA-1 or SHA-256 digest, in base32 or hexadecimal, is of other bytes; other kinds can't be told."""
    kind, _, value = (said or "").partition(":")
    make = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256}.get(kind.lower())
    if make is None:
        return True
    own = make(data).digest()
    return value.upper().rstrip("=") in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


HOT_KEYS, HOT_LEAST = 100_000, 1_000


def with_record_types(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, html, record_type, refers_to.

    Digest groups are counted before anything large is joined. Groups of over HOT_LEAST rows and over a
    HOT_KEYS-th of all meet their pages by a broadcast of at most HOT_KEYS rows, the others by a shuffle that spreads the first.
    """
    p = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("_d"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    last = p.where(size >= min_revisit).select("_d", "page_id").groupBy("_d").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    hot = F.col("_k") > max(HOT_LEAST, pages.count() // HOT_KEYS)
    p = p.join(F.broadcast(last.where(hot).select("_d", F.col("_last").alias("_hot"))), "_d", "left")
    spread = F.when(F.col("_hot").isNull(), F.col("_d")).otherwise(F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string")))
    p = p.withColumn("_d", spread).join(last.where(~hot).select("_d", "_last"), "_d", "left").withColumn("_last", F.coalesce("_hot", "_last"))
    again = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return p.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_last")).alias("refers_to"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """path, n_records: gzip archives of about ARCHIVE_BYTES each in folder (a URI that pyarrow opens), made within the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)

        def out() -> pa.RecordBatch:
            content = b"".join(held)
            name = f"part-{hashlib.sha1(content).hexdigest()}.warc.gz"
            part = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part, compression=None) as f:
                f.write(content)
            fs.move(part, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["path", "n_records"])

        held, size = [], 0
        for b in batches:
            for page_id, url, html, kind, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                held.append(member(record(kind, page_id, url, html or b"", refers)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return typed.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(released(run), "path string, n_records long")


READ = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_record(headers: dict[str, str], block: bytes) -> tuple:
    """A row of READ. The payload is the block, or what follows the HTTP head in it; a revisit has none, its length is what the HTTP head says (null if nothing)."""

    def page(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", headers.get(name, ""))
        return int(m[1]) if m else None

    kind, payload, http = headers.get("warc-type", "").lower(), block, {}
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, *rest = _HEAD_END.split(block, 1)
        http, payload = headers_of(head), rest[0] if rest else b""
    said = headers.get("warc-payload-digest")
    if kind == "revisit":
        n = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        digest, payload = (said or "").rpartition(":")[2] or None, None
    else:
        if "warc-truncated" not in headers and not digest_fits(said, payload):
            raise ValueError("a payload differs from its digest")
        n, digest = len(payload), sha1_base32(payload)
    return headers.get("warc-record-id"), page("warc-record-id"), (headers.get("warc-target-uri") or "").strip("<>") or None, kind, page("warc-refers-to"), n, digest, payload


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives(path), read from the open files, or of archives(content), for example of spark.read.format("binaryFile")."""
    names = READ.names if with_payload else READ.names[:-1]
    column = "content" if "content" in archives.columns else "path"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, READ.field(k).type) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for b in batches:
            for x in b.column(0):
                rows, size = [], 0
                with opened(x.as_py()) as source:
                    for headers, block in records(source):
                        rows.append(read_record(headers, block)[: len(names)])
                        size += len(block) if with_payload else 200
                        if size > ARCHIVE_BYTES:
                            yield out()
                            rows, size = [], 0
                if rows:
                    yield out()

    return archives.select(column).mapInArrow(released(run), "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


def opened(what: str | bytes | None) -> BinaryIO:
    if isinstance(what, str):
        fs, path = file_system(what)
        return fs.open_input_stream(path, compression=None)
    return io.BytesIO(what or b"")
