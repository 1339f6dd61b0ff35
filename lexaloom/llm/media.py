"""Media columns: lossless 8-bit storage of payloads and signature sniffing of stored bytes.

An Aho-Corasick automaton finds magic bytes in one pass; a validator per format then confirms
structure and lengths, so that a magic number in ordinary text is not taken for a file. The format
found at the start corrects the declared type; those found later are carved as embedded media.

Defined results: a null payload is stored as padding only; a null medium has no type, no carved
parts and a null payload; equal bytes give equal values; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, utf8

_UPDATE = re.compile(rb"\s*(\d+ \d+ obj|xref|startxref|%[^%P])")
PAD_TO, PAD = 576, b"\xff"
RATE = 16_000

# Magic bytes, the offset of the magic in its format, and the media type.
MAGIC = [
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
]


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of PAD_TO."""
    return data + PAD * (max(PAD_TO, -(-len(data) // PAD_TO) * PAD_TO) - len(data))


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM in a RIFF container; RIFF chunks have an even length."""
    fill = b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(fill)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + fill


def _wav_length(b: bytes, at: int) -> int:
    if b[at + 8 : at + 12] != b"WAVE" or at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    return end - at if end <= len(b) and wav_samples(b, at, end) is not None else 0


def wav_samples(b: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Start and end of the sample data, if the chunks fit the container."""
    k, fmt, found = at + 12, False, None
    while k + 8 <= end:
        n = struct.unpack_from("<I", b, k + 4)[0]
        if k + 8 + n > end:
            return None
        fmt |= b[k : k + 4] == b"fmt " and n >= 16
        if b[k : k + 4] == b"data":
            found = (k + 8, k + 8 + n)
        k += 8 + n + n % 2
    return found if fmt else None


def _png_length(b: bytes, at: int) -> int:
    k = at + 8
    while k + 12 <= len(b):
        n = struct.unpack_from(">I", b, k)[0]
        kind, end = b[k + 4 : k + 8], k + 12 + n
        if end > len(b) or (k == at + 8 and kind != b"IHDR") or zlib.crc32(b[k + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        k = end
    return 0


def _gif_length(b: bytes, at: int) -> int:
    def blocks(k: int) -> int:
        while k < len(b) and b[k]:
            k += 1 + b[k]
        return k + 1

    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    k = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 - at
        if b[k] == 0x21:
            k = blocks(k + 2)
        elif b[k] == 0x2C and k + 10 <= len(b):
            own = b[k + 9]
            k = blocks(k + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg_length(b: bytes, at: int) -> int:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        marker, n = b[k + 1], struct.unpack_from(">H", b, k + 2)[0]
        if n < 2 or not 0xC0 <= marker <= 0xFE:
            return 0
        k += 2 + n
        if marker == 0xDA:
            end = b.find(b"\xff\xd9", k)
            return end + 2 - at if end >= 0 else 0
    return 0


def _bmp_length(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    n, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    return n if spare == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= n and at + n <= len(b) else 0


def _pdf_length(b: bytes, at: int) -> int:
    """Up to the last %%EOF of the file's sections: updates follow with objects, tables and a startxref of their own."""
    end = b.find(b"%%EOF", at)
    if end < 0 or not b[at + 5 : at + 6].isdigit() or b"startxref" not in b[at:end]:
        return 0
    end += 5
    while (more := b.find(b"%%EOF", end)) >= 0 and _UPDATE.match(b, end) and b"startxref" in b[end:more] and b"%PDF-" not in b[end:more]:
        end = more + 5
    return end - at


def _zip_length(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):  # the first end record that fits the start: members may hold others
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        if offset + size == end - at and end + 22 + note <= len(b):
            return end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 1)
    return 0


def _gzip_length(b: bytes, at: int) -> int:
    d, k = zlib.decompressobj(31), at
    try:
        while k < len(b) and not d.eof:
            d.decompress(b[k : k + 65536])
            k += 65536
    except zlib.error:
        return 0
    return min(k, len(b)) - len(d.unused_data) - at if d.eof else 0


@cache
def crc_table(bits: int, poly: int) -> list[int]:
    """Of a CRC that takes the high bit first and starts at 0."""
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for k in range(256):
        c = k << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


def _flac_head(b: bytes, at: int, blocks: tuple[int, int]) -> tuple[int, int]:
    """The length of a FLAC frame's head and the samples in it; zeros if there is no frame or its CRC-8 differs."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return 0, 0
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    first = b[at + 4]
    more = 0 if first < 0x80 else next((k for k in range(1, 7) if not first << k + 1 & 0x80), 0)
    k = at + 5 + more
    if not size or rate == 15 or k + 4 > len(b) or first & 0xC0 == 0x80:
        return 0, 0
    if size in (6, 7):
        n = int.from_bytes(b[k : k + size - 5], "big") + 1
        k += size - 5
    else:
        n = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    k += (0, 1, 2, 2)[rate - 11] if rate >= 12 else 0
    c, table = 0, crc_table(8, 0x07)
    for x in b[at:k]:
        c = table[c ^ x]
    return (k + 1 - at, n) if k < len(b) and b[k] == c and n <= max(blocks) else (0, 0)


def _flac_length(b: bytes, at: int) -> int:
    """Metadata blocks, then frames, each ended by its CRC-16, up to the samples that the stream names or the last frame."""
    if at + 42 > len(b) or b[at + 4] & 0x7F or b[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    blocks, total = struct.unpack_from(">HH", b, at + 8), int.from_bytes(b[at + 21 : at + 26], "big") & (1 << 36) - 1
    k, last = at + 4, 0
    while not last:
        if k + 4 > len(b):
            return 0
        last = b[k] & 0x80
        k += 4 + int.from_bytes(b[k + 1 : k + 4], "big")
    if k > len(b):
        return 0
    done, table = 0, crc_table(16, 0x8005)
    head, n = _flac_head(b, k, blocks)
    while head and (not total or done < total):
        c, end = 0, 0
        for p in range(k, len(b)):
            c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b[p]]
            if not c and p >= k + head + 2:
                after = _flac_head(b, p + 1, blocks)
                if after[0] or not total or done + n >= total:
                    end = p + 1
                    break
        if not end:
            return 0
        k, done, (head, n) = end, done + n, after
    return k - at if not total or done >= total else 0


def _ogg_length(b: bytes, at: int) -> int:
    """Pages whose CRC-32 fits, one behind the other."""
    k, table = at, crc_table(32, 0x04C11DB7)
    while b[k : k + 5] == b"OggS\0" and k + 27 <= len(b):
        segments = b[k + 27 : k + 27 + b[k + 26]]
        end = k + 27 + len(segments) + sum(segments)
        if end > len(b) or len(segments) < b[k + 26]:
            break
        c = 0
        for x in b[k : k + 22] + bytes(4) + b[k + 26 : end]:
            c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ x]
        if c != struct.unpack_from("<I", b, k + 22)[0]:
            break
        k = end
    return k - at


VALID = {"audio/wav": _wav_length, "image/png": _png_length, "image/gif": _gif_length, "image/jpeg": _jpeg_length, "image/bmp": _bmp_length, "application/pdf": _pdf_length, "application/zip": _zip_length, "application/gzip": _gzip_length, "audio/flac": _flac_length, "audio/ogg": _ogg_length}


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic) - 1 + offset, kind))
    a.make_automaton()
    return a


def found_media(b: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of each valid medium; what lies inside another, the payload of a WAV or BMP apart, is not searched."""
    out, done = [], 0
    for end, (back, kind) in automaton().iter(b.decode("latin-1")):
        at = end - back
        if at >= done and (n := VALID[kind](b, at)):
            out.append((at, n, kind))
            done = at + (n if kind not in ("audio/wav", "image/bmp") else 44)
    return out


SNIFFED = pa.schema([("media_type", pa.string()), ("corrected", pa.bool_()), ("payload", pa.binary()), ("embedded", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("type", pa.string()), ("data", pa.binary())])))])


def store_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes, declared_type and media: each text's padded UTF-8 bytes as 8-bit samples of a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in utf8(b.column(len(keep)))]
            for k in range(0, len(data), 256) if data else ():
                part = data[k : k + 256]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(k, 256) for i in range(len(keep))], pa.array(map(len, part), pa.int64()), pa.array(["application/octet-stream"] * len(part)), pa.array([wav(padded(x)) for x in part], pa.binary())], names=[*keep, "n_bytes", "declared_type", "media"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(released(run), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_bytes long, declared_type string, media binary"]))


def sniffed(b: bytes | None, declared: str | None) -> dict:
    found = found_media(b) if b is not None else []
    top = next((x for x in found if x[0] == 0), None)
    payload = None
    if top and top[2] == "audio/wav":
        payload = b[slice(*wav_samples(b, 0, top[1]))]
    elif b is not None:
        payload = b
    kind = top[2] if top else (None if b is None else "application/octet-stream")
    return {"media_type": kind, "corrected": kind != declared, "payload": payload, "embedded": [{"at": at, "n": n, "type": t, "data": b[at : at + n]} for at, n, t in found if at]}


def sniff_media(media: DataFrame, column: str = "media", declared: str = "declared_type", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep, media, media_type, corrected (the declared type was another), payload and embedded media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, said = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()
            for k in range(0, len(data), 256):
                rows = pa.RecordBatch.from_pylist([sniffed(x, s) for x, s in zip(data[k : k + 256], said[k : k + 256], strict=True)], schema=SNIFFED)
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(k, 256) for i in range(len(keep) + 1)], *rows.columns], names=[*keep, "media", *SNIFFED.names])

    kinds = dict(media.dtypes)
    return media.select(*keep, column, declared).mapInArrow(released(run), ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "media binary, media_type string, corrected boolean, payload binary, embedded array<struct<at: bigint, n: bigint, type: string, data: binary>>"]))


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of what was stored, from the bytes read back."""
    s = sniff_media(store_media(docs))
    p = F.col("payload")
    return s.select("doc_id", "n_bytes", F.octet_length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"), F.crc32(F.substring(p, -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", "media_type", F.concat(F.lit("samples="), F.octet_length(p)), F.concat(F.lit("embedded="), F.size("embedded"))).alias("feature"))


