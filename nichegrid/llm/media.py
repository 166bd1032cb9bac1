"""Media columns: texts as sampled sound, and media types told from content."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow
from nichegrid.llm.textkit import pieces

# Fixed values of the public formats: the bytes that begin a file, where they stand in it, and its media type.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"WAVE", 8, "audio/wav"),
    (b"WEBP", 8, "image/webp"),
    (b"AVI ", 8, "video/avi"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"ftyp", 4, "video/mp4"),
)


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, before, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), before, kind))
    a.make_automaton()
    return a


def _find(b: memoryview, what: bytes, at: int = 0) -> int:
    """Where the bytes stand, as bytes.find; only windows are copied."""
    for start in range(at, len(b), 1 << 16):
        found = bytes(b[start : start + (1 << 16) + len(what) - 1]).find(what)
        if found >= 0:
            return start + found
    return -1


def _png(b: memoryview) -> int:
    at = 8
    while at + 12 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        end = at + 12 + size
        if end > len(b) or (at == 8) != (kind == b"IHDR") or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack(">I", b[end - 4 : end])[0]:
            return 0
        if kind == b"IEND":
            return end
        at = end
    return 0


def _jpeg(b: memoryview) -> int:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
        if mark < 0xC0 or size < 2:
            return 0
        at += 2 + size
        if mark == 0xDA:
            end = _find(b, b"\xff\xd9", at)
            return end + 2 if end >= 0 else 0
    return 0


def _gif(b: memoryview) -> int:
    if len(b) < 14:
        return 0
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at += 2
        elif b[at] == 0x2C and at + 10 < len(b):
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0)
        else:
            return 0
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return 0


def _bmp(b: memoryview) -> int:
    if len(b) < 26:
        return 0
    size, _, start, head = struct.unpack("<IIII", b[2:18])
    return size if 26 <= size <= len(b) and 14 + head <= start <= size and head in (12, 40, 52, 56, 64, 108, 124) else 0


def _riff(b: memoryview) -> int:
    if b[:4] != b"RIFF" or len(b) < 20:
        return 0
    end = 8 + struct.unpack("<I", b[4:8])[0]
    at = 12
    while at + 8 <= end <= len(b):
        at += 8 + (n := struct.unpack("<I", b[at + 4 : at + 8])[0]) + n % 2
    return end if at == end <= len(b) else 0


def _crc_table(polynomial: int, bits: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (polynomial if x >> bits - 1 else 0)) & (1 << bits) - 1
        out.append(x)
    return out


#: Of FLAC's frame headers and frames; the polynomials are fixed values of the format.
_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_header(b: memoryview, at: int) -> bool:
    """Whether a frame's header, with a right check sum, stands at a place."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 2] >> 4 == 0 or b[at + 2] & 15 == 15 or b[at + 3] >> 4 > 10:
        return False
    first = b[at + 4]  # a number coded as in UTF-8
    more = 0 if first < 0x80 else next((i for i in range(1, 7) if not first & 0x40 >> i), 7)
    end = at + 5 + more + {6: 1, 7: 2}.get(b[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[at + 2] & 15, 0)
    crc = 0
    for x in b[at:end]:
        crc = _CRC8[crc ^ x]
    return end < len(b) and crc == b[end]


def _flac(b: memoryview) -> int:
    """Metadata blocks, then frames as long as their check sums are right."""
    at, last = 4, False
    while not last:
        if at + 4 > len(b) or (at == 4) != (b[at] & 0x7F == 0) or at == 4 and b[5:8] != b"\0\0\x22":
            return 0
        last, at = bool(b[at] & 0x80), at + 4 + int.from_bytes(b[at + 1 : at + 4])
    if at > len(b):
        return 0
    while _flac_header(b, at):
        crc, i, end = 0, at, 0
        while i < len(b):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[i]]
            i += 1
            if crc == 0 and i - at > 8:  # with its own check sum a frame's is 0; by chance, a part's is too
                end = end or i
                if i == len(b) or _flac_header(b, i):
                    end = i
                    break
        if not end:
            return at if at > 42 else 0
        at = end
    return at


def _ogg(b: memoryview) -> int:
    at = 0
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b) and b[at + 4] == 0:
        n = b[at + 26]
        at += 27 + n + sum(b[at + 27 : at + 27 + n])
        if at > len(b):
            return 0
    return at


def _pdf(b: memoryview) -> int:
    end = _find(b, b"%%EOF")
    return end + 5 if end > 0 and bytes(b[5:6]).isdigit() and 0 <= _find(b, b"startxref") < end else 0


def _zip(b: memoryview) -> int:
    at = _find(b, b"PK\x05\x06")
    if at < 0 or at + 22 > len(b):
        return 0
    size, start, note = struct.unpack("<IIH", b[at + 12 : at + 22])
    return at + 22 + note if start + size == at and at + 22 + note <= len(b) else 0


def _gzip(b: memoryview) -> int:
    reader = zlib.decompressobj(31)
    try:
        at = 0
        while at < len(b) and not reader.eof:  # piece by piece: what comes out isn't kept
            reader.decompress(b[at : at + 4096])
            at += 4096
    except zlib.error:
        return 0
    return min(at, len(b)) - len(reader.unused_data) if reader.eof else 0


def _mp4(b: memoryview) -> int:
    at = 0
    while at + 8 <= len(b) and bytes(b[at + 4 : at + 8]).isalnum():
        size = struct.unpack(">I", b[at : at + 4])[0]
        if size < 8 or at + size > len(b):
            break
        at += size
    return at


VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff, "image/webp": _riff, "video/avi": _riff, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4}


def sniff(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of every medium in the bytes, the one at 0 and embedded ones, whose structure and length hold."""
    found, done, view = [], set(), memoryview(raw)
    for end, (size, before, kind) in _automaton().iter(raw.decode("latin-1")):
        start = end + 1 - size - before
        if start >= 0 and (start, kind) not in done and (n := VALID[kind](view[start:])):
            done.add((start, kind))
            found.append((start, start + n, kind))
    return sorted(found)


def correct(declared: str | None, raw: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The type that the content shows (the declared one where it shows none), and the media embedded further on."""
    found = sniff(raw)
    own = next((x for x in found if x[0] == 0), None)
    return (own[2] if own else declared or "application/octet-stream"), [x for x in found if x is not own]


def to_wave(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as unsigned 8-bit mono PCM samples in a RIFF/WAVE file; its length must be even."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wave(stored: bytes) -> tuple[bytes, dict[str, int]]:
    """The samples of a RIFF/WAVE file and its format, found by walking the chunks."""
    if not _riff(memoryview(stored)) or stored[8:12] != b"WAVE":
        raise ValueError("not a whole RIFF/WAVE file")
    at, about, samples = 12, {}, b""
    while at + 8 <= len(stored):
        name, n = struct.unpack("<4sI", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if name == b"fmt ":
            about = dict(zip(("format", "channels", "rate", "bytes_a_second", "block", "bits"), struct.unpack("<HHIIHH", body[:16]), strict=True))
        elif name == b"data":
            samples = body
        at += 8 + n + n % 2
    return samples, about


def padded(raw: bytes, unit: int = 64) -> bytes:
    """The bytes and zeros up to a positive multiple of `unit`."""
    return raw + b"\0" * (-len(raw) % unit if raw else unit)


def media(docs: DataFrame, rate: int = 8000, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Every row's whole text as a sound file: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_type,
    media_bytes, media_sha256, embedded, feature[, media]).

    The digests of the payload come from the stored file as read back. `feature` has the type found by content, the
    format, and the samples' mean, deviation and zero crossings; equal texts have equal values. `embedded` lists media
    carved from the samples as (start, end, type), from the start of the payload. Null is an empty text; empty texts
    have 64 zero samples. A very long text is held a few times over by its task. Repeated rows stay; an empty table
    gives no rows, and other columns of docs, whatever their names, are not read. One pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_type", "media_bytes", "media_sha256", "embedded", "feature", *["media"] * with_bytes]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())])), pa.string(), pa.binary()]

    def one(raw: bytes) -> tuple:
        stored = to_wave(padded(raw), rate)
        found, inside = correct("application/octet-stream", stored)
        payload, about = from_wave(stored)
        x = np.frombuffer(payload, np.uint8)
        crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
        total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
        mean = total / len(x)
        spread = max(0.0, squares / len(x) - mean * mean) ** 0.5
        head = len(stored) - len(payload)
        carved = [{"start": a - head, "end": b - head, "type": t} for a, b, t in inside if a >= head]
        feature = f"{found};bits={about['bits']};channels={about['channels']};rate={about['rate']};samples={len(x)};mean={mean:.4f};deviation={spread:.4f};crossings={crossings};embedded={len(carved)}"
        return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), found, len(stored), hashlib.sha256(stored).hexdigest(), carved, feature, *[stored] * with_bytes)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, "the_text", 1 << 20):
                rows = [one(x or b"") for x in b.column("the_text").cast(pa.large_binary()).to_pylist()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names)

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_type string, media_bytes long, media_sha256 string, embedded array<struct<start: long, end: long, type: string>>, feature string" + ", media binary" * with_bytes
    return arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("the_text")), batches, schema).withColumnRenamed("id", id_col)
