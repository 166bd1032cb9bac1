import gzip
import hashlib
import struct
import zlib

import pytest
from nichegrid.llm import media


def png() -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_digests(docs, texts):
    for r in media.media(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and len(payload) % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert media.from_wave(r["media"])[0] == payload and r["media_type"] == "audio/wav"


def test_sniffing_and_carving():
    assert media.correct("image/png", gzip.compress(b"x")) == ("application/gzip", [])
    found, inside = media.correct("text/plain", png())
    assert found == "image/png" and inside == []
    mixed = b"BM not a bitmap " + png() + b" GIF89a " + gzip.compress(b"some") + b" tail"
    found, inside = media.correct(None, mixed)
    assert found == "application/octet-stream"
    assert [(mixed[a:b], t) for a, b, t in inside] == [(png(), "image/png"), (gzip.compress(b"some"), "application/gzip")]
    cut = png()[:-3]
    assert media.sniff(cut) == []
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken)) == []
    assert media.sniff(media.to_wave(b"ab")) == [(0, 46, "audio/wav")]


def flac() -> bytes:
    def check(raw: bytes, poly: int, bits: int) -> int:
        c = 0
        for x in raw:
            c ^= x << bits - 8
            for _ in range(8):
                c = (c << 1 ^ (poly if c >> bits - 1 else 0)) & (1 << bits) - 1
        return c

    head = bytes([0xFF, 0xF8, 0x69, 0x02, 0x00, 0x0F])
    frame = head + bytes([check(head, 0x07, 8), 0x00, 0x80])
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34) + frame + check(frame, 0x8005, 16).to_bytes(2)


def test_flac_has_a_length():
    sound = flac()
    assert media.sniff(sound) == [(0, len(sound), "audio/flac")]
    assert media.sniff(b"ab " + sound + b" and text after it") == [(3, 3 + len(sound), "audio/flac")]
    assert media.sniff(sound[:-1] + b"?") == [] and media.sniff(b"fLaC" + b"x" * 60) == []


def test_long_text_with_many_hits():
    raw = b"BM PK %PDF- ftyp " * 60_000
    assert media.sniff(raw) == []


def test_feature_and_embedded_by_plain_loops(docs, texts):
    for r in media.media(docs, with_bytes=False).collect():
        x = (texts[r["doc_id"]] or "").encode()
        x += b"\0" * (-len(x) % 64 or (64 if not x else 0))
        mean = sum(x) / len(x)
        spread = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))
        about = dict(p.split("=") for p in r["feature"].split(";")[1:])
        assert float(about["mean"]) == pytest.approx(mean, abs=1e-4) and float(about["deviation"]) == pytest.approx(spread, abs=1e-3)
        assert int(about["crossings"]) == crossings and int(about["samples"]) == len(x) and int(about["embedded"]) == len(r["embedded"])


def test_edge_cases(odd, empty):
    rows = media.media(odd).collect()
    assert len(rows) == 5 and len({r["feature"] for r in rows if r["doc_id"] in (1, 3)}) == 1
    assert media.media(empty).collect() == []
