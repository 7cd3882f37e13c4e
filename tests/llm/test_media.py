import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

from pyspark.sql import functions as F

from tests import parity
from tests.llm import edge
from tidemark.llm import media


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1\2\0\3\4")) + chunk(b"IEND", b"")


def wav(data=b"\1\2\3\4"):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(data)
    return out.getvalue()


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.txt", "again" * 50)
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x21\xf9\x04\1\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x44\1\0\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
JPEG = b"\xff\xd8\xff\xe0\0\4\0\0" + b"\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj<<>>endobj\nstartxref\n9\n%%EOF"
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov") + struct.pack(">I4s", 12, b"mdat") + b"data"
OGG = b"".join(b"OggS\0" + bytes([flag]) + bytes(8) + b"abcd" + bytes(8) + b"\1\3xyz" for flag in (2, 0, 4))
FILES = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/pdf": PDF, "image/webp": WEBP, "video/mp4": MP4, "audio/ogg": OGG, "audio/wav": wav(), "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 5000)}


def sniffed(spark, values):
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), t) for i, (b, t) in enumerate(values)], "i int, b binary, t string")
    return df.withColumn("s", media.sniff(F.col("b"), F.col("t")))


def test_formats_are_found_alone_and_embedded(spark):
    names = list(FILES)
    values = [(FILES[n], "text/plain") for n in names] + [(b"junk BM GIF89a" + FILES[n] + b"tail OggS", None) for n in names] + [(FILES[n][:-1], n) for n in names]
    rows = {r["i"]: r["s"] for r in sniffed(spark, values).collect()}
    for k, n in enumerate(names):
        alone, inside, cut = rows[k], rows[k + len(names)], rows[k + 2 * len(names)]
        assert alone["type"] == n and alone["corrected"] and (alone["spans"][0]["start"], alone["spans"][0]["length"]) == (0, len(FILES[n])), n
        assert [(s["type"], s["start"], s["length"]) for s in inside["spans"]] == [(n, 14, len(FILES[n]))] and inside["type"] == "application/octet-stream", n
        assert not cut["spans"] and cut["type"] == "application/octet-stream" and cut["corrected"], n


def test_damage_is_not_confirmed(spark):
    bad = bytearray(png())
    bad[20] ^= 1
    rows = sniffed(spark, [(bytes(bad), "image/png"), (b"", "image/png"), (None, None), (b"plain", "text/plain"), (b"BM" * 500, None)]).collect()
    assert [len(r["s"]["spans"]) for r in rows] == [0] * 5 and [r["s"]["type"] for r in rows] == ["application/octet-stream"] * 3 + ["text/plain", "application/octet-stream"]


def test_carving(spark):
    whole = b"start" + FILES["image/png"] + b"mid" + wav(b"hello!") + b"end"
    out = media.carve(sniffed(spark, [(whole, None)]).withColumn("carved", F.lit(1)), "b", "s")
    got = sorted((r["carved_"]["type"], bytes(r["carved_"]["bytes"]), r["carved_"]["data"] and bytes(r["carved_"]["data"])) for r in out.collect())
    assert got[0][:2] == ("audio/wav", wav(b"hello!")) and got[0][2] == b"hello!" and got[1][:2] == ("image/png", FILES["image/png"])


def check(rows, got):
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        b, g = (text or "").encode(), by[doc_id]
        payload = b + b" " * (192 * max(1, -(-len(b) // 192)) - len(b))
        stored = wav(payload)
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"], g["media_bytes"], g["media_sha256"]) == (
            len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(),
        )
        assert g["feature"].startswith(f"audio/wav;samples={len(payload)};header=44;")


def test_query(spark):
    check([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{parity.SF}/documents.parquet").collect()], media.op5(spark, parity.SF).collect())


def test_edge_cases(spark, tmp_path):
    tricky = [(50, "text with BM and GIF89a and %PDF-1.4 startxref %%EOF in it", "en", "s", 1), (51, "x" * 192, "en", "s", 1), (52, "é" * 96, "en", "s", 1)]
    rows = [*edge.ROWS, *tricky]
    check(rows, media.op5(spark, edge.save(spark, rows, tmp_path)).collect())
    assert media.op5(spark, edge.save(spark, [], tmp_path / "e")).count() == 0
    odd = spark.createDataFrame([(bytearray(b"odd"),)], "b binary").select(media.as_wav(F.col("b")).alias("w")).first()["w"]
    assert len(odd) == 48 and wave.open(io.BytesIO(odd)).readframes(9) == b"odd"


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in {f[0] for f in media.FORMATS}:
        found.add_word(magic.decode("latin-1"), [f for f in media.FORMATS if f[0] == magic])
    found.make_automaton()
    return found


def test_texts_full_of_magic_bytes():
    """Five megabytes of marks that begin, continue or end files take seconds."""
    a = automaton()
    began = time.perf_counter()
    for mark in (b"%PDF-", b"PK\x03\x04", b"%PDF-startxref%%EOF", b"PK\x03\x04PK\x05\x06", b"%PDF-%%EOF", OGG[:31]):
        found = media.spans(mark * (5_000_000 // len(mark)), a)
        assert bool(found) == (mark == b"%PDF-startxref%%EOF")
    assert time.perf_counter() - began < 120


def test_revisions_and_several_files():
    """A PDF ends with its last revision before the next one begins; a ZIP where its own end record says."""
    a = automaton()
    twice = PDF + b"more\nstartxref\n9\n%%EOF"
    got = media.spans(b"-" + twice + b"--" + PDF + b"-" + zipped() + b"+" + zipped(), a)
    z = len(twice) + len(PDF) + 4
    assert [(s["type"], s["start"], s["length"]) for s in got] == [
        ("application/pdf", 1, len(twice)), ("application/pdf", len(twice) + 3, len(PDF)), ("application/zip", z, len(zipped())), ("application/zip", z + len(zipped()) + 1, len(zipped())),
    ]


def test_feature_of_every_row(spark, tmp_path):
    """Spans inside texts, found by walking over every offset with the formats' own first bytes."""
    rows = [(1, "plain", "en", "s", 1), (2, "x" + PDF.decode() + "y" + PDF.decode(), "en", "s", 1), (3, GIF.decode("latin-1"), "en", "s", 1), (4, OGG.decode() + "tail", "en", "s", 1), (5, None, "en", "s", 1)]
    got = {r["doc_id"]: r["feature"] for r in media.op5(spark, edge.save(spark, rows, tmp_path)).collect()}
    n = len(PDF)
    want = {2: f"application/pdf@45+{n},application/pdf@{46 + n}+{n}", 4: f"audio/ogg@44+{len(OGG)}"}
    for i, text, *_ in rows:
        size = 192 * max(1, -(-len((text or "").encode()) // 192))
        assert got[i] == f"audio/wav;samples={size};header=44;embedded={want.get(i, '').count('@')};{want.get(i, '')}"
    docs = spark.read.parquet(f"{parity.SF}/documents.parquet").collect()
    found = {r["doc_id"]: r["feature"] for r in media.op5(spark, parity.SF).collect()}
    first = [(magic, back, confirm) for magic, back, _, confirm in media.FORMATS]
    for r in docs:
        b = (r["text"] or "").encode()
        held = [at for at in range(len(b)) for magic, back, confirm in first if b.startswith(magic, at) and at >= back and confirm(b, at - back, {})]
        assert f";embedded={len(held)};" in found[r["doc_id"]]
