"""Media columns by signature sniffing.

One Aho-Corasick automaton finds the magic bytes of all formats in a single pass over a binary column. Each
hit is only a candidate: a validator of the format walks its structure (chunks, blocks, boxes, checksums) and
confirms it with its length, or drops it. Confirmed spans correct the declared type (the one that starts the
value counts) and can be carved out, embedded ones too.

Edge cases: a null or empty value has no span; its type is the declared one unless a validator exists for that
type, which makes it application/octet-stream; truncated or damaged files are not confirmed; spans of equal
start are ordered by type; end marks of PDF and ZIP files and pages of Ogg streams are looked up once a value, so that a text full of
their magic bytes takes linear time; repeated rows get equal answers; extra columns are carried along unread.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: Start and end in the value, type, and where the samples or data of the format lie (-1: not told).
SPAN = "struct<start:long,length:long,type:string,data_start:long,data_length:long>"
SNIFFED = f"struct<type:string,corrected:boolean,spans:array<{SPAN}>>"

Found = tuple[int, int, int] | None  # end, start of data, length of data


def _png(b: bytes, at: int, memo: dict) -> Found:
    i, data, size = at + 8, -1, 0
    while i + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, i)
        kind, end = b[i + 4 : i + 8], i + 12 + n
        if end > len(b) or (i == at + 8) != (kind == b"IHDR") or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IDAT":
            data, size = (i + 8 if data < 0 else data), size + n
        if kind == b"IEND":
            return (end, data, size) if data >= 0 else None
        i = end
    return None


def _gif(b: bytes, at: int, memo: dict) -> Found:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i, images = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0
    while i < len(b):
        if b[i] == 0x3B:
            return (i + 1, -1, 0) if images else None
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 <= len(b):
            images += 1
            i += 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0)
        else:
            return None
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return None


def _jpeg(b: bytes, at: int, memo: dict) -> Found:
    i, frame = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        kind = b[i + 1]
        (n,) = struct.unpack_from(">H", b, i + 2)
        if kind == 0xFF:
            i += 1
            continue
        if n < 2 or kind < 0xC0 or 0xD0 <= kind <= 0xD9:
            return None
        frame |= kind in (0xC0, 0xC1, 0xC2)
        i += 2 + n
        if kind == 0xDA:
            while True:  # the scan: 255 is followed by 0 or a restart mark
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0xD9:
                    return (i + 2, -1, 0) if frame else None
                if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                    break
                i += 2
    return None


def _bmp(b: bytes, at: int, memo: dict) -> Found:
    if at + 18 > len(b):
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    if reserved or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= pixels < size <= len(b) - at:
        return None
    return at + size, at + pixels, size - pixels


def _riff(form: bytes, need: tuple[bytes, ...], data: bytes) -> Callable[[bytes, int, dict], Found]:
    def walk(b: bytes, at: int, memo: dict) -> Found:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        i, kinds, start, size = at + 12, set(), -1, 0
        while i + 8 <= end:
            kind, (n,) = b[i : i + 4], struct.unpack_from("<I", b, i + 4)
            if i + 8 + n > end:
                return None
            if kind == b"fmt " and (n < 16 or 0 in struct.unpack_from("<HHI", b, i + 8)):
                return None
            if kind.startswith(data) and start < 0:
                start, size = i + 8, n
            kinds.add(kind)
            i += 8 + n + (n & 1)
        return (end, start, size) if start >= 0 and i in (end, end + 1) and kinds.issuperset(need) else None

    return walk


def _places(b: bytes, mark: bytes, memo: dict) -> list[int]:
    """Where mark is in b; found once for each value."""
    if mark not in memo:
        out, at = [], b.find(mark)
        while at >= 0:
            out.append(at)
            at = b.find(mark, at + len(mark))
        memo[mark] = out
    return memo[mark]


def _pdf(b: bytes, at: int, memo: dict) -> Found:
    ends, heads, refs = (_places(b, x, memo) for x in (b"%%EOF", b"%PDF-", b"startxref"))
    i = bisect_left(ends, at)
    if i == len(ends):
        return None
    h = bisect_left(heads, ends[i] + 5)  # all ends up to the next file's head are revisions of this one
    end = ends[(bisect_left(ends, heads[h]) if h < len(heads) else len(ends)) - 1]
    r = bisect_left(refs, at)
    return (end + 5, -1, 0) if r < len(refs) and refs[r] + 9 <= end else None


def _zip(b: bytes, at: int, memo: dict) -> Found:
    if _zip not in memo:
        memo[_zip] = files = {}  # by start, which an end record tells
        for i in _places(b, b"PK\x05\x06", memo):
            if i + 22 <= len(b):
                n, size, start, note = struct.unpack_from("<HIIH", b, i + 10)
                begin = i - size - start
                if begin >= 0 and i + 22 + note <= len(b) and (not n or b[begin + start : begin + start + 4] == b"PK\x01\x02"):
                    files.setdefault(begin, (i + 22 + note, begin, start))
    return memo[_zip].get(at)


def _gzip(b: bytes, at: int, memo: dict) -> Found:
    d, rest = zlib.decompressobj(31), memoryview(b)[at:]
    try:
        d.decompress(rest, 1 << 20)
        while not d.eof and d.unconsumed_tail:
            d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return (len(b) - len(d.unused_data), -1, 0) if d.eof else None


def _ogg(b: bytes, at: int, memo: dict) -> Found:
    """Pages of one serial number up to one that is marked as last; where they end is remembered for all of them."""
    i, serial, seen, end = at, b[at + 14 : at + 18], [], None
    while i + 27 <= len(b) and b[i : i + 5] == b"OggS\0" and b[i + 14 : i + 18] == serial:
        if (_ogg, i) in memo:
            end = memo[_ogg, i]
            break
        seen.append(i)
        n = b[i + 26]
        last, i = b[i + 5] & 4, i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if i > len(b):
            break
        if last:
            end = (i, -1, 0)
            break
    memo.update(((_ogg, x), end) for x in seen)
    return end


_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"udta", b"meta", b"uuid", b"sidx", b"styp", b"wide")


def _mp4(b: bytes, at: int, memo: dict) -> Found:
    i, kinds, data, size = at, set(), -1, 0
    while i + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        head = 8
        if kind not in _BOXES:
            break  # what follows the file
        if n == 1 and i + 16 <= len(b):
            (n,), head = struct.unpack_from(">Q", b, i + 8), 16
        elif n == 0:
            n = len(b) - i  # to the end
        if n < head or i + n > len(b):
            return None
        if kind == b"mdat" and data < 0:
            data, size = i + head, n - head
        kinds.add(kind)
        i += n
    return (i, data, size) if {b"ftyp", b"moov"} <= kinds else None


#: Magic bytes, how far they lie from the start, the type, its validator.
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int, dict], Found]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WAVE", 8, "audio/wav", _riff(b"WAVE", (b"fmt ", b"data"), b"data")),
    (b"WEBP", 8, "image/webp", _riff(b"WEBP", (), b"VP8")),
    (b"AVI ", 8, "video/x-msvideo", _riff(b"AVI ", (b"LIST",), b"LIST")),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
]
TYPES = {f[2] for f in FORMATS}


def spans(b: bytes, automaton) -> list[dict]:
    """Confirmed files in b, embedded ones included, by start."""
    out, memo = [], {}
    for end, hits in automaton.iter(b.decode("latin-1")):
        for magic, back, kind, confirm in hits:
            at = end + 1 - len(magic) - back
            if at >= 0 and (kind not in ("audio/wav", "image/webp", "video/x-msvideo") or b[at : at + 4] == b"RIFF") and (found := confirm(b, at, memo)):
                stop, data, size = found
                out.append({"start": at, "length": stop - at, "type": kind, "data_start": data - at if data >= 0 else -1, "data_length": size})
    # Ogg pages after the first, and parts of a zip after its first entry, begin no file of their own.
    whole, kept = {}, []
    for s in sorted(out, key=lambda s: (s["start"], s["type"])):
        stop = s["start"] + s["length"]
        if s["type"] in ("audio/ogg", "application/zip", "application/pdf") and whole.get(s["type"], -1) >= stop:
            continue
        whole[s["type"]] = max(stop, whole.get(s["type"], -1))
        kept.append(s)
    return kept


def sniff(content: Column, declared: Column) -> Column:
    """A struct (type, corrected, spans) for each binary value and the type it was declared as."""

    @F.arrow_udf(SNIFFED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton, by_magic = ahocorasick.Automaton(), {}
        for f in FORMATS:
            by_magic.setdefault(f[0], []).append(f)
        for magic, hits in by_magic.items():
            automaton.add_word(magic.decode("latin-1"), hits)
        automaton.make_automaton()
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("data_start", pa.int64()), ("data_length", pa.int64())])
        for values, names in batches:
            out = []
            for value, name in zip(values, names.to_pylist(), strict=True):
                found = spans(b, automaton) if (b := value.as_py()) else []
                told = next((s["type"] for s in found if s["start"] == 0), "application/octet-stream" if name is None or name in TYPES else name)
                out.append({"type": told, "corrected": told != name, "spans": found})
            yield pa.array(out, pa.struct([("type", pa.string()), ("corrected", pa.bool_()), ("spans", pa.list_(kind))]))

    return run(content, declared)


def carve(df: DataFrame, content: str, sniffed: str) -> DataFrame:
    """A row for each confirmed span, with df's columns and ``carved`` (start, length, type, data_start, data_length, bytes, data)."""
    s, name = common.fresh(df, "span", "carved")
    out = df.withColumn(s, F.explode(F.col(sniffed)["spans"]))
    whole = F.substring(content, F.col(s)["start"].cast("int") + 1, F.col(s)["length"].cast("int"))
    data = F.when(F.col(s)["data_start"] >= 0, F.substring(content, (F.col(s)["start"] + F.col(s)["data_start"]).cast("int") + 1, F.col(s)["data_length"].cast("int")))
    return out.withColumn(name, F.struct(f"{s}.*", whole.alias("bytes"), data.alias("data"))).drop(s)


def _le(n: Column, width: int) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]))


def as_wav(payload: Column, rate: int = 8_000) -> Column:
    """Bytes as the 8-bit samples of a mono WAV file: lossless, with a header of 44 bytes."""
    n = F.octet_length(payload).cast("long")
    fixed = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data"
    odd = F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return F.concat(F.lit(b"RIFF"), _le(n + 36 + n % 2, 4), F.lit(fixed), _le(n, 4), payload, odd)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.texts(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    n = F.octet_length("b").cast("long")
    pad = F.lit(192) * F.greatest(F.lit(1), F.ceil(n / 192)).cast("long") - n
    stored = docs.select("doc_id", n.alias("n_bytes"), as_wav(F.concat("b", F.repeat(F.lit(" "), pad.cast("int")).cast("binary"))).alias("media"))
    read = stored.withColumn("sniffed", sniff(F.col("media"), F.lit("application/octet-stream")))
    first = F.element_at("sniffed.spans", 1)
    payload = F.substring("media", (first["start"] + first["data_start"]).cast("int") + 1, first["data_length"].cast("int"))
    feature = F.concat_ws(
        ";", F.col("sniffed.type"), F.concat(F.lit("samples="), first["data_length"]), F.concat(F.lit("header="), first["data_start"]), F.concat(F.lit("embedded="), F.size("sniffed.spans") - 1),
        F.array_join(F.transform(F.slice("sniffed.spans", F.lit(2), F.size("sniffed.spans")), lambda s: F.concat(s["type"], F.lit("@"), s["start"], F.lit("+"), s["length"])), ","),
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


