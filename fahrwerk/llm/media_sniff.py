"""Media columns: signature sniffing, validation and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one
pass over a value; a validator for each format then confirms its structure
and total length.  What is confirmed at offset 0 is the value's actual type,
whatever was declared; what is confirmed further in, inside bytes that no
earlier find covers (the outer container aside), is embedded media and is
carved by offset and length.

``store_media`` makes media of texts: UTF-8 padded with spaces to a positive
multiple of 192 bytes, as samples of one of four lossless formats.

Null values are empty: no type, nothing embedded.  Null texts are stored as
empty ones (192 spaces).  Equal texts give equal media and features, and rows
that repeat a doc_id each have their own.  Where two formats' magic bytes
begin at one place, the name that comes first counts if it is confirmed.
Texts of any length are stored whole.  An empty table gives an empty result.
Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textvec as tv

UNIT = 192
#: Magic bytes of formats, by name.
MAGIC = [
    ("wav", b"RIFF"),
    ("bmp", b"BM"),
    ("png", b"\x89PNG\r\n\x1a\n"),
    ("au", b".snd"),
    ("gif", b"GIF87a"),
    ("gif", b"GIF89a"),
    ("jpeg", b"\xff\xd8\xff"),
    ("flac", b"fLaC"),
    ("ogg", b"OggS"),
    ("gzip", b"\x1f\x8b\x08"),
    ("zip", b"PK\x03\x04"),
    ("pdf", b"%PDF-"),
    ("mp4", b"ftyp"),
]
#: What a name says that a value is; the first names are of types that ``store_media`` writes.
DECLARED = ["wav", "bmp", "png", "au", "jpeg", "bin"]


class Value(bytes):
    """Bytes that remember where marks were found, so that looking ahead from many places stays linear."""

    def after(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1; asked for in ascending order."""
        known = self.__dict__.setdefault("places", {})
        if mark not in known or 0 <= known[mark] < at:
            known[mark] = self.find(mark, at)
        return known[mark]


def _wav(b, at):
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    size = 8 + struct.unpack_from("<I", b, at + 4)[0]
    spot, kinds, data = at + 12, [], None
    while spot + 8 <= at + size and spot + 8 <= len(b):
        kind, n = b[spot : spot + 4], struct.unpack_from("<I", b, spot + 4)[0]
        kinds.append(kind)
        if kind == b"data":
            data = (spot + 8, spot + 8 + n)
        spot += 8 + n + n % 2
    if spot != at + size or b"fmt " not in kinds or data is None or at + size > len(b):
        return None
    return size, [data]


def _bmp(b, at):
    if len(b) < at + 54:
        return None
    size, zero, start, header, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or header < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h or at + size > len(b):
        return None
    row = (w * bits + 31) // 32 * 4
    if start < 14 + header or start + row * abs(h) != size:
        return None
    return size, [(at + start, at + size)]


def _png(b, at):
    spot, data, first = at + 8, [], True
    while spot + 12 <= len(b):
        n = struct.unpack_from(">I", b, spot)[0]
        kind = b[spot + 4 : spot + 8]
        end = spot + 12 + n
        if end > len(b) or first != (kind == b"IHDR") or struct.unpack_from(">I", b, end - 4)[0] != zlib.crc32(b[spot + 4 : end - 4]):
            return None
        first = False
        if kind == b"IDAT":
            data.append((spot + 8, end - 4))
        spot = end
        if kind == b"IEND":
            return spot - at, data
    return None


def _au(b, at):
    if len(b) < at + 24:
        return None
    start, size, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if start < 24 or start % 8 or not 1 <= code <= 27 or not rate or not 1 <= channels <= 16 or at + start + size > len(b):
        return None
    return start + size, [(at + start, at + start + size)]


def _gif(b, at):
    if len(b) < at + 13:
        return None
    flags = b[at + 10]
    spot = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while spot < len(b):
        mark = b[spot]
        if mark == 0x3B:
            return spot + 1 - at, []
        if mark == 0x21:
            spot += 2
        elif mark == 0x2C and spot + 10 < len(b):
            flags = b[spot + 9]
            spot += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return None
        while spot < len(b) and b[spot]:
            spot += 1 + b[spot]
        spot += 1
    return None


def _jpeg(b, at):
    spot = at + 2
    while spot + 4 <= len(b) and b[spot] == 0xFF:
        kind = b[spot + 1]
        if kind == 0xD9:
            return spot + 2 - at, []
        n = struct.unpack_from(">H", b, spot + 2)[0]
        if n < 2 or not 0xC0 <= kind <= 0xFE:
            return None
        spot += 2 + n
        if kind == 0xDA:
            while spot + 1 < len(b) and not (b[spot] == 0xFF and b[spot + 1] not in (0, *range(0xD0, 0xD8))):
                spot = b.find(b"\xff", spot + 1)
                if spot < 0:
                    return None
    return (spot + 2 - at, []) if b[spot : spot + 2] == b"\xff\xd9" else None


def _flac(b, at):
    if len(b) < at + 42 or b[at + 4] & 127 or b[at + 5 : at + 8] != b"\0\0\x22":
        return None
    return len(b) - at, []  # frames carry no total length


def _ogg(b, at):
    spot = at
    while b[spot : spot + 4] == b"OggS" and spot + 27 <= len(b):
        n = b[spot + 26]
        end = spot + 27 + n
        end += sum(b[spot + 27 : end])
        if b[spot + 4] or end > len(b):
            return None
        last, spot = b[spot + 5] & 4, end
        if last:
            break
    return (spot - at, []) if spot > at else None


def _gzip(b, at):
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    try:
        d = zlib.decompressobj(31)
        rest = memoryview(b)[at:]
        while rest and not d.eof:
            d.decompress(rest, 1 << 16)
            rest = d.unconsumed_tail
        return (len(b) - at - len(d.unused_data), []) if d.eof else None
    except zlib.error:
        return None


def _zip(b, at):
    end = b.after(b"PK\x05\x06", at)
    if end < 0 or len(b) < end + 22:
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    if at + start + size != end or end + 22 + note > len(b) or b[at + start : at + start + 4] != b"PK\x01\x02":
        return None
    return end + 22 + note - at, []


def _pdf(b, at):
    end = b.after(b"%%EOF", at)
    if end < 0 or not b[at + 5 : at + 6].isdigit() or not 0 <= b.after(b"startxref", at) < end:
        return None
    return end + 5 - at, []


def _mp4(b, at):
    spot = start = at - 4
    if start < 0:
        return None
    seen = []
    while spot + 8 <= len(b):
        n = struct.unpack_from(">I", b, spot)[0]
        kind = b[spot + 4 : spot + 8]
        if n < 8 or spot + n > len(b) or not kind.isalnum():
            break
        seen.append(kind)
        spot += n
    return (spot - start, []) if b"moov" in seen or b"mdat" in seen else None


VALID = {"wav": _wav, "bmp": _bmp, "png": _png, "au": _au, "gif": _gif, "jpeg": _jpeg, "flac": _flac, "ogg": _ogg, "gzip": _gzip, "zip": _zip, "pdf": _pdf, "mp4": _mp4}
#: Bytes of a format that stand before its magic.
LEAD = {"mp4": 4}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for name, magic in MAGIC:
            _automaton.add_word(magic.decode("latin-1"), (name, len(magic)))
        _automaton.make_automaton()
    return _automaton


def sniff(value: bytes) -> tuple[str | None, list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The actual type, embedded finds (type, offset, length), and where the outer samples lie."""
    value = Value(value)
    hits = sorted((end + 1 - n, name) for end, (name, n) in automaton().iter(value.decode("latin-1")))
    actual, samples, embedded, free = None, [], [], 0
    for at, name in hits:
        start = at - LEAD.get(name, 0)
        if start and start < free:
            continue
        if found := VALID[name](value, at):
            if start == 0 and actual is None:
                actual, samples = name, found[1]
            elif start > 0:
                embedded.append((name, start, found[0]))
                free = start + found[0]
    return actual, embedded, samples


def samples_of(value: bytes, kind: str, spots: list[tuple[int, int]]) -> bytes:
    """The stored samples, read back from a validated value."""
    raw = b"".join(value[a:b] for a, b in spots)
    if kind == "png":
        raw = zlib.decompress(raw)
        return np.frombuffer(raw, np.uint8).reshape(-1, UNIT + 1)[:, 1:].tobytes()
    if kind == "bmp":
        return np.frombuffer(raw, np.uint8).reshape(-1, UNIT)[::-1].tobytes()
    return raw


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def store(data: bytes) -> tuple[bytes, str]:
    """A payload in the format that its checksum picks, and a declared type that is not always right."""
    pick = zlib.crc32(data)
    kind = DECLARED[pick % 4]
    rows = len(data) // UNIT
    if kind == "wav":
        head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8)
        out = head + b"data" + struct.pack("<I", len(data)) + data
    elif kind == "au":
        out = b".snd" + struct.pack(">IIIII", 24, len(data), 2, 8000, 1) + data
    elif kind == "bmp":  # 64 pixels of 24 bits a row, lowest row first
        flipped = np.frombuffer(data, np.uint8).reshape(rows, UNIT)[::-1].tobytes()
        out = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(data), 0, 54, 40, UNIT // 3, rows, 1, 24, 0, len(data), 2835, 2835, 0, 0) + flipped
    else:
        body = np.zeros((rows, UNIT + 1), np.uint8)
        body[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, UNIT)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        out = MAGIC[2][1] + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body.tobytes(), 1)) + chunk(b"IEND", b"")
    return out, DECLARED[(pick >> 8) % len(DECLARED)] if (pick >> 16) % 4 == 0 else kind


def describe(samples: bytes) -> str:
    """Mean, spread and entropy of 8-bit samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n = counts.sum()
    level = np.arange(256)
    mean = (counts * level).sum() / n
    share = counts[counts > 0] / n
    return f"mean={mean:.3f};std={np.sqrt((counts * (level - mean) ** 2).sum() / n):.3f};bits={-(share * np.log2(share)).sum():.4f}"


def _sniffed(batches):
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    for ids, declared, media in tv.rows(batches, ["doc_id", "declared", "media"]):
        found = [sniff(m.as_py() or b"") for m in media]
        yield pa.RecordBatch.from_arrays(
            [ids, declared, pa.array([f[0] for f in found], pa.string()), pa.array([[dict(zip(("type", "offset", "length"), e, strict=True)) for e in f[1]] for f in found], kind)],
            ["doc_id", "declared", "actual", "embedded"],
        )


def sniff_media(media: DataFrame) -> DataFrame:
    """doc_id, declared, actual (null if nothing is confirmed) and embedded finds of each value of ``media``."""
    return media.select("doc_id", "declared", "media").mapInArrow(
        _sniffed, "doc_id long, declared string, actual string, embedded array<struct<type:string,offset:long,length:long>>"
    )


def _stored(batches):
    for ids, texts in tv.rows(batches, ["doc_id", "text"]):
        ids = ids.to_pylist()
        for i in range(0, len(ids), 200):
            made = [store(payload(t or "")[0]) for t in texts.slice(i, 200).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 200], pa.int64()), pa.array([m[1] for m in made]), pa.array([m[0] for m in made], pa.binary())], ["doc_id", "declared", "media"])


def store_media(documents: DataFrame) -> DataFrame:
    """doc_id, declared type and media of each text."""
    return documents.select("doc_id", "text").mapInArrow(_stored, "doc_id long, declared string, media binary")


_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _digest(batches):
    for ids, texts in tv.rows(batches, ["doc_id", "text"]):
        out = []
        for d, t in zip(ids.to_pylist(), texts, strict=True):
            data, n = payload(t.as_py() or "")
            media, declared = store(data)
            actual, embedded, spots = sniff(media)
            back = samples_of(media, actual, spots)
            feature = f"declared={declared};actual={actual};embedded={','.join(f'{k}@{a}+{z}' for k, a, z in embedded)};{describe(back)}"
            out.append((d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = zip(*out, strict=True) if out else [[] for _ in _FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [f for f, _ in _FIELDS])


def media_digests(documents: DataFrame) -> DataFrame:
    """Stores each text as media, sniffs the stored bytes, reads them back, and digests both."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return documents.select("doc_id", "text").mapInArrow(_digest, schema)


def op8_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
