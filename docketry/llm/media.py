"""Media columns: signature sniffing, validation, carving and lossless storage of payloads as samples.

One Aho-Corasick automaton finds the magic bytes of all formats in one pass over the bytes; the format's validator
then checks structure and lengths, so that a magic number in running text isn't taken for a file. The declared type
is corrected by a valid signature at offset 0, and valid signatures further in are carved out as embedded media.

Edge cases: null contents give no findings and type ``application/octet-stream``; cut-off files fail their validator;
overlapping findings are all reported, by offset and then type; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

UNKNOWN = "application/octet-stream"

# Magic bytes of the formats and where in the file they stand.
SIGNATURES = [
    ("audio/flac", b"fLaC", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
    ("application/ogg", b"OggS", 0),
    ("application/pdf", b"%PDF-", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("audio/wav", b"RIFF", 0),
    ("image/bmp", b"BM", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/webp", b"WEBP", 8),
    ("video/mp4", b"ftyp", 4),
]


def _png(b: bytes, at: int) -> int:
    pos = at + 8
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or (pos == at + 8 and kind != b"IHDR"):
            return 0
        if kind == b"IEND":
            return end - at
        pos = end
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1 - at
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 11 <= len(b):
            pos += 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0)
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        if b[pos + 1] == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return end + 2 - at if end > 0 else 0
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
    return 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return 0
    pos = at + 12
    while pos + 8 <= end:
        size = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + size + (size & 1)
    return end - at if pos == end else 0


def _webp(b: bytes, at: int) -> int:
    if b[at : at + 4] != b"RIFF" or at + 16 > len(b) or b[at + 12 : at + 15] != b"VP8":
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    return size if size <= len(b) - at else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, spare, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if spare == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(b) - at else 0


def _pdf(b: bytes, at: int) -> int:
    """Up to the last end mark before the next file, so that later revisions belong to it."""
    after = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, after if after > 0 else len(b))
    return end + 5 - at if end > 0 and b[at + 5 : at + 6].isdigit() and b.find(b"startxref", at, end) > 0 else 0


def _zip(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    """Inflated piece by piece, and nothing of it is kept."""
    reader, pos, view = zlib.decompressobj(31), at, memoryview(b)
    try:
        while not reader.eof and (pos < len(b) or reader.unconsumed_tail):
            piece = reader.unconsumed_tail or view[pos : pos + 65536]
            pos += 0 if reader.unconsumed_tail else len(piece)
            reader.decompress(piece, 1 << 20)
    except zlib.error:
        return 0
    return pos - at - len(reader.unused_data) if reader.eof else 0


def _ogg(b: bytes, at: int) -> int:
    """Pages of the first one's stream, up to the one that ends it; other streams' pages may stand between."""
    if at + 27 > len(b) or not b[at + 5] & 2:
        return 0
    serial, pos = b[at + 14 : at + 18], at
    while pos + 27 <= len(b) and b[pos : pos + 4] == b"OggS" and not b[pos + 4] and b[pos + 5] <= 7:
        table = pos + 27 + b[pos + 26]
        end = table + sum(b[pos + 27 : table])
        if end > len(b):
            return 0
        if b[pos + 14 : pos + 18] == serial and b[pos + 5] & 4:
            return end - at
        pos = end
    return 0


def _flac(b: bytes, at: int) -> int:
    ok = at + 42 <= len(b) and b[at + 4] & 0x7F == 0 and b[at + 5 : at + 8] == b"\0\0\x22"
    return len(b) - at if ok else 0


def _mp4(b: bytes, at: int) -> int:
    """Boxes one after another, with lengths of 32 or 64 bits; one of length 0 reaches to the end."""
    pos = at
    while pos + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack_from(">Q", b, pos + 8)[0]
        if size == 0 and kind.isalnum():
            return len(b) - at
        if size < 8 or pos + size > len(b) or not kind.isalnum():
            break
        pos += size
    return pos - at


VALIDATORS = {
    "application/gzip": _gzip,
    "application/ogg": _ogg,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "audio/flac": _flac,
    "audio/wav": _riff,
    "image/bmp": _bmp,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/png": _png,
    "image/webp": _webp,
    "video/mp4": _mp4,
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (_, magic, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def find_media(content: bytes, machine) -> list[tuple[int, int, str]]:
    """Valid media in ``content``: (offset, length, type)."""
    out = []
    for last, k in machine.iter(content.decode("latin-1")):
        kind, magic, lead = SIGNATURES[k]
        at = last + 1 - len(magic) - lead
        if at >= 0 and (size := VALIDATORS[kind](content, at)):
            out.append((at, size, kind))
    return sorted(out)


FOUND = "type string, declared string, corrected boolean, media array<struct<offset: bigint, length: bigint, type: string>>"


def sniff(df: DataFrame, key: str, content: str, declared: str) -> DataFrame:
    """Per row: key, type (from the bytes, else unknown), declared, corrected, media (embedded ones, to carve)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = []
            for body, said in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                found = find_media(body or b"", machine)
                kind = next((t for at, _, t in found if at == 0), UNKNOWN)
                rows.append({"type": kind, "declared": said, "corrected": kind not in (said, UNKNOWN), "media": [{"offset": a, "length": n, "type": t} for a, n, t in found if a]})
            own = pa.Table.from_pylist(rows, schema=pa.schema([("type", pa.string()), ("declared", pa.string()), ("corrected", pa.bool_()), ("media", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))]))
            yield from own.add_column(0, key, pa.chunked_array([batch[0]])).combine_chunks().to_batches()

    return df.select(key, content, declared).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {FOUND}")


def to_wave(payload: bytes) -> bytes:
    """8-bit mono samples under a canonical header; an odd payload gets the format's pad byte."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload + pad


def samples(wave: bytes) -> bytes:
    """The samples of a stored file, read chunk by chunk."""
    pos = 12
    while pos + 8 <= len(wave):
        kind, size = struct.unpack_from("<4sI", wave, pos)
        if kind == b"data":
            return wave[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no samples in this file")


STORED = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]


def payload_features(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Whole texts stored as samples, read back and sniffed: one row per document, with the file on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(STORED) + keep_media)]
            for text in batch[1]:
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                stored = to_wave(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)))
                found = find_media(stored, machine)
                kind = next((t for at, _, t in found if at == 0), UNKNOWN)
                back = samples(stored)
                inner = [(a, n, t) for a, n, t in found if a]
                values = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{kind};{';'.join(f'{t}@{a}+{n}' for a, n, t in inner)}"]
                for column, value in zip(columns, values + [stored] * keep_media, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(c) for c in columns)] if columns[0] else [batch[0], *(pa.array([], pa.int64() if t == "bigint" else pa.string()) for _, t in STORED), *[pa.array([], pa.binary())] * keep_media], names=["doc_id", *(n for n, _ in STORED), *["media"] * keep_media])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in STORED) + ", media binary" * keep_media
    return docs.select("doc_id", "text").mapInArrow(run, schema)
