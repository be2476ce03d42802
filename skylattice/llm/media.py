"""Media columns by signature sniffing (operator 3).

An Aho-Corasick automaton locates the magic bytes of all known formats in one pass.  A validator for each format
confirms the structure and its lengths, so that a chance hit is not taken for a file.  The format found at the start
corrects the declared type; valid files further in are carved.

``text_media`` stores each text as one channel of 8-bit samples in a WAVE file: its UTF-8 bytes, followed by spaces up
to a positive multiple of 192.  The files are written to the shared folder, read again, sniffed and measured.  Null
texts count as empty.  Equal texts give equal values; repeated rows are answered one by one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import own_columns, plainly_named, small_batches, stored, texts_of

UNIT = 192


def wave(samples: bytes, rate: int = 8000) -> bytes:
    """A WAVE file of one channel of unsigned 8-bit samples (an even number of them)."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _wave_end(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end, k, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return None
    while k + 8 <= end:
        name, size = b[k : k + 4], struct.unpack_from("<I", b, k + 4)[0]
        if k + 8 + size > end:
            return None
        seen.add(name)
        k += 8 + size + size % 2
    return end if {b"fmt ", b"data"} <= seen else None


def wave_samples(b: bytes) -> bytes:
    """The bytes of the data chunk of a valid WAVE file."""
    k = 12
    while b[k : k + 4] != b"data":
        size = struct.unpack_from("<I", b, k + 4)[0]
        k += 8 + size + size % 2
    return b[k + 8 : k + 8 + struct.unpack_from("<I", b, k + 4)[0]]


def _png_end(b: bytes, at: int) -> int | None:
    k, first = at + 8, True
    while k + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, k)
        if k + 12 + size > len(b) or first and name != b"IHDR" or zlib.crc32(b[k + 4 : k + 8 + size]) != struct.unpack_from(">I", b, k + 8 + size)[0]:
            return None
        first, k = False, k + 12 + size
        if name == b"IEND":
            return k
    return None


def _gif_end(b: bytes, at: int) -> int | None:
    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    if len(b) < at + 13:
        return None
    k, images = at + 13 + table(b[at + 10]), 0
    while k < len(b):
        if b[k] == 0x3B:
            return k + 1 if images else None
        if b[k] == 0x2C and k + 10 < len(b):
            images, k = images + 1, k + 11 + table(b[k + 9])
        elif b[k] == 0x21:
            k += 2
        else:
            return None
        while k < len(b) and b[k]:
            k += 1 + b[k]
        k += 1
    return None


def _bmp_end(b: bytes, at: int) -> int | None:
    if len(b) < at + 30:
        return None
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    if header not in (12, 40, 52, 56, 108, 124) or not 14 + header <= start <= size or at + size > len(b):
        return None
    width, height, planes, bits = struct.unpack_from("<HHHH" if header == 12 else "<iiHH", b, at + 18)
    packed = 0 if header == 12 else struct.unpack_from("<I", b, at + 30)[0] if len(b) >= at + 34 else 9
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0 or packed > 6:
        return None
    plain = packed in (0, 3, 6)  # rows of whole four bytes each
    return at + size if not plain or start + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _jpeg_end(b: bytes, at: int) -> int | None:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        mark, size = b[k + 1], struct.unpack_from(">H", b, k + 2)[0]
        if size < 2:
            return None
        k += 2 + size
        if mark == 0xDA:  # picture data up to the end mark; a stuffed 00 or a restart mark is data
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b):
                if b[k + 1] == 0xD9:
                    return k + 2
                if b[k + 1] and not 0xD0 <= b[k + 1] <= 0xD7:
                    break
                k += 2
            if k < 0:
                return None
    return None


def _pdf_end(b: bytes, at: int) -> int | None:
    """The last end mark of the file: an update adds another one, after a cross-reference of its own."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    end, limit = None, b.find(b"%PDF-", at + 5)
    limit, k = len(b) if limit < 0 else limit, at
    while (mark := b.find(b"%%EOF", k, limit)) >= 0 and b.find(b"startxref", k, mark) >= 0:
        end = k = mark + 5
    return end


def _zip_end(b: bytes, at: int) -> int | None:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note if at + start + size == end and end + 22 + note <= len(b) else None


def _gzip_end(b: bytes, at: int) -> int | None:
    if b[at + 3 : at + 4] and b[at + 3] & 0xE0:
        return None
    d, view, k = zlib.decompressobj(31), memoryview(b), at
    try:
        while not d.eof and k < len(b):
            rest = view[k : k + 65536]
            k += len(rest)
            while rest and not d.eof:  # what comes out is dropped a megabyte at a time
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
        while not d.eof and d.decompress(b"", 1 << 20):
            pass
    except zlib.error:
        return None
    return k - len(d.unused_data) if d.eof else None


def _crc_table(bits: int, poly: int) -> list[int]:
    top, out = 1 << (bits - 1), []
    for k in range(256):
        c = k << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) if c & top else c << 1
        out.append(c & ((1 << bits) - 1))
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_frame(b: bytes, k: int) -> int | None:
    """Samples of the frame whose header stands at k: its sync, its fields and its checksum hold."""
    if len(b) < k + 6 or b[k] != 0xFF or b[k + 1] & 0xFE != 0xF8:
        return None
    size, rate = b[k + 2] >> 4, b[k + 2] & 15
    if size == 0 or rate == 15 or b[k + 3] >> 4 > 10 or b[k + 3] & 1:
        return None
    lead = b[k + 4]
    more = 0 if lead < 0x80 else next((n for n in range(1, 7) if lead >> (6 - n) == (1 << (n + 2)) - 2), 99)
    at = k + 5 + more
    extra = {6: 1, 7: 2}.get(size, 0)
    end = at + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if more == 99 or len(b) <= end:
        return None
    c = 0
    for x in b[k:end]:
        c = _CRC8[c ^ x]
    if c != b[end]:
        return None
    return int.from_bytes(b[at : at + extra], "big") + 1 if extra else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)


def _flac_end(b: bytes, at: int) -> int | None:
    """Metadata blocks, then frames that follow each other: each ends where its checksum comes out."""
    if len(b) < at + 42 or b[at + 4] & 0x7F or b[at + 5 : at + 8] != b"\0\0\x22":
        return None
    low, high = struct.unpack_from(">HH", b, at + 8)
    longest, packed = int.from_bytes(b[at + 15 : at + 18], "big"), int.from_bytes(b[at + 18 : at + 26], "big")
    if low < 16 or high < low or not packed >> 44:
        return None
    left, k, last = packed & ((1 << 36) - 1), at + 4, False
    while not last:
        if len(b) < k + 4:
            return None
        last, k = bool(b[k] & 0x80), k + 4 + int.from_bytes(b[k + 1 : k + 4], "big")
    unknown, frames = left == 0, 0
    while (n := _flac_frame(b, k)) is not None and (unknown or left > 0):
        c, end = 0, min(len(b), k + (longest or 1 << 20))
        for j in range(k, end):
            c = (c << 8 & 0xFF00) ^ _CRC16[c >> 8 ^ b[j]]
            if c == 0 and j > k + 6 and (j + 1 == len(b) or left <= n and not unknown or _flac_frame(b, j + 1) is not None):
                k, left, frames = j + 1, left - n, frames + 1
                break
        else:
            break
    return k if frames and (unknown or left <= 0) else None


def _mp4_end(b: bytes, at: int) -> int | None:
    k, n = at, 0
    while k + 8 <= len(b):
        size = struct.unpack_from(">I", b, k)[0]
        if size < 8 or k + size > len(b) or not b[k + 4 : k + 8].isalnum():
            break
        k, n = k + size, n + 1
    return k if n > 1 else None


#: magic bytes, how far they stand from the start, type, and what finds the end of a valid file
FORMATS: tuple[tuple[bytes, int, str, Callable[[bytes, int], int | None]], ...] = (
    (b"RIFF", 0, "audio/wav", _wave_end),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png_end),
    (b"GIF87a", 0, "image/gif", _gif_end),
    (b"GIF89a", 0, "image/gif", _gif_end),
    (b"BM", 0, "image/bmp", _bmp_end),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg_end),
    (b"%PDF-", 0, "application/pdf", _pdf_end),
    (b"PK\x03\x04", 0, "application/zip", _zip_end),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip_end),
    (b"fLaC", 0, "audio/flac", _flac_end),
    (b"ftyp", 4, "video/mp4", _mp4_end),
)


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (magic, *_rest) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def sniff(data: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type of the file at the start, and the valid files (type, start, end) further in, none inside another carved one."""
    hits = []
    for last, k in _automaton().iter(data.decode("latin-1")):
        start = last + 1 - len(FORMATS[k][0]) - FORMATS[k][1]
        if start >= 0:
            hits.append((start, k))
    kind, carved, free = None, [], 0
    for start, k in sorted(hits):
        if start and start < free:
            continue
        end = FORMATS[k][3](data, start)
        if end is None:
            continue
        if start == 0:
            kind = kind or FORMATS[k][2]
        else:
            carved.append((FORMATS[k][2], start, end))
            free = end
    return kind, carved


def sniff_media(files: DataFrame, data_col: str = "media", type_col: str = "declared") -> DataFrame:
    """Add to each row: ``found`` type (null: none is valid), ``corrected`` (whether it differs from the declared one) and
    ``carved`` files (type, start, end, sha256).  Null data has no type and nothing carved.  Columns of these three names are replaced, all
    others stay."""
    out_type = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sha256", pa.string())]))
    files = files.select(*[c for c, name in zip(own_columns(files), files.columns, strict=True) if name.lower() not in ("found", "corrected", "carved")])
    plain = plainly_named(files)
    data_at, type_at = (f"c{files.columns.index(c)}" for c in (data_col, type_col))
    sql = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", found string, corrected boolean, carved array<struct<type:string,start:long,end:long,sha256:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, data_at, 4 << 20):
            found, carved = [], []
            for x in batch.column(data_at):
                data = x.as_py()
                kind, inner = sniff(data) if data else (None, [])
                found.append(kind)
                carved.append([{"type": t, "start": a, "end": b, "sha256": hashlib.sha256(data[a:b]).hexdigest()} for t, a, b in inner])
            corrected = [f is not None and f != d for f, d in zip(found, batch.column(type_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(corrected), pa.array(carved, out_type)], names=[*batch.schema.names, "found", "corrected", "carved"])

    return plain.mapInArrow(run, sql).toDF(*files.columns, "found", "corrected", "carved")


def _stores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 4 << 20):
        sizes, media = [], []
        for x in batch.column("text"):
            data = (x.as_py() or "").encode()
            sizes.append(len(data))
            media.append(wave(data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(["application/octet-stream"] * len(media)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


_MEASURED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("found", pa.string()), ("carved", pa.int32())])


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "media", 4 << 20):
        rows = []
        for doc, n, declared, media in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "declared", "media")), strict=True):
            media = media.as_py()
            kind, carved = sniff(media)
            payload = wave_samples(media)
            level = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = level[level > 0] / len(payload)
            mean = float(level @ np.arange(256)) / len(payload)
            feature = f"type={kind};corrected={int(kind != declared.as_py())};samples={len(payload)};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};carved={','.join(f'{t}@{a}-{b}' for t, a, b in carved)}"
            rows.append((doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, len(carved)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_MEASURED), _MEASURED, strict=True)], schema=_MEASURED)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, measured on the files as read again: see ``_MEASURED`` for the columns."""
    files = stored(texts_of(docs, id_col, text_col).mapInArrow(_stores, "doc_id long, n_bytes long, declared string, media binary"), "media")
    return files.mapInArrow(_measures, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, found string, carved int")
