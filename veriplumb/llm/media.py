"""Media columns: bytes kept as PNG images in binary columns, and hashes of their low frequencies.

An image is 24 samples wide, 8-bit grey; a payload of 576 k bytes has 24 k rows. The writer stores signature, header,
one compressed data chunk and end chunk, each with its checksum. The reader walks the chunks, tests every checksum and
length, inflates, and undoes the row filters with numpy. The hash averages the image to 24 x 24 samples, takes the 8 x 8
lowest cosine frequencies and sets a bit for each that exceeds their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, record, small_batches

#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, UNIT, FILL = 24, 576, b"\xff"


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


COSINES = _cosines()


def payload_of(data: bytes) -> bytes:
    """``data`` filled up with bytes 255 to a positive multiple of 576."""
    return data + FILL * ((-len(data)) % UNIT if data else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c


def write_png(payload: bytes, width: int = SIDE, filters: np.ndarray | None = None, level: int = 6) -> bytes:
    """An 8-bit grey PNG of ``payload``. ``filters`` gives each row's filter type; by default the better of none and sub."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    if filters is None:
        sub = rows - left
        size = lambda x: np.minimum(x, 256 - x.astype(np.int16)).sum(1)
        kinds = (size(sub) < size(rows)).astype(np.uint8)
        coded = np.where(kinds[:, None] == 1, sub, rows)
    else:
        kinds = np.asarray(filters, np.uint8)
        up = np.vstack([np.zeros((1, width), np.uint8), rows[:-1]])
        corner = np.zeros_like(rows)
        corner[:, 1:] = up[:, :-1]
        mean = ((left.astype(np.int16) + up) // 2).astype(np.uint8)
        p = left.astype(np.int16) + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        best = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        coded = np.choose(kinds[:, None], [rows, rows - left, rows - up, rows - mean, rows - best])
    body = np.empty((len(rows), width + 1), np.uint8)
    body[:, 0] = kinds
    body[:, 1:] = coded
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace; ValueError for any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("PNG is cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ValueError("PNG is cut short")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r} is wrong")
        at += 12 + n
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey PNG without interlace is read")
    width, height = header[:2]
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != height * (width + 1):
        raise ValueError("PNG has the wrong number of samples")
    body = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return _unfilter(body[:, 0], body[:, 1:])


def _unfilter(kinds: np.ndarray, coded: np.ndarray) -> np.ndarray:
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown PNG filter")
    out = np.where(kinds[:, None] == 1, np.cumsum(coded, axis=1, dtype=np.uint8), coded)  # rows that need no other row
    above = np.zeros(coded.shape[1], np.uint8)
    for y in np.flatnonzero(kinds >= 2).tolist():
        above = out[y - 1] if y else np.zeros(coded.shape[1], np.uint8)
        if kinds[y] == 2:
            out[y] = coded[y] + above
            continue
        row, a, c = bytearray(coded[y].tobytes()), 0, 0
        for x, b in enumerate(above.tolist()):
            a = row[x] = (row[x] + ((a + b) // 2 if kinds[y] == 3 else _paeth(a, b, c))) & 255
            c = b
        out[y] = np.frombuffer(row, np.uint8)
    return out


def low_frequency_hash(image: np.ndarray) -> str:
    """16 hex digits; images of fewer than 24 rows or another width are stretched by repeating samples."""
    h, w = image.shape
    if h < SIDE or h % SIDE or w != SIDE:
        image = image[np.arange(max(h, SIDE) // SIDE * SIDE) * h // (max(h, SIDE) // SIDE * SIDE)][:, np.arange(SIDE) * w // SIDE]
    small = image.reshape(SIDE, -1, SIDE).mean(axis=1)
    low = (COSINES @ small @ COSINES.T).ravel()
    bits = low > np.median(low)
    return np.packbits(bits).tobytes().hex()


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text"):
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        yield record(STORED, b.column("doc_id"), [len(t) for t in texts], [write_png(payload_of(t)) for t in texts])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "media"):
        rows = []
        for media in b.column("media").to_pylist():
            image = read_png(media)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), low_frequency_hash(image)))
        yield record(READ, b.column("doc_id"), b.column("n_bytes"), *(list(c) for c in zip(*rows, strict=True)))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: a PNG in a binary column for each row of ``docs``.

    Null text is empty text, and empty text an image of 576 bytes 255; equal texts give equal images; rows that repeat
    stay; null ids stay null; no rows give no rows; further columns are ignored. A row's image is all that is in memory.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads each image back: size, digest and tail checksum of the payload, size and digest of the image, and hash."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
