"""Media columns: texts as greyscale PNG bytes in binary columns, read back and hashed."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of compressed data in one IDAT chunk.
CHUNK = 1 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(text: str | None) -> bytes:
    b = (text or "").encode()
    return b + bytes(max(WIDTH, -(-len(b) // WIDTH) * WIDTH) - len(b))


def encode_png(data: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """8-bit greyscale, one sample a byte; every row is filtered by Up. len(data): a multiple of width."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = 2
    out[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=out[1:, 1:])
    packed = zlib.compress(out.tobytes(), level)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The samples of one-byte pixels, from filtered rows; runs of None and Up rows go at once."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    i, n = 0, len(rows)
    while i < n:
        kind, j = kinds[i], i + 1
        while j < n and kinds[j] == kind and kind in (0, 1, 2):
            j += 1
        if kind == 0:
            out[i:j] = rows[i:j]
        elif kind == 1:
            np.cumsum(rows[i:j], axis=1, dtype=np.uint8, out=out[i:j])
        elif kind == 2:
            np.cumsum(rows[i:j], axis=0, dtype=np.uint8, out=out[i:j])
            out[i:j] += above
        elif kind in (3, 4):
            left, up_left, up = 0, 0, above.tolist()
            line = rows[i].tolist()
            for k, x in enumerate(line):
                guess = (left + up[k]) // 2 if kind == 3 else _paeth(left, up[k], up_left)
                left = line[k] = (x + guess) & 255
                up_left = up[k]
            out[i] = line
        else:
            raise ValueError(f"PNG row filter {kind}")
        above = out[j - 1]
        i = j
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit greyscale PNG without interlace. Raises ValueError on a wrong
    signature, chunk checksum, order or size; zlib tests the checksum of the data itself."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("PNG chunk cut off")
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(media):
            raise ValueError("PNG chunk cut off")
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"PNG checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = head[:2]
    flat = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if flat.size != height * (width + 1):
        raise ValueError("PNG data size")
    flat = flat.reshape(height, width + 1)
    return unfilter(flat[:, 0], flat[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(k), 2 * np.arange(n) + 1) / (2 * n))


SIDE, LOW = 32, 8
_BASIS = _cosines(SIDE, LOW)


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: the image averaged down to 32 x 32, its 8 x 8 lowest cosine coefficients, one bit for
    each that is above their median (the constant one is left out of the median)."""
    h, w = samples.shape
    cum = np.zeros((h + 1, w))
    np.cumsum(samples, axis=0, dtype=np.float64, out=cum[1:])

    def shrink(c: np.ndarray, n: int) -> np.ndarray:
        """Means of SIDE equal parts from the running sums c of n rows, parts of rows by share."""
        at = np.linspace(0, n, SIDE + 1)
        i = np.minimum(at.astype(int), n - 1)
        v = c[i] + (at - i)[:, None] * (c[i + 1] - c[i])
        return np.diff(v, axis=0) * (SIDE / n)

    small = shrink(cum, h)
    cum = np.zeros((w + 1, SIDE))
    np.cumsum(small.T, axis=0, out=cum[1:])
    low = np.round(_BASIS @ shrink(cum, w).T @ _BASIS.T, 6)
    flat = low.ravel()
    return np.packbits(flat > np.median(flat[1:])).tobytes()


SCHEMA = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as PNG. Null: empty, which is one row of zeros."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256).to_pylist()
                media = [encode_png(payload(t)) for t in part]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array([len((t or "").encode()) for t in part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def read_media(media: DataFrame) -> DataFrame:
    """Digests and feature (hex of cosine_hash) of a table (doc_id, n_bytes, media), from the stored bytes."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                samples = decode_png(m)
                b = samples.tobytes()
                rows.append((i, n, len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(samples).hex()))
            names = [x.split()[0] for x in READ.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return media.mapInArrow(run, READ)
