import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sigmill.llm import media as M

from .helpers import DOCS, ODD, docs, got, prose


def test_round_trip(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, prose(rng, i * 7)) for i in range(30)]
    d = docs(spark, rows).withColumnRenamed("lang", "media")
    out = M.read_media(M.to_media(d))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    by = {}
    for r in out.collect():
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(x) == 1 for x in by.values())


def test_every_row_filter():
    """Rows filtered by None, Sub, Up, Average and Paeth, as the format defines them."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (40, 64), np.uint8)
    kinds, out, above = [], [], [0] * 64
    for i, row in enumerate(rows.tolist()):
        kind = [0, 1, 2, 3, 4, 2, 2, 1][i % 8]
        line = []
        for k, x in enumerate(row):
            a, b, c = row[k - 1] if k else 0, above[k], above[k - 1] if k else 0
            guess = [0, a, b, (a + b) // 2, M._paeth(a, b, c)][kind]
            line.append((x - guess) % 256)
        kinds.append(kind)
        out.append(line)
        above = row
    back = M.unfilter(np.array(kinds, np.uint8), np.array(out, np.uint8))
    assert (back == rows).all()
    with pytest.raises(ValueError, match="filter 5"):
        M.unfilter(np.array([5], np.uint8), rows[:1])


def test_damage_is_found():
    png = M.encode_png(M.payload("some text"))
    assert M.decode_png(png).tobytes().rstrip(b"\0") == b"some text"
    for at in range(len(png)):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises((ValueError, zlib.error, struct.error)):
            M.decode_png(bytes(bad))
    for n in range(len(png)):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            M.decode_png(png[:n])


def test_many_chunks(monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 10)
    p = M.payload("x y z " * 100)
    png = M.encode_png(p)
    assert png.count(b"IDAT") > 2 and M.decode_png(png).tobytes() == p


def test_feature_is_near_for_near_images():
    rng = random.Random(4)
    a = prose(rng, 2000)
    h = [int.from_bytes(M.cosine_hash(M.decode_png(M.encode_png(M.payload(t)))), "big") for t in (a, a[:4000] + "Z" + a[4001:], prose(rng, 2000))]
    assert (h[0] ^ h[1]).bit_count() <= 4 < (h[0] ^ h[2]).bit_count()


def test_empty_table(spark):
    assert M.read_media(M.to_media(spark.createDataFrame([], DOCS))).count() == 0
