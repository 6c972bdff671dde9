import random

import numpy as np
import pytest

from sigmill.llm import repeats as R

from .helpers import DOCS, ODD, docs, got, prose


def brute(rows, length):
    seen = {}
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((n, p))
    gone = [bytearray(len((t or "").encode())) for _, t in rows]
    for where in seen.values():
        if len(where) > 1:
            for n, p in where:
                gone[n][p : p + length] = b"\1" * length
    out = []
    for (i, t), g in zip(rows, gone):
        b = (t or "").encode()
        spans, at = [], 0
        for k, x in enumerate([*g, 0]):
            if x and not at:
                at = k + 1
            if not x and at:
                spans.append((at - 1, k))
                at = 0
        out.append((i, len(b), spans, bytes(x for x, y in zip(b, g) if not y)))
    return out


def same(df, rows, length):
    found = sorted([(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()], key=repr)
    assert found == sorted(brute(rows, length), key=repr)


def passages(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 250), 2000)) for i in range(40)]
    for n in (198, 199, 200, 201, 205, 260, 331, 332, 333, 500):
        p = prose(rng, 300, 2000)
        p = p.encode()[:n].decode(errors="ignore")
        for _ in range(2):
            i = rng.randrange(len(rows))
            t = rows[i][1]
            k = rng.randint(0, len(t))
            rows[i] = (i, t[:k] + p + t[k:])
    rows += [(100 + k, rows[k][1]) for k in range(3)] + [(110, rows[5][1][:400] + "é" + rows[5][1][400:])]
    return rows + [(200 + k, t) for k, (_, t) in enumerate(ODD)] + [(300, "ab" * 400), (301, "abc " * 60), (302, "x" * 199), (303, "x" * 200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = passages(seed)
    same(R.remove_repeats(docs(spark, rows).withColumnRenamed("lang", "part").repartition(5)), rows, 200)


def test_many_parts_and_buckets(spark):
    rows = passages(3)
    same(R.remove_repeats(docs(spark, rows), part=2000, bucket=500), rows, 200)


def test_short_strings_and_another_cover(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    same(R.remove_repeats(docs(spark, rows), length=9, v=7, cover=(1, 2, 4)), rows, 9)


def test_long_text_in_steps(spark, monkeypatch):
    monkeypatch.setattr(R, "STEP", 1 << 9)
    h, b = R.Hasher(50), np.frombuffer(random.Random(5).randbytes(5000), np.uint8)
    found = np.concatenate([x for _, x in h(b)])
    assert len(found) == 4951 and [at for at, _ in h(b)] == list(range(0, 4951, 512))
    monkeypatch.setattr(R, "STEP", 1 << 14)
    assert (found == np.concatenate([x for _, x in R.Hasher(50)(b)])).all()


def test_cover_and_packing():
    assert R.covers(R.COVER, R.V) and not R.covers((0, 1, 3), 8)
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000):
        for top in (1 << 40, 1 << 63):
            x = np.unique(rng.integers(0, top, n, np.uint64))
            assert (R.unpack(R.pack(x)) == x).all()


def test_repeated_rows_and_empty_table(spark):
    t = prose(random.Random(7), 100)
    out = R.remove_repeats(docs(spark, [(5, t), (5, t), (6, None)]))
    assert got(out, "doc_id", "n_bytes") == sorted([(5, len(t.encode()))] * 2 + [(6, 0)])
    assert {bytes(r["kept"]) for r in out.collect()} == {b""}
    assert R.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
