import random
import zlib

import numpy as np

from sigmill.llm import toxicity as T

from .helpers import DOCS, ODD, docs, got, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1200):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        t, bad = prose(rng, rng.randint(5, 80)), i % 8 == 0
        if bad:
            words = t.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "nasty"]))
            t = " ".join(words)
        rows.append((i, t))
        if rng.random() < 0.5:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    out = T.toxicity(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["doc_id"] % 8 == 0, r["predicted"]) for r in out if r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(400)
    d = docs(spark, rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (T.fit(d, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.place == b.place and (a.weights == b.weights).all() and a.bias == b.bias and a.place


def test_keep_clean(spark):
    rows, labels = corpus(600)
    d, lab = docs(spark, rows + [(None, None)]).withColumnRenamed("lang", "score"), spark.createDataFrame(labels, LABELS)
    kept = T.keep_clean(d, lab)
    assert kept.schema == d.schema
    want = [(r["doc_id"],) for r in T.toxicity(d, lab).collect() if r["predicted"] == 0]
    assert got(kept, "doc_id") == sorted(want, key=repr)


def test_risk_never_falls_below_zero():
    """With every unlabelled row positive, the estimate doesn't run away: weights stay finite."""
    m = T.Model(["bad$", "ba"])
    rows = [m.vector("bad ba"), m.vector("bad")] * 20
    T.train_nnpu(m, rows, rows, 0.9)
    assert np.isfinite(m.weights).all() and np.isfinite(m.bias)


def test_vector():
    m = T.Model(["bad$", "bad", "badl"])
    idx, values = m.vector("Bad badly, BAD good")
    assert idx.tolist() == [0, 1, 2]
    assert np.allclose(np.expm1(values), [200 / 24, 300 / 24, 100 / 24])
    assert m.vector(None)[0].tolist() == []


def test_odd_rows(spark):
    d = docs(spark, ODD)
    none = spark.createDataFrame([], LABELS)
    assert {round(r["score"], 6) for r in T.toxicity(d, none).collect()} == {0.01}
    lab = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (7, 0, 0), (7, 0, 0)], LABELS)
    assert T.toxicity(d, lab).count() == len(ODD)
    assert T.toxicity(spark.createDataFrame([], DOCS), lab).count() == 0
