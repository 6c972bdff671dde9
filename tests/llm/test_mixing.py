import random
import re

import pytest

from sigmill.llm import mixing as X
from sigmill.llm.queries import op7_mixing

from .helpers import DOCS, ODD, SF, docs, got, prose


def slow_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level >= most * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in rest}
        full |= {s: most * sizes[s] for s in over}


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def held(rows, found):
    sizes = {}
    for r in rows:
        s = r[2] if len(r) > 2 else "s"
        sizes[s] = sizes.get(s, 0) + size(r[1])
    want = slow_targets(sizes)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    assert len(found) == len(rows)
    for r in found:
        assert r["_source_size"] == sizes[r["source"]] and r["_target"] == pytest.approx(want[r["source"]])
        assert r["_size"] == size(r["text"]) and r["_copies"] in (0, 1, 2)
        taken[r["source"]] += r["_size"] * r["_copies"]
        largest[r["source"]] = max(largest[r["source"]], r["_size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * largest[s], 0.02 * want[s]), s


def test_targets_and_counts(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 50)), rng.choice(["a", "a", "a", "b", "é", "Z", None, "c", "d"])) for i in range(600)] + [(i, t, "z") for i, t in ODD]
    held(rows, X.mix_counts(docs(spark, rows)).collect())


def test_more_sources_than_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("sigmill.llm.common.BROADCAST_ROWS", 1)
    rows = [(i, "w " * (i % 9), f"s{i % 40}") for i in range(400)]
    held(rows, X.mix_counts(docs(spark, rows)).collect())


def test_reruns_agree(spark):
    a, b = (got(op7_mixing(spark, SF), "doc_id", "size", "taken", "target") for _ in range(2))
    assert a == b


def test_mix_repeats_rows(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(200)]
    d = docs(spark, rows).withColumnRenamed("lang", "_size").withColumnRenamed("n_chars", "whole")
    counts = {r["doc_id"]: r["_copies"] for r in X.mix_counts(d).collect()}
    out = X.mix(d)
    assert out.columns == d.columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {i: c for i, c in counts.items() if c}


def test_own_weights(spark):
    rows = [(i, "w w", "ab"[i % 2]) for i in range(100)]
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    t = {r["source"]: r["_target"] for r in X.mix_counts(docs(spark, rows), weights=w, share=1.0).collect()}
    assert t == {"a": 150.0, "b": 50.0}


def test_no_words_and_empty_table(spark):
    assert {r["_copies"] for r in X.mix_counts(docs(spark, [(1, ""), (2, None)])).collect()} == {0}
    assert X.mix_counts(spark.createDataFrame([], DOCS)).count() == 0
