"""The pipeline's stages on the smallest tables, each judged on its own input."""

import re

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from .helpers import DOCS, SF, docs


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(steps):
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(df.columns == steps[0].columns for df in steps[:5])


def test_each_stage_does_its_work(steps):
    docs, clean, exact, near, mixed, packed = steps
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert 0 < clean.count() < docs.count()
    norm = lambda i: re.sub(r"[\x20\x09-\x0D]", "", rows[i]["text"] or "")
    groups = {}
    for i in ids(clean):
        groups.setdefault(norm(i), []).append(i)
    want = [min(g, key=lambda i: (-len(rows[i]["text"] or ""), i)) for g in groups.values()]
    assert sorted(ids(exact)) == sorted(want)
    # One of each group of documents whose sets of 5-word shingles have a similarity of 0.8 stays.
    def shingles(i):
        w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"] or "")]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(i) for i in ids(exact)}, {}
    for i in sorted(sets):
        near_by = [j for j in root if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        merged = {root[j] for j in near_by} | {i}
        low = min(merged)
        root[i] = low
        for j in root:
            if root[j] in merged:
                root[j] = low
    assert sorted(ids(near)) == sorted(set(root.values()))
    counts = {}
    for i in ids(mixed):
        counts[i] = counts.get(i, 0) + 1
    assert set(counts) <= set(ids(near)) and max(counts.values()) <= 2
    assert sorted(r["doc_id"] for r in packed.where("piece = 0").collect()) == sorted(ids(mixed))


def test_run_and_registry(spark, steps):
    out = C.run(spark, SF)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(out) == key(steps[-1])
    q = entry.queries()
    assert "pipeline" in q and {int(re.match(r"op(\d+)_", n)[1]) for n in q if n.startswith("op")} == set(range(1, 11))


ODDITIES = [(None, None), (None, "alone"), (1, None), (2, ""), (3, " \t\n"), (4, "é́x 😀"), (5, "a"), (5, "a"), (5, "another text"), (6, "a "), (7, "b " * 30_000)]


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and keys, a further column: every stage but the last keeps
    the columns; what one keeps is among what it got."""
    d = docs(spark, ODDITIES).withColumn("_size", F.lit(1)).withColumn("sha", F.lit("x"))
    for name, stage in C.STAGES:
        out = stage(spark, d, SF).cache()
        n = out.count()
        if name == "packing":
            assert n >= d.count()
            break
        assert out.columns == d.columns and 0 < n <= (2 if name == "mixing" else 1) * d.count()
        before = {(r["doc_id"], r["text"]) for r in d.collect()}
        assert {(r["doc_id"], r["text"]) for r in out.collect()} <= before
        if name == "near_dedup":  # texts that are no copies all stay
            assert {"alone", "another text"} <= {r["text"] for r in out.collect()}
        d = out


def test_stages_on_an_empty_table(spark):
    d = spark.createDataFrame([], DOCS)
    for name, stage in C.STAGES:
        out = stage(spark, d, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == d.columns)
