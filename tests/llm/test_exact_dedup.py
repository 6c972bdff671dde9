import hashlib
import random
import re

import pytest

from sigmill.llm import exact_dedup as X

from .helpers import DOCS, ODD, docs, got, prose


def brute(rows):
    norm = {}
    for n, (i, t) in enumerate(rows):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i, n))
    out = []
    for text, members in norm.items():
        best = min(members)
        out += [(m[2], best[2], len(members), m is best, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return out


@pytest.mark.parametrize(("block", "bits"), [(1024, 56), (3, 56), (2, 58), (7, 57)])
def test_groups_match_brute_force(spark, block, bits):
    rng = random.Random(block)
    rows = ODD + [(10 + i, prose(rng, rng.randint(1, 60), 5)) for i in range(40)]
    rows += [(100 + i, rows[9 + i % 5][1].replace(" ", "\n ")) for i in range(20)]
    found = X.groups(X.identities(docs(spark, rows), block=block, bits=bits))
    want = brute(rows)
    cols = ("doc_id", "keep_id", "group_size", "text_sha256")
    assert got(found, *cols) == sorted([(a, b, c, e) for a, b, c, d, e in want], key=repr)
    assert found.where("kept").count() == sum(w[3] for w in want)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_clashing_buckets_are_sorted(spark, bits):
    rows = [(i, t) for i, t in enumerate(["abcdef", "abcdeg", "ab", "", "ba", "abcdef", "abcd", "abab", "ab ab", "x" * 9, "x" * 10])]
    d = docs(spark, rows)
    assert X.clashes(d, block=2, bits=bits)
    found = X.groups(X.identities(d, block=2, bits=bits))
    assert got(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute(rows), key=repr)


def test_no_clash_at_full_width(spark):
    assert not X.clashes(docs(spark, [(i, f"text {i}") for i in range(500)]), block=2)


def test_a_full_bucket_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(X, "_bucket", lambda bits, *args: "bigint(0)")
    with pytest.raises(Exception, match="too many blocks"):
        X.identities(docs(spark, [(i, f"t{i}") for i in range(9)]), bits=62).count()


def test_rows_that_stay(spark):
    out = X.exact_dedup(docs(spark, ODD))
    assert out.columns == docs(spark, ODD).columns
    assert got(out, "doc_id", "text") == sorted([(3, " \t\n"), (4, "é́x 😀"), (6, "a "), (7, "b " * 30_000)], key=repr)


def test_repeated_rows_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x"), (2, "ab", 8, "y")], "doc_id long, text string, name long, _key string")
    out = X.exact_dedup(d)
    assert out.columns == d.columns
    assert [tuple(r) for r in out.collect()] == [(1, "a b", 7, "x")]


def test_empty_table(spark):
    d = spark.createDataFrame([], DOCS)
    assert X.groups(X.identities(d)).count() == 0
    assert X.exact_dedup(d).count() == 0
