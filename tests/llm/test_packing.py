import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sigmill.llm import packing as P
from sigmill.llm.queries import vocabulary

from .helpers import DOCS, ODD, SF, docs, prose


def slow_ids(text):
    t = slow_ids.t = getattr(slow_ids, "t", None) or Tokenizer.from_file(vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def holds(rows, texts, length):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_bin.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= length
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = slow_ids(texts[i])
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [(r["start"], r["length"]) for r in own] == [(s, len(ids[s : s + length])) for s in range(0, len(ids), length)]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes()) for s in range(0, len(ids), length)]
        if own[0]["ids"] is not None:
            assert [x for r in own for x in r["ids"]] == ids
    return len(by_bin)


ODDER = ["İstanbul ΣΑΣ ﬁ Å", "it's we'll 'tis don't you x", "a\x1cb\x85c", "<|endoftext|> x<|startoftext|>y <|endof text|>", "12345 6 7.8", "é ́ e 가", "​ zero﻿", "😀😀 x😀", "A" * 5000, "Ŀ ŉ İ ı ſ Ĳ ÿŸ ª º", "end. (so) a|b x; don't. it's! ...", "éa,b ñ.ñ Straße!!"]


@pytest.mark.parametrize("length", [16, 4096])
def test_pieces_and_places(spark, length):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate([t for _, t in ODD] + ODDER)] + [(100 + i, prose(rng, rng.randint(0, 900))) for i in range(80)]
    out = P.pack(docs(spark, rows).withColumnRenamed("lang", "piece").coalesce(1), vocabulary(), length=length, window=16).collect()
    bins = holds(out, dict(rows), length)
    assert bins <= 1.03 * sum(r["length"] for r in out) / length + 2


def test_whole_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.pack(d, vocabulary(), ids=False).collect()
    bins = holds(out, {r["doc_id"]: r["text"] for r in d.collect()}, 4096)
    assert bins <= sum(r["length"] for r in out) / 4096 + 2


def test_fullest_closes_first():
    b = P.Bins(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = P.Bins(10, 2)
    assert [b.place(n) for n in (6, 8, 7)] == [(0, 0), (1, 0), (2, 0)]
    assert b.place(2) == (2, 7)  # the bin with 2 left has closed
    assert b.place(4) == (0, 6)


def test_a_full_piece_closes_no_bin():
    b = P.Bins(4096, 2)
    assert [b.place(n) for n in (2000, 3000, 4096, 2096)] == [(0, 0), (1, 0), (2, 0), (0, 2000)]


def test_any_other_vocabulary_is_encoded_as_it_is(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Two  words"), (2, None), (3, "a\nB")]
    t = Tokenizer.from_file(path)
    out = {r["doc_id"]: r["ids"] for r in P.pack(docs(spark, rows), path).collect()}
    assert out == {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}


def test_best_fit_against_a_list():
    rng = random.Random(6)
    b, free = P.Bins(50, 10**9), {}
    for _ in range(2000):
        n = rng.randint(1, 50)
        fits = [f for f in free.values() if f >= n]
        k, at = b.place(n)
        assert free.get(k, 50) == (min(fits) if fits else 50) and at == 50 - free.get(k, 50)
        free[k] = free.get(k, 50) - n


def test_memory_of_words_is_bounded():
    w = P.WordIds(vocabulary(), 50)
    rng = random.Random(7)
    for _ in range(30):
        texts = [prose(rng, 10, 40) for _ in range(3)]
        assert w.many(texts) == [np.array(slow_ids(t)[:-1], "<u4").tobytes() for t in texts]
        assert len(w.known) <= 50 and len(w.old) <= 120


def test_repeated_rows_and_empty_table(spark):
    out = P.pack(docs(spark, [(5, "a b"), (5, "a b"), (None, None)]), vocabulary()).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in out) == [(0, 1), (5, 3), (5, 3)]
    assert P.pack(spark.createDataFrame([], DOCS), vocabulary()).count() == 0
