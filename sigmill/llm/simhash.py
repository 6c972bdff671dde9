"""SimHash near-dedup over an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 2 of their 8 bytes, so a
linked pair shares at least 6 positional bytes. That minimum is built into the index: its posting
lists belong to the 28 sets of 6 byte positions instead of single positions, so that a pair meets
in a list exactly when its tally of shared positional bytes reaches 6. (Lists of single bytes would
hold 1/256 of all fingerprints each and pair them all.) A list holds different fingerprints only,
which agree but for 16 bits: it never has more than 65,536, and its links are found by looking up
the few neighbours of each, not by pairing them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, fresh, giving_back, keep_lowest, text_sha, written

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42


def votes(hashes: np.ndarray) -> int:
    """The fingerprint of the shingles' hashes: bits set in over half of them."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return votes(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, sha: str | None = None) -> DataFrame:
    """(doc_id, fp long), and sha where that column is named. Null and empty texts: 0."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            cols = [batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "sha"][: len(cols)])

    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.col(sha).alias("sha")] if sha else []))
    return src.mapInArrow(run, "doc_id long, fp long" + (", sha string" if sha else ""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(shared: int) -> list[int]:
    """The bytes kept by each posting set, for all sets of so many byte positions."""
    return [_signed(sum(255 << 8 * p for p in s)) for s in combinations(range(8), shared)]


#: What two fingerprints within RADIUS bits share at least.
MASKS = masks(8 - RADIUS)
#: Flips of at most RADIUS of 16 bits, but for none.
FLIPS = np.array([sum(1 << b for b in s) for k in (1, 2) for s in combinations(range(16), k)], np.uint32)
_FREE = [[p for p in range(8) if not _signed(255 << 8 * p) & m] for m in MASKS]


def _stars(values: np.ndarray, free: list[int]) -> list[tuple[int, int]]:
    """Links (fingerprint, smallest fingerprint of its part of the list) of one posting list."""
    v = np.unique(values.view(np.int64)).view(np.uint64)
    n = len(v)
    if n < 2:
        return []
    short = ((v >> np.uint64(8 * free[0])) & np.uint64(255)) | (((v >> np.uint64(8 * free[1])) & np.uint64(255)) << np.uint64(8))
    place = np.full(1 << 16, -1, np.int64)
    place[short.astype(np.int64)] = np.arange(n)
    root = np.arange(n)
    while True:
        best = root.copy()
        for f in FLIPS:
            other = place[(short.astype(np.uint32) ^ f).astype(np.int64)]
            ok = other >= 0
            best[ok] = np.minimum(best[ok], root[other[ok]])
        best = best[best]
        if (best == root).all():
            break
        root = best
    own = v.view(np.int64)
    return [(int(own[i]), int(own[r])) for i, r in enumerate(root) if i != r]


def _pairwise(values: np.ndarray) -> list[tuple[int, int]]:
    """The same for a few fingerprints."""
    v = np.unique(values.view(np.int64))
    x = v.view(np.uint64)
    out = []
    for i in range(1, len(v)):
        near = np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= RADIUS)
        out += [(int(v[i]), int(v[j])) for j in near]
    return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect what the pairs within RADIUS bits connect, of different fps (fp)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def close() -> list[tuple[int, int]]:
            values = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            if len(values) < 2:
                return []
            return _pairwise(values) if len(values) <= 12 else _stars(values, _FREE[last[0]])

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            s, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(s):
                continue
            starts = np.concatenate([[0], np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1, [len(s)]])
            fp = fp.view(np.uint64)
            sizes = np.diff(starts)
            pairs = []
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                i, j = starts[g], starts[g + 1]
                if last != (s[i], k[i]):
                    pairs += close()
                    last = (s[i], k[i])
                held.append(fp[i:j])
            yield made(pairs)
        yield made(close())

    return _lists(fps.select("fp"), MASKS).repartition("s", "k").sortWithinPartitions("s", "k").mapInArrow(run, "a long, b long")


def _lists(fps: DataFrame, sets: list[int]) -> DataFrame:
    """(s, k) and fps' columns: a row for each posting list that a fingerprint belongs to."""
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(sets)])).alias("x")
    return fps.select(key, *fps.columns).select("x.s", "x.k", *fps.columns)


def candidates(fps: DataFrame, radius: int, shared: int) -> DataFrame:
    """(a, b): pairs of ids of fps (sid, fp) within radius bits that share so many positional bytes, to be verified
    by the caller.

    For a wide radius: past 7 bits no byte need be shared, so there are pairs that no index of bytes finds. The lists
    belong to the sets of `shared` byte positions: a pair meets in one exactly when its tally reaches that. A list
    isn't paired in full; its members meet the smallest id in it, and each id keeps the nearest and the smallest of
    those it met."""
    own = Window.partitionBy("s", "k").orderBy("sid")
    rows = _lists(fps.select("sid", "fp"), masks(shared)).select("sid", "fp", F.first("sid").over(own).alias("low"), F.first("fp").over(own).alias("lowfp"))
    rows = rows.select("sid", "low", F.bit_count(F.col("fp").bitwiseXOR(F.col("lowfp"))).alias("d")).where(f"sid <> low and d <= {radius}")
    met = rows.groupBy("sid").agg(F.min(F.struct("d", "low")).alias("near"), F.min("low").alias("low"))
    return met.select(F.explode(F.array_distinct(F.array("near.low", "low"))).alias("a"), F.col("sid").alias("b"))


def clusters(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, sha: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id that links reach); with
    sha, that column and root (the component's own name, where doc_ids are null or repeated) too.

    Documents link when their fingerprints differ in at most 2 bits; equal fingerprints link, so all
    empty (and null) texts are one component. Repeated rows come as often as in docs, null doc_ids
    never become a component_id unless a component has no other; an empty table stays empty."""
    own = written(fingerprints(docs, text, key, shingle, sha), "fps")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    star = components(links(nodes.select("fp")))
    root = nodes.join(star, nodes.fp == star.a, "left").select("fp", "low", F.coalesce("b", "fp").alias("root"))
    root = written(root, "roots")
    low = root.groupBy("root").agg(F.min("low").alias("component_id"))
    root = root.join(low, "root").select("fp", "component_id", "root")
    return own.join(root, "fp").select("doc_id", "fp", "component_id", *(["sha", "root"] if sha else []))


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component, the row with the smallest
    key. Rows with one key and different texts are judged one by one; null keys too."""
    (h,) = fresh(docs, "_sha")
    found = clusters(docs.withColumn(h, text_sha(text)), text, key, shingle, h)
    return keep_lowest(docs, found.select("root", "doc_id", "sha"), text, key)
