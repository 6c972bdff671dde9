"""Near-dedup of documents by SimHash and the exact Jaccard similarity of their word shingles.

Two documents link when the sets of their SHINGLE-word shingles have a similarity of 4/5 or more. The
first candidates come from the SimHash index of byte positions: fingerprints of the same shingles that
share SHARED positional bytes and differ in RADIUS bits at most. Whole sets decide.

That alone would lose links: a similarity of 4/5 is about 10 bits, and from 8 bits on two fingerprints
need not share a single byte. So what fingerprints haven't connected is looked up in an index of
prefixes, which misses no pair: with one order of all shingles, rare ones first, a pair that matches
shares one of the first n - ceil(0.8 n) + 1 shingles of each. Whole sets decide there too.

Only what the pairs connect is wanted, so a list of the index isn't paired in full at once: its members
are first compared with one of them, and only members that are not connected yet meet again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_rows, components, giving_back, keep_lowest, release, small, text_sha, written
from .lines import DEN, NUM, need

SHINGLE = 5
SEED = 42
#: Candidates by fingerprint: bits that may differ (sets at 4/5 differ in 10 on average, by 3 more or less), and
#: positional bytes that are shared.
RADIUS, SHARED = 16, 4
#: Rows of an Arrow batch.
BATCH = 256
#: Cells of shingle hashes whose documents are counted for the order of rarity.
CELLS = 1 << 18
#: Rounds against one member of each list go on while more than so many pairs an entry are open, and
#: while a round closes so large a share of them. Then one open pair in FIRST_PART is compared, which
#: connects most of a large group, and at last all pairs that are open still.
OPEN_PAIRS, CLOSED, ROUNDS, FIRST_PART = 8, 0.3, 6, 8
#: 64-bit words of a bitmap of parities, at least; longer sets have two bits a shingle or more.
WORDS = 16


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; of a text with fewer words, one of all its words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.int64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = len(w) - shingle + 1
    h = np.zeros(n, np.uint64)
    for k in range(shingle):  # mixed after each word, so that their order counts
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))


def token_sets(docs: DataFrame, text: str, key: str, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, sha (of the text), tokens, sid (a hash of tokens), fp (their fingerprint)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [shingles(t.as_py(), shingle) for t in part.column(2)]
                sid = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
                fp = np.fromiter((simhash.votes(x.view(np.uint64)) for x in sets), np.uint64, len(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(sets), pa.array(sid), pa.array(fp)], ["doc_id", "sha", "tokens", "sid", "fp"])

    src = docs.select(F.col(key).cast("long").alias("doc_id"), text_sha(text).alias("sha"), F.col(text).alias("text"))
    return src.mapInArrow(run, "doc_id long, sha string, tokens array<long>, sid long, fp long")


def _cell(tokens: np.ndarray) -> np.ndarray:
    return tokens & (CELLS - 1)


def _rarity(sets: DataFrame) -> np.ndarray:
    """For each cell, one byte: log2 of the sets that have such a shingle."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for tokens in _each(batch.column(0)):
                np.add.at(total, _cell(tokens), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    table = np.zeros(CELLS, np.uint8)
    for cell, n in sets.select("tokens").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # CELLS rows at most
        table[cell] = int(math.log2(n))
    return table


def _entries(sets: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(o, sid, n, i, v): the shingles of each prefix, with the set's size, the place and the shingle before
    (at place 0: itself)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                o, sid, size, place, before = [], [], [], [], []
                for own, tokens in zip(part.column(0).to_pylist(), _each(part.column(1)), strict=True):
                    n = len(tokens)
                    if not n:
                        continue
                    m = n - (NUM * n + DEN - 1) // DEN + 1
                    o.append(tokens[np.argsort(rarity[_cell(tokens)], kind="stable")[:m]])  # tokens are sorted already
                    before.append(np.concatenate([o[-1][:1], o[-1][:-1]]))
                    sid.append(np.full(m, own, np.int64))
                    size.append(np.full(m, n, np.int32))
                    place.append(np.arange(m, dtype=np.int32))
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int64)
                cols = [pa.array(np.concatenate([np.zeros(0, t), *c])) for t, c in zip(kinds, (o, sid, size, place, before), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["o", "sid", "n", "i", "v"])

    return sets.select("sid", "tokens").mapInArrow(run, "o long, sid long, n int, i int, v long")


#: What a pair that matches fulfils, by size, and at any shingle that both prefixes have, by place.
_SIZE = f"a <> b and {DEN} * na >= {NUM} * nb and {DEN} * nb >= {NUM} * na"
_MAY = f"{_SIZE} and least(na - ia, nb - ib) + least(ia, ib) >= {need('na', 'nb')}"
#: At the first shingle that both have: nothing before it is shared, so the shingles before differ. A pair
#: fulfils this once for each run of shingles that the two prefixes have in common.
_FIRST = f"{_SIZE} and least(na - ia, nb - ib) >= {need('na', 'nb')} and (va <> vb or ia = 0 or ib = 0)"


def _side(entries: DataFrame, k: str) -> DataFrame:
    return entries.select("o", F.col("root").alias(f"r{k}"), F.col("sid").alias(k), *[F.col(c).alias(f"{c}{k}") for c in "niv"])


def words(n: int) -> int:
    """Words of the bitmap of n shingles: a power of two, so that the longer of two folds to the other."""
    return max(WORDS, 1 << max(0, (2 * n - 1) // 64).bit_length())


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(sid, n, w): w has the parities of the set's shingles in 64 * words(n) cells."""

    def bitmap(x: np.ndarray) -> np.ndarray:
        cells = 64 * words(len(x))
        return np.packbits(np.bincount((x >> 20) & (cells - 1), minlength=cells) % 2 == 1, bitorder="little").view(np.int64)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                own = list(_each(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, own)), pa.int32()), _lists([bitmap(x) for x in own])], ["sid", "n", "w"])

    return sets.select("sid", "tokens").mapInArrow(run, "sid long, n int, w array<long>")


def _differ() -> str:
    """SQL for the bits in which the bitmaps wa and wb differ, the longer one folded."""
    least = " + ".join(f"bit_count(wa[{i}] ^ wb[{i}])" for i in range(WORDS))
    folded = lambda w: f"aggregate(sequence(0, size({w}) div k - 1), 0L, (x, j) -> x ^ {w}[j * k + i])"
    each = f"bit_count({folded('wa')} ^ {folded('wb')})".replace("div k", "div least(size(wa), size(wb))").replace("* k", "* least(size(wa), size(wb))")
    return f"case when size(wa) = {WORDS} and size(wb) = {WORDS} then {least} else aggregate(sequence(0, least(size(wa), size(wb)) - 1), 0, (s, i) -> s + {each}) end"


def _matching(pairs: DataFrame, sets: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar; written. Two sets differ in as many shingles at least as
    their bitmaps in bits, so only pairs that pass that have their sets moved."""
    side = lambda k: bitmaps.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("w").alias(f"w{k}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{_differ()} <= na + nb - 2 * {need('na', 'nb')}")
    pairs = written(pairs.select("a", "b"), "close")
    size = pairs.count()
    ids = small(written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sids", 2 * size))
    sets = sets.select("sid", "tokens").join(ids, "sid", "left_semi")
    found = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")
    found = found.join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    found = written(found.where(f"size(array_intersect(ta, tb)) >= {need('size(ta)', 'size(tb)')}").select("a", "b"), "links")
    release(found.sparkSession)
    return found


def _stars(found: DataFrame) -> DataFrame:
    """(sid, root): the smallest set two links away at most. All that one member links have one root; what
    only longer ways connect may have several, which costs some comparisons more and loses nothing."""
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return both.join(low, "b").groupBy("a").agg(F.min("m").alias("root")).withColumnRenamed("a", "sid")


def by_fingerprint(sets: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates of the SimHash index of sets (sid, tokens, fp), and those of them that are similar."""
    near = simhash.candidates(sets, RADIUS, SHARED).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = written(near, "pairs")
    return near, _matching(near, sets, bitmaps)


def links(sets: DataFrame) -> DataFrame:
    """(a, b): links that connect what the pairs of similar sets (sid, tokens, fp) connect; sid is unique."""
    bitmaps = written(_bitmaps(sets), "bitmaps")
    tested, found = by_fingerprint(sets, bitmaps)
    # One shuffle: a list's rows are counted where they are, and what is in no other set goes.
    entries = _entries(sets, _rarity(sets)).withColumn("sets", F.count("*").over(Window.partitionBy("o")))
    entries = written(entries.where("sets > 1").drop("sets"), "lists")
    release(sets.sparkSession)
    was = None
    some = last = False
    size = bitmaps.count()
    for turn in count():
        roots = components(found).select(F.col("a").alias("sid"), F.col("b").alias("root")) if some or not turn else _stars(found)
        star = written(roots, "star", size)
        at = entries.join(small(star), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        at = written(at, "open")
        # Pairs of different components in each list, and the member that the others meet.
        lists = at.groupBy("o", "root").agg(F.count("*").cast("double").alias("c"), F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "root", "n", "i", "v")).alias("pivot"))
        lists = lists.groupBy("o").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("roots"), F.min("pivot").alias("pivot"))
        lists = written(lists.where("roots > 1"), "openlists")
        n, pairs = lists.agg(F.sum("c"), F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2)).first()
        if not n:
            return found
        last = some
        some = some or turn > 0 and (pairs <= OPEN_PAIRS * n or pairs > (1 - CLOSED) * was) or turn >= ROUNDS
        was = pairs
        if some:
            at = at.join(small(lists.select("o")), "o", "left_semi")
            near = _side(at, "a").join(_side(at, "b"), "o").where(f"a < b and ra <> rb and {_FIRST} and pmod(xxhash64(a, b), {FIRST_PART}) {'<>' if last else '='} 0")
        else:
            near = _side(lists.select("o", "pivot.*"), "a").join(_side(at, "b"), "o").where(f"ra <> rb and {_MAY}")
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = written(near.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(near)
        found = found.union(_matching(near, sets, bitmaps))
        if last:
            return found


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay, with their columns: of the rows that similar texts connect, the one
    with the smallest key (null last).

    Equal sets are similar, so all null and empty texts are one group. Rows repeated with one key and
    one text count as copies; an empty table stays empty."""
    with arrow_rows(docs.sparkSession, BATCH):
        rows = written(token_sets(docs, text, key, shingle), "rows")
        size = rows.count()
        ids = written(rows.groupBy("sid").count(), "sids", size)
        again = small(written(ids.where("count > 1").select("sid"), "again", size))
        one = rows.join(again, "sid", "left_anti").select("sid", "tokens", "fp")
        more = rows.join(again, "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"), F.first("fp").alias("fp"))
        star = written(components(links(one.union(more))).select(F.col("a").alias("sid"), F.col("b").alias("root")), "star", size)
        found = rows.join(small(star), "sid", "left").select(F.coalesce("root", "sid").alias("root"), "doc_id", "sha")
        return keep_lowest(docs, found, text, key)
