"""Repeated 200-byte strings by a distributed difference cover.

A difference cover D modulo V has, for any two positions i and j, one shift below V that takes both
into D. So two equal strings of LENGTH bytes contain equal sampled strings of LENGTH - V + 1 bytes
at one shift. The steps are those of difference-cover suffix sorting, cut off at LENGTH bytes:

1. The strings at sampled positions (12 of 133) are named and sorted in buckets; names that occur
   once are dropped.
2. The remaining suffixes that a repeated name reaches by their shift are named by their first
   LENGTH bytes and sorted in buckets; equal neighbours are compared, within and across documents.
3. What the repeated suffixes' first LENGTH bytes cover is removed.

Names are 64-bit polynomial hashes. They move as packed arrays, sorted and without repeats, so that a
string that is everywhere is sent once from each part. Documents are dealt into parts of a few MB by
a hash of their key; whole copies are found first, and take part once; a task holds one part, or one bucket of names, a few million at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small, written

LENGTH = 200
V = 133
#: A perfect difference set: each difference modulo 133 occurs once.
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: Bytes of text in a part, and for which there is one bucket of names, on average.
PART, BUCKET = 2 << 20, 4 << 20
#: Positions hashed at a time.
STEP = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def covers(d: tuple[int, ...], v: int) -> bool:
    return {(a - b) % v for a in d for b in d} == set(range(v))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of all strings of a length in a text, in steps of bounded memory."""

    def __init__(self, length: int):
        self.length = length
        n = STEP + length + 1
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def __call__(self, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, hashes of the positions from there on)."""
        last = len(b) - self.length + 1
        for at in range(0, last, STEP):
            part = b[at : min(at + STEP, last) + self.length - 1]
            cum = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=cum[1:])
            h = (cum[self.length :] - cum[: -self.length]) * self.down[: len(part) - self.length + 1]
            h ^= h >> np.uint64(32)
            h *= _SPREAD
            h ^= h >> np.uint64(32)
            yield at, h


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _sampled(v: int, cover: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(v, bool)
    out[list(cover)] = True
    return out


def pack(sorted_: np.ndarray) -> bytes:
    """Sorted names as 8 bytes and differences of 6; the few that need more have the rest set apart."""
    if not len(sorted_):
        return b""
    d = np.diff(sorted_)
    wide = np.flatnonzero(d >> np.uint64(48))
    raw = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([len(wide).to_bytes(4, "little"), sorted_[:1].astype("<u8").tobytes(), wide.astype("<u4").tobytes(), (d[wide] >> np.uint64(48)).astype("<u2").tobytes(), raw.tobytes()])


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    k = int.from_bytes(data[:4], "little")
    first = np.frombuffer(data, "<u8", 1, 4)
    raw = np.frombuffer(data[12 + 6 * k :], np.uint8)
    full = np.zeros((len(raw) // 6, 8), np.uint8)
    full[:, :6] = raw.reshape(-1, 6)
    d = full.view("<u8").ravel()
    if k:
        d[np.frombuffer(data, "<u4", k, 12)] |= np.frombuffer(data, "<u2", k, 12 + 4 * k).astype(np.uint64) << np.uint64(48)
    return np.concatenate([first, first[0] + np.cumsum(d, dtype=np.uint64)]).astype(np.uint64)


def _split(sorted_: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets (the top bits) of sorted names."""
    if not len(sorted_):
        return
    top = (sorted_ >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]])
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield int(top[i]), slice(i, j)


def _bytes(x: pa.Scalar) -> np.ndarray:
    data = x.as_buffer()
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class Plan:
    """What the steps share: the sampling, and how many parts and buckets there are."""

    def __init__(self, length: int, v: int, cover: tuple[int, ...], parts: int, bits: int):
        assert covers(cover, v) and length >= v
        self.length, self.v, self.parts, self.bits = length, v, parts, bits
        self.short = length - v + 1
        self.part_type = "<u2" if parts <= 1 << 16 else "<i4"
        self.mask = _sampled(v, cover)

    def samples(self, b: np.ndarray, short: Hasher) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the sampled strings."""
        where, names = [], []
        for at, h in short(b):
            p = np.flatnonzero(np.resize(np.roll(self.mask, -(at % self.v)), len(h)))
            where.append(p + at)
            names.append(h[p])
        return (np.concatenate(where), np.concatenate(names)) if where else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def suffixes(self, b: np.ndarray, repeated: np.ndarray, short: Hasher, full: Hasher) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the suffixes that a repeated sampled name reaches."""
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = len(b) - self.length + 1
        if last <= 0:
            return none
        p, names = self.samples(b, short)
        p = p[_among(names, repeated)]
        if not len(p):
            return none
        edge = np.zeros(len(b) + 2, np.int32)
        np.add.at(edge, np.maximum(p - self.v + 1, 0), 1)
        edge[p + 1] -= 1
        live = np.cumsum(edge)[:last] > 0
        where, found = [], []
        for at, h in full(b):
            i = np.flatnonzero(live[at : at + len(h)])
            where.append((i + at).astype(np.int32))  # a text has fewer than 2^31 bytes
            found.append(h[i])
        return np.concatenate(where), np.concatenate(found)


def _binary(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if n in ("bucket", "part", "kind") else pa.binary() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _name_samples(plan: Plan, rows: DataFrame) -> DataFrame:
    """Step 1: (part, bucket, kind 0, data): the repeated sampled names of each part."""

    def emit(names: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        h, g = np.concatenate(names), np.concatenate(parts)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        third = np.zeros(len(h), bool)  # two of a name and part say that it is repeated
        third[2:] = (h[2:] == h[:-2]) & (g[2:] == g[:-2])
        h, g = h[~third], g[~third]
        return _binary([(k, pack(h[s]), g[s].astype(plan.part_type).tobytes()) for k, s in _split(h, plan.bits)], ["bucket", "names", "parts"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = Hasher(plan.short)
        names, parts, n = [], [], 0
        for batch in batches:
            for part, copied, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = _bytes(text)
                if len(b) < plan.length:
                    continue
                h = plan.samples(b, short)[1]
                if copied:
                    h = np.concatenate([h, h])
                names.append(h)
                parts.append(np.full(len(h), part, np.int32))
                n += len(h)
                if n >= 1 << 21:
                    yield emit(names, parts)
                    names, parts, n = [], [], 0
        if n:
            yield emit(names, parts)

    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        h = np.concatenate([unpack(x) for x in table["names"].to_pylist()])
        g = np.concatenate([np.frombuffer(x, plan.part_type) for x in table["parts"].to_pylist()])
        order = np.argsort(h, kind="stable")
        h, g = h[order], g[order]
        same = h[1:] == h[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        h, g = h[twice], g[twice]
        order = np.lexsort((h, g))
        h, g = h[order], g[order]
        starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]) if len(g) else [0]
        k = key[0].as_py()
        made = [(int(g[i]), k, 0, pack(np.unique(h[i:j]))) for i, j in zip(starts[:-1], starts[1:], strict=True)]
        return pa.Table.from_batches([_binary(made, ["part", "bucket", "kind", "data"])])

    sent = rows.select("part", "copied", "text").mapInArrow(sample, "bucket int, names binary, parts binary")
    return sent.groupBy("bucket").applyInArrow(repeated, "part int, bucket int, kind int, data binary")


def _known(marks: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(marks["kind"].to_pylist(), marks["bucket"].to_pylist(), marks["data"].to_pylist(), strict=True)
    return {k: d for which, k, d in rows if which == kind}


def _repeated_samples(marks: pa.Table) -> np.ndarray:
    by = _known(marks, 0)
    return np.concatenate([unpack(by[k]) for k in sorted(by)]) if by else np.zeros(0, np.uint64)


def _name_suffixes(plan: Plan, rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Step 2: (part, bucket, kind 1, data): bits, over a part's sorted names of suffixes, of those that
    start elsewhere too."""

    def name(texts: pa.Table, marks: pa.Table) -> pa.Table:
        kinds = ["part", "bucket", "names", "twice"]
        if not texts.num_rows or not marks.num_rows:
            return pa.Table.from_batches([_binary([], kinds)])
        short, full, known = Hasher(plan.short), Hasher(plan.length), _repeated_samples(marks)
        h = [plan.suffixes(_bytes(t), known, short, full)[1] for t in texts["text"].combine_chunks()]
        h += [h[i] for i in np.flatnonzero(texts["copied"].to_numpy())]
        names, counts = np.unique(np.concatenate(h), return_counts=True)
        part = texts["part"][0].as_py()
        made = [(part, k, pack(names[s]), np.packbits(counts[s] > 1).tobytes()) for k, s in _split(names, plan.bits)]
        return pa.Table.from_batches([_binary(made, kinds)])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        own = [unpack(x) for x in table["names"].to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) for x, n in zip(table["twice"].to_pylist(), own, strict=True)]).astype(bool)
        h = np.concatenate(own)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        hit = np.empty(len(h), bool)
        hit[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        hit |= twice  # a name that one part has twice, the other parts that have it see as a neighbour
        ends = np.cumsum([len(n) for n in own])
        k = key[0].as_py()
        made = [(p, k, 1, np.packbits(hit[e - len(n) : e]).tobytes()) for p, n, e in zip(table["part"].to_pylist(), own, ends.tolist(), strict=True) if hit[e - len(n) : e].any()]
        return pa.Table.from_batches([_binary(made, ["part", "bucket", "kind", "data"])])

    left, right = rows.select("part", "copied", "text").groupBy("part"), marks.groupBy("part")
    sent = left.cogroup(right).applyInArrow(name, "part int, bucket int, names binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(compare, "part int, bucket int, kind int, data binary")


OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _remove(plan: Plan, rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Step 3."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
        short, full, known, bits = Hasher(plan.short), Hasher(plan.length), _repeated_samples(marks), _known(marks, 1)
        data = [_bytes(t) for t in texts["text"].combine_chunks()]
        found = [plan.suffixes(b, known, short, full) if bits else (np.zeros(0, np.int64), np.zeros(0, np.uint64)) for b in data]
        names, place = np.unique(np.concatenate([h for _, h in found] or [np.zeros(0, np.uint64)]), return_inverse=True)
        hit = np.zeros(len(names), bool)
        for k, s in _split(names, plan.bits):
            if k in bits:
                hit[s] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=s.stop - s.start)
        hit = hit[place]
        del names, place
        spans, kept, at = [], [], 0
        own = ~texts["copied"].to_numpy()
        for b, (p, h), out in zip(data, found, own.tolist(), strict=True):
            p = p[hit[at : at + len(h)]]
            at += len(h)
            if not out:
                continue
            edge = np.zeros(len(b) + 1, np.int32)
            edge[p] += 1  # p has no position twice
            edge[p + plan.length] -= 1
            gone = np.cumsum(edge)[: len(b)] > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
            spans.append([{"start": i, "end": j} for i, j in zip(turns[::2], turns[1::2], strict=True)])
            kept.append(b[~gone].tobytes() if turns else b.tobytes())
        cols = [texts["doc_id"].filter(pa.array(own)).combine_chunks(), pa.array([len(b) for b, out in zip(data, own.tolist(), strict=True) if out], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept"])

    return rows.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(cut, OUT)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, v: int = V, cover: tuple[int, ...] = COVER, part: int = PART, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the maximal runs of bytes that lie in a string of `length` bytes
    which starts anywhere else too, and the bytes outside of them, as UTF-8 bytes in order.

    Judged on the input: both places of a repeat are removed. Null texts count as empty; matches never
    cross documents; repeated rows repeat each other; texts shorter than `length` stay; further columns
    are ignored; an empty table gives an empty one."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(8, -(-total // part))
    bits = max(4, (total // bucket).bit_length())
    plan = Plan(length, v, cover, parts, bits)
    place = lambda *c: F.pmod(F.xxhash64(*c, F.lit("part")), F.lit(parts)).cast("int").alias("part")
    # Whole copies: all of their bytes go if there are `length`; one text of each group takes part, as copied.
    same = [F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), F.octet_length("text").alias("n")]
    keyed = src.select("doc_id", "text", *same)
    found = written(keyed.groupBy("h", "c", "n").count().where("count > 1").select("h", "c", "n"), "copies")
    copies = small(found)
    many = keyed.join(copies, ["h", "c", "n"], "left_semi")
    one = written(many.groupBy("h", "c", "n").agg(F.first("text").alias("text")), "copied")
    alone = keyed.join(copies, ["h", "c", "n"], "left_anti").select(place("doc_id"), F.lit(False).alias("copied"), "doc_id", "text")
    rows = alone.union(one.select(place("h", "n"), F.lit(True), F.lit(None).cast("long"), "text"))
    samples = written(_name_samples(plan, rows), "samples")
    release(docs.sparkSession)
    suffixes = written(_name_suffixes(plan, rows, samples), "suffixes")
    release(docs.sparkSession)
    span = F.struct(F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    gone = F.col("n") >= length
    whole = many.select("doc_id", F.col("n").cast("long").alias("n_bytes"), F.when(gone, F.array(span)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"))
    return _remove(plan, rows, samples.union(suffixes)).union(whole)
