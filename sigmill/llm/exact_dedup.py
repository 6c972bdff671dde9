"""Exact dedup by deterministic block naming (built-in functions only).

A text without white space is cut into blocks of BLOCK bytes. A block's integer name is its place in
a bucket sort: the high bits are its bucket (a hash of the bytes), the low bits its rank among the
different blocks of that bucket in byte order. Adjacent names are then named in the same way as
pairs, level by level, until one name is left: at each level equal names mean equal bytes, so that
(length, last name) identifies the text without collisions.

With 56 bucket bits nearly every bucket holds one block, and its rank is 0. One pre-aggregated
shuffle proves this (minimum = maximum in each bucket of each level); names are then a function of
the row alone and no join is needed. Where a bucket does hold several blocks, the levels are named
by sorting, one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, small, written

BLOCK = 1024
BUCKET_BITS = 56


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _bucket(bits: int, *args: str) -> str:
    low = 64 - bits
    return f"shiftleft(shiftright(xxhash64({', '.join(args)}), {low}), {low})"


_PAIRS = """case when size({n}) < 2 then array() else transform(sequence(1, size({n}) div 2),
 i -> named_struct('a', {n}[2 * i - 2], 'b', {n}[2 * i - 1])) end"""


def _next(n: str, bits: int) -> str:
    """Names one level up, every bucket holding one pair; an odd last name goes up as it is."""
    name = _bucket(bits, "p.a", "p.b")
    return f"concat(transform({_PAIRS.format(n=n)}, p -> {name}), case when size({n}) % 2 = 1 then array({n}[size({n}) - 1]) else array() end)"


def _blocked(docs: DataFrame, text: str, block: int) -> DataFrame:
    """Adds norm and blocks; an empty text has one empty block."""
    out = docs.withColumn("norm", normalised(F.col(text))).withColumn("bytes", F.col("norm").cast("binary"))
    return out.withColumn(
        "blocks",
        F.expr(f"transform(sequence(0, greatest(0, cast((octet_length(bytes) - 1) div {block} as int))), i -> substring(bytes, i * {block} + 1, {block}))"),
    )


_DEPTH = "case when size(blocks) < 2 then cast(array() as array<int>) else sequence(1, length(bin(size(blocks) - 1))) end"


def fast_name(bits: int) -> str:
    """SQL for the last name of a row with blocks, where each bucket holds one item."""
    return f"aggregate({_DEPTH}, transform(blocks, b -> {_bucket(bits, 'b')}), (n, l) -> {_next('n', bits)})[0]"


def clashes(docs: DataFrame, text: str = "text", block: int = BLOCK, bits: int = BUCKET_BITS) -> bool:
    """Whether some bucket of some level holds two different items."""
    rows = _blocked(docs.select(F.col(text).alias("text")), "text", block)
    pairs = _PAIRS.format(n="s.names").replace("named_struct(", "named_struct('level', l, ")
    empty = "cast(array() as array<struct<level:int,a:bigint,b:bigint>>)"
    pairs = pairs.replace("array() else", f"{empty} else")
    rows = rows.select(
        "blocks",
        F.expr(
            f"aggregate({_DEPTH}, named_struct('names', transform(blocks, b -> {_bucket(bits, 'b')}), 'pairs', {empty}),"
            f" (s, l) -> named_struct('names', {_next('s.names', bits)}, 'pairs', concat(s.pairs, {pairs}))).pairs"
        ).alias("pairs"),
    )
    items = rows.select(
        F.explode(
            F.expr(
                "concat(transform(blocks, b -> named_struct('level', 0, 'block', b, 'a', 0L, 'b', 0L)),"
                " transform(pairs, p -> named_struct('level', p.level, 'block', cast('' as binary), 'a', p.a, 'b', p.b)))"
            )
        ).alias("x")
    ).select("x.*")
    # Two aggregations share one scan and one exchange: the text of blocks, the integers of pairs.
    bucket = F.expr(f"case when level = 0 then {_bucket(bits, 'block')} else {_bucket(bits, 'a', 'b')} end")
    found = items.groupBy("level", bucket.alias("bucket")).agg(
        F.min("block").alias("b0"), F.max("block").alias("b1"),
        F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("c0"), F.max("b").alias("c1"),
    )
    return bool(found.where("b0 <> b1 or a0 <> a1 or c0 <> c1").limit(1).count())


def sorted_names(rows: DataFrame, bits: int) -> DataFrame:
    """(uid, name) of rows (uid, blocks), each level named by sorting within buckets."""

    def named(items: DataFrame, *key: str) -> DataFrame:
        items = items.withColumn("bucket", F.expr(_bucket(bits, *key)))
        different = items.select("bucket", *key).distinct()
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*key)) - 1
        different = different.withColumn("name", F.col("bucket") + rank)
        room = 1 << (64 - bits)
        different = different.withColumn("name", F.expr(f"if(name - bucket < {room}, name, raise_error('a bucket holds too many blocks'))"))
        return items.join(different, ["bucket", *key]).select("uid", "i", "n", "name")

    level = rows.select("uid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("i", "block"))
    level, done = written(named(level, "block"), "names"), None
    while True:
        last = level.where("n = 1").select("uid", "name")
        done = last if done is None else done.union(last)
        level = level.where("n > 1")
        if not level.limit(1).count():
            return done
        up = level.groupBy("uid", F.expr("i div 2").cast("int").alias("i"), F.expr("(n + 1) div 2").cast("int").alias("n")).agg(
            F.min(F.struct("i", "name")).alias("x"), F.max(F.struct("i", "name")).alias("y"), F.count("*").alias("k")
        )
        one = up.where("k = 1").select("uid", "i", "n", F.col("x.name").alias("name"))
        two = up.where("k = 2").select("uid", "i", "n", F.col("x.name").alias("a"), F.col("y.name").alias("b"))
        level = written(named(two, "a", "b").unionByName(one), "names")


def identities(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, bits: int = BUCKET_BITS) -> DataFrame:
    """One row per row of docs, written to the shared folder: uid, doc_id (the key), n_bytes, n_chars,
    name, text_sha256, row_sha256 (of the text as it is). Rows have equal (n_bytes, name) exactly when their normalised texts are equal.
    A null text counts as empty."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    whole = F.coalesce("text", F.lit(""))
    light = ["doc_id", F.octet_length("norm").cast("long").alias("n_bytes"), F.char_length(whole).cast("long").alias("n_chars")]
    light += [F.sha2(F.col("bytes"), 256).alias("text_sha256"), F.sha2(whole.cast("binary"), 256).alias("row_sha256")]
    rows = _blocked(src, "text", block)
    uid = F.monotonically_increasing_id().alias("uid")
    if not clashes(src, "text", block, bits):
        return written(rows.select(uid, *light, F.expr(fast_name(bits)).alias("name")), "ids")
    rows = written(rows.select(uid, *light, "blocks"), "ids")
    return written(rows.drop("blocks").join(sorted_names(rows.select("uid", "blocks"), bits), "uid"), "ids")


def groups(ids: DataFrame) -> DataFrame:
    """One row per row of identities(): doc_id, keep_id, group_size, kept, and the rest of it.

    Of equal texts, the row with the most code points stays, then the smallest doc_id (null last),
    then one of the repeated rows."""
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("best")
    g = ids.groupBy("n_bytes", "name").agg(F.count("*").alias("group_size"), best)
    # Written, so that both sides of the join are plain exchanges whose hot groups can be split.
    g = written(g, "groups").select("n_bytes", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    return ids.join(g, ["n_bytes", "name"]).withColumn("kept", F.col("uid") == F.col("keep_uid"))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, bits: int = BUCKET_BITS) -> DataFrame:
    """The rows of docs that stay, with their columns: one of each group of equal normalised texts.

    Null texts count as empty; an empty table stays empty. Rows repeated with one key and one text
    count as copies, and one of them stays. Further columns are kept as they are."""
    found = groups(identities(docs, text, key, block, bits)).select("doc_id", "row_sha256", "kept")
    found = written(found.groupBy("doc_id", "row_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    k, h = fresh(docs, "_key", "_sha")
    own = docs.withColumn(k, F.col(key)).withColumn(h, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    gone = small(found.where("not kept").select(F.col("doc_id").alias(k), F.col("row_sha256").alias(h)))
    out = own.join(gone, own[k].eqNullSafe(gone[k]) & (own[h] == gone[h]), "left_anti")
    if found.where("kept and n > 1").limit(1).count():
        out = out.dropDuplicates([k, h])
    return out.drop(k, h)
