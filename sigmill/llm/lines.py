"""Line dedup: an exact set-similarity join of lines (built-in functions only).

A line's tokens are its different words; two lines match when the Jaccard similarity of their tokens
is 0.8 or more. Equal lines are found by their text and take part once, as do lines with equal tokens.
Tokens are ordered by rarity: by the logarithm of how many different lines of the whole corpus have a
token of their cell (CELLS cells of the tokens' hashes, so that the table has a fixed size), then by
hash. An index of each set's first n - ceil(0.8 n) + 1 tokens finds every pair.

A pair that shares many of them is made once for each run of tokens that the two have in common, not
once for each token: at any token whose predecessor is the same in both, an earlier one is shared.
Length and positional filters (no token before the first shared one is in both) and bitmaps of the
tokens' parities (the bits in which two differ are at most the tokens that one set has alone), a small
one in the join and a larger one after it, thin the candidates; the intersection of the whole sets
decides.

All pairs of a group of near copies are links, so their number grows with the square of the group.
They are not made where distances settle them: sets with the same smallest or largest tokens are
compared with the commonest of them, their pivot. Two that differ from it in da and db tokens differ from each other in
da + db at most; where that is little enough they match, and what they add (a number of links, the
first place) is summed over (pivot, size, distance) instead. Two sets of one pivot that distances leave open are decided
in the join, by the tokens in which each differs from it. All other pairs go through the join and its filters.

Tokens are hashes of BITS bits and sets go by 128 bits: among n lines about n^2 / 2^129 pairs of
sets fall together by chance, and two words of one pair of lines once in 10^10 pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, fresh, release, small, written

#: Similarity as a fraction: 4 / 5.
NUM, DEN = 4, 5
CELLS = 1 << 18
#: Bits of a token's hash.
BITS = 44
#: 64-bit words of the bitmaps that candidates are tested by before their sets are moved.
WORDS = 8
#: Sets of so many tokens and more have 128 bits in the join, others 64: those tell nothing of sets that may differ in 20 tokens.
WIDE = 80
#: Rows (8 to 24 bytes each) up to which ids of sets are broadcast; counted first.
ID_ROWS = 1_000_000
#: Sets of NEAR_SIZE tokens and more that share a key (two neighbours of their three smallest or largest tokens) have a pivot, if they
#: are NEAR_GROUP or more: smaller groups have few pairs, and in smaller sets hardly any pair is settled by distances.
NEAR_SIZE, NEAR_GROUP = 18, 16


def _hashes(*cols) -> list[F.Column]:
    """Two independent 64-bit hashes, g and h."""
    return [F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(7), *cols).alias("g")]


def _split(docs: DataFrame, text: str, *more) -> DataFrame:
    return docs.select(*more, F.posexplode(F.split(F.col(text), "\n")).alias("line", "t")).where(F.ltrim("t", F.lit(" \t\n\x0b\f\r")) != "")


def places(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(z, doc_id, row, line, h, g): where the lines with words are. row tells rows of one key apart
    by their text; z is true for a null key."""
    row = F.xxhash64(text).alias("row")
    return _split(docs, text, F.col(key).isNull().alias("z"), F.col(key).alias("doc_id"), row).select("z", "doc_id", "row", "line", *_hashes("t"))


def token_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, h, g, k, tokens, sh, sg, p, q), one row per different line with words: how often it comes, tokens as
    sorted hashes, the hashes of the line and of its tokens, and the parities of the tokens in 64 cells: p of all,
    q (0 in sets of less than WIDE) of half of them."""
    token = lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - BITS)
    t = _split(docs, text).groupBy("t").agg(F.count("*").alias("k"))
    words = F.when(F.col("t").rlike(r"[\x09\x0B-\x0D]"), F.split("t", f"[{SPACE}]+")).otherwise(F.split("t", " "))
    t = t.select("k", *_hashes("t"), F.sort_array(F.array_remove(F.array_distinct(F.transform(words, token)), token(F.lit("")))).alias("tokens"))
    sh, sg = _hashes("tokens")
    parity = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(_bit(t)))
    half = F.filter("tokens", lambda t: t.bitwiseAND(F.lit(1 << 26)) != 0)
    q = F.when(F.size("tokens") < WIDE, F.lit(0).cast("long")).otherwise(parity(half))
    return t.select(F.monotonically_increasing_id().alias("uid"), "h", "g", "k", "tokens", sh.alias("sh"), sg.alias("sg"), parity("tokens").alias("p"), q.alias("q"))


def _rarity(sets: DataFrame) -> bytes:
    """For each cell of token hashes, one byte: 1 + log2 of the sets that have such a token."""
    seen = sets.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.count("*").alias("k"))
    table = bytearray(b"\1" * CELLS)
    for cell, n in seen.collect():  # CELLS rows at most
        table[cell] = 1 + int(math.log2(n))
    return bytes(table)


def _ordered(rarity: bytes) -> F.Column:
    """The tokens as integers that sort by rarity: its byte, then the hash."""
    table = F.split(F.lit(",".join(map(str, rarity))), ",").cast("array<long>")  # folded to a literal
    rank = lambda t: F.get(table, t.bitwiseAND(F.lit(CELLS - 1)).cast("int"))
    whole = lambda t: F.shiftleft(rank(t), BITS).bitwiseOR(t)
    return F.sort_array(F.transform("tokens", lambda t: F.coalesce(whole(t), F.lit(0).cast("long"))))


def need(a: str, b: str) -> str:
    """Tokens that two sets of a and b tokens share at least when they match."""
    return f"cast(({NUM} * ({a} + {b}) + {NUM + DEN - 1}) div {NUM + DEN} as int)"


def slack(a: str, b: str) -> str:
    """Tokens that one of two sets of a and b tokens has alone, at most, when they match; they do match then."""
    return f"({a} + {b} - 2 * {need(a, b)})"


def differ(a: str, b: str) -> str:
    """Bits in which the parities n, p and q of two sets differ: as many tokens at least are in one of the two alone."""
    p, q = f"(p{a} ^ p{b})", f"(q{a} ^ q{b})"
    return f"if(least(n{a}, n{b}) >= {WIDE}, bit_count({p} ^ {q}) + bit_count({q}), bit_count({p}))"


def near_groups(sets: DataFrame) -> DataFrame:
    """(uid, pivot, n, d, x): sets (uid, k, tokens, p, q) that match their pivot or nearly, their size, and the number and
    list of the tokens in which the two differ; written. The pivot is the commonest
    line (by k) of those that share a key; of several, that of the key which most sets have. Tokens are moved only of
    sets that the parities leave, where NEAR_GROUP or more have one pivot."""
    keys = [f"xxhash64(slice(tokens, {at}, 2))" for at in (1, 2, -2, -3)]  # a token more or less at an end moves these by one
    of = F.explode(F.expr(f"array({', '.join(keys)})")).alias("key")
    own = sets.where(F.size("tokens") >= NEAR_SIZE).select("uid", "k", F.size("tokens").alias("n"), "p", "q", of)
    often = written(own.groupBy("key").agg(F.count("*").alias("c")).where(f"c >= {NEAR_GROUP}"), "keys")
    own = own.join(small(often, ID_ROWS), "key")
    top = [F.max_by(c, "k").alias(to) for c, to in (("uid", "pivot"), ("n", "n_"), ("p", "p_"), ("q", "q_"))]
    top = written(own.groupBy("key").agg(*top), "pivots")
    ids = own.withColumnsRenamed({c: f"{c}1" for c in ("n", "p", "q")}).join(small(top, ID_ROWS), "key")
    ids = ids.where(f"abs(n1 - n_) <= 2 * {slack('n1', 'n_')} and {differ('1', '_')} <= 2 * {slack('n1', 'n_')}")
    ids = written(ids.groupBy("uid", "pivot").agg(F.max("c").alias("c")), "members")
    large = written(ids.groupBy("pivot").agg(F.count("*").alias("m")).where(f"m >= {NEAR_GROUP}").select("pivot"), "large")
    ids = ids.join(small(large, ID_ROWS), "pivot")
    pivots = written(sets.join(small(large.select(F.col("pivot").alias("uid")), ID_ROWS), "uid", "left_semi").select(F.col("uid").alias("pivot"), F.col("tokens").alias("t")), "pivots")
    n, x = F.size("tokens"), F.concat(F.array_except("tokens", "t"), F.array_except("t", "tokens"))
    met = sets.select("uid", "tokens").join(small(ids, ID_ROWS), "uid").join(small(pivots), "pivot")
    met = met.select("uid", "pivot", "c", n.alias("n"), F.size("t").alias("n_"), x.alias("x")).withColumn("d", F.size("x"))
    met = written(met.where(f"d <= 2 * {slack('n', 'n_')}").drop("n_"), "met")
    best = met.groupBy("uid").agg(F.max_by("pivot", "c").alias("pivot"))
    return written(met.join(small(best, ID_ROWS), ["uid", "pivot"]).select("uid", "pivot", "n", "d", "x"), "groups")


def certain(groups: DataFrame, first: DataFrame) -> DataFrame:
    """(a, other, n): for each set of groups the number of sets that match it by their distances to the pivot, and the
    first place of those (its own among them, perhaps)."""
    all_ = groups.join(first, groups.uid == first.sid).groupBy("pivot", "n", "d").agg(F.count("*").alias("c"), F.min("first").alias("first"))
    all_ = written(all_, "rings")
    side = lambda k: all_.select("pivot", *[F.col(c).alias(f"{c}{k}") for c in ("n", "d", "c", "first")])
    met = side("a").join(side("b"), "pivot").where(f"da + db <= {slack('na', 'nb')}")
    met = met.groupBy("pivot", F.col("na").alias("n"), F.col("da").alias("d")).agg(F.min("firstb").alias("other"), F.sum("cb").alias("c"))
    own = F.expr(f"case when 2 * d <= {slack('n', 'n')} then 1L else 0L end")
    met = met.select("pivot", "n", "d", "other", (F.col("c") - own).alias("links"))
    return groups.join(met, ["pivot", "n", "d"]).select(F.col("uid").alias("a"), "other", F.col("links").alias("n"))


def _bit(t: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 20).bitwiseAND(F.lit(63)).cast("int"))


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(uid, n, w0, w1, ...): the parities of the set's tokens in 64 * WORDS cells."""
    t = sets.select("uid", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    word = F.shiftright("t", 26).bitwiseAND(F.lit(WORDS - 1))
    return t.groupBy("uid", "n").agg(*[F.bit_xor(F.when(word == k, _bit(F.col("t"))).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)])


def with_groups(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(uid, tokens, p, q, g): g has what near_groups() knows of the set; null takes less room in the join than its columns."""
    g = F.struct("pivot", "d", "x").alias("g")
    return sets.select("uid", "tokens", "p", "q").join(small(groups.select("uid", g)), "uid", "left")


def _entries(sets: DataFrame, rarity: bytes) -> DataFrame:
    """(o, uid, n, i, p, q, v, g): a set's first tokens, with its size, the place i, its parities, the
    token before (-1: none), and the g of sets (uid, tokens, p, q, g)."""
    t = sets.select("uid", F.size("tokens").alias("n"), "p", "q", _ordered(rarity).alias("x"), "g")
    prefix = f"slice(x, 1, cast(n - ({NUM} * n + {DEN - 1}) div {DEN} + 1 as int))"
    t = t.select("uid", "n", "p", "q", "x", "g", F.posexplode(F.expr(prefix)).alias("i", "o"))
    mask = (1 << BITS) - 1  # the rarity has done its work in the order
    return t.select(F.expr(f"o & {mask}L").alias("o"), "uid", "n", "i", "p", "q", F.expr(f"case when i = 0 then -1L else x[i - 1] & {mask}L end").alias("v"), "g")


def _candidates(sets: DataFrame, rarity: bytes) -> DataFrame:
    """(a, b, sure): uids of sets, a the larger (of equal size, the later), that pass the filters and are not certain();
    sure: they match, as the tokens in which the two differ from one pivot tell."""
    entries = _entries(sets, rarity)
    side = lambda k: entries.select("o", *[F.col(c).alias(f"{c}{k}") for c in ("uid", "n", "i", "p", "q", "v", "g")])
    # The positional filter has the shorter prefix in it: put on one side alone it would be pushed down,
    # and the two sides would no longer share one exchange.
    # What two sets of one pivot differ in is what either differs from it in, less what both do: no false pairs there.
    apart = "ga.d + gb.d - 2 * size(array_intersect(ga.x, gb.x))"
    near = side("a").join(side("b"), "o").where(
        f"(nb < na or nb = na and uidb < uida) and {DEN} * nb >= {NUM} * na and (va <> vb or ia = 0 or ib = 0) and least(na - ia, nb - ib) >= {need('na', 'nb')}"
        f" and {differ('a', 'b')} <= {slack('na', 'nb')} and not coalesce(ga.pivot = gb.pivot and (ga.d + gb.d <= {slack('na', 'nb')} or {apart} > {slack('na', 'nb')}), false)"
    )
    return near.select(F.col("uida").alias("a"), F.col("uidb").alias("b"), F.expr("coalesce(ga.pivot = gb.pivot, false)").alias("sure")).distinct()


def links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): all matching pairs of the sets (uid, tokens, p, q) but those that are certain() by groups, each once; written."""
    all_ = written(_candidates(with_groups(sets, groups), _rarity(sets)), "pairs")
    release(sets.sparkSession)
    pairs = all_.where("not sure").select("a", "b")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "ids", 2 * pairs.count())
    sets = written(sets.select("uid", "tokens").join(small(ids, ID_ROWS), "uid", "left_semi"), "sets")
    maps = written(_bitmaps(sets), "bitmaps", ids.count())
    side = lambda k: maps.select(*[F.col(c).alias(f"{c}{k}") for c in maps.columns])
    apart = " + ".join(f"bit_count(w{k}a ^ w{k}b)" for k in range(WORDS))
    near = pairs.join(side("b"), F.col("b") == F.col("uidb")).join(side("a"), F.col("a") == F.col("uida"))
    near = written(near.where(f"{apart} <= na + nb - 2 * {need('na', 'nb')}").select("a", "b"), "near")
    release(sets.sparkSession)
    own = lambda k: sets.select(F.col("uid").alias(k), F.col("tokens").alias(f"t{k}"))
    found = near.join(own("b"), "b").join(own("a"), "a")
    found = found.where(f"size(array_intersect(ta, tb)) >= {need('size(ta)', 'size(tb)')}").select("a", "b")
    found = written(found.union(all_.where("sure").select("a", "b")), "links")
    for t in (all_, ids, sets, maps, near):
        discard(t)
    release(found.sparkSession)
    return found


def later_matches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, row, removed, n_links, classes), per key and text with words: the numbers, from 0, of the
    lines that match an earlier line of the corpus; how many other token sets match its lines' sets,
    summed over the lines; and, per line with words, its class, which is the first place
    (struct doc_id, line) of a line with the same tokens.

    Earlier is by key (null last), then by row (a hash of the text, which tells rows of one key
    apart), then by line number; it doesn't matter whether the earlier line is itself removed. Lines
    with equal tokens match. Lines without words are never removed. Rows repeated with one key and
    one text are one place: they don't remove each other's lines. An empty table gives an empty one."""
    sets = written(token_sets(docs, text), "lines")
    light = written(places(docs, text, key), "places")
    # Different lines with the same tokens, which are few: the commonest one stands for them.
    same = sets.groupBy("sh", "sg").agg(F.max_by("uid", "k").alias("sid"), F.count("*").alias("k")).where("k > 1")
    same = written(same.select("sh", "sg", "sid"), "same", sets.count())
    more = written(sets.select("uid", "sh", "sg").join(small(same), ["sh", "sg"]).where("uid <> sid").select("uid", "sid"), "more", sets.count())
    line = sets.select("uid", "h", "g").join(small(more), "uid", "left").select("h", "g", F.coalesce("sid", "uid").alias("sid"))
    at = light
    light = written(light.join(line, ["h", "g"]).select("z", "doc_id", "row", "line", "sid"), "placed", light.count())
    discard(at)
    one = sets.join(small(more), "uid", "left_anti").select("uid", "tokens", "k", "p", "q")
    groups = near_groups(one)
    release(docs.sparkSession)
    both = links(one, groups)
    discard(sets)
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = written(light.groupBy("sid").agg(F.min(F.struct("z", "doc_id", "row", "line")).alias("first")), "first", light.count())
    other = both.join(first, both.b == first.sid).select("a", F.col("first").alias("other"), F.lit(1).cast("long").alias("n"))
    other = other.unionByName(certain(groups, first)).groupBy("a").agg(F.min("other").alias("other"), F.sum("n").alias("n"))
    best = first.join(other, first.sid == other.a, "left")
    best = written(best.select("sid", "first", F.least("first", F.coalesce("other", "first")).alias("best"), F.coalesce("n", F.lit(0)).alias("n")), "best", first.count())
    at = light.join(best, "sid")
    gone = F.struct("z", "doc_id", "row", "line") > F.col("best")
    one = F.struct("line", gone.alias("gone"), "n", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("at"))
    g = at.groupBy("z", "doc_id", "row").agg(F.sort_array(F.collect_set(one)).alias("x"))
    return g.select(
        "doc_id", "row", F.expr("transform(filter(x, x -> x.gone), x -> x.line)").alias("removed"), F.expr("aggregate(x, 0L, (s, x) -> s + x.n)").alias("n_links"),
        F.expr("transform(x, x -> named_struct('doc_id', x.doc_id, 'line', x.at))").alias("classes"),
    )


def with_matches(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with later_matches() of them beside each row: found's columns removed, n_links and classes are
    null for rows without words."""
    k, r, h = fresh(docs, "_key", "_row", "_own")
    f = found.withColumnRenamed("doc_id", k).withColumnRenamed("row", r)
    own = docs.withColumn(h, F.xxhash64(text))
    return own.join(f, own[key].eqNullSafe(f[k]) & (own[h] == f[r]), "left").drop(k, r, h)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the lines of later_matches(): the other lines joined by line ends. Columns and rows
    stay, a null text stays null; an empty table stays empty."""
    (r,) = fresh(docs, "_removed")
    gone = later_matches(docs, text, key).select("doc_id", "row", F.col("removed").alias(r)).where(F.size(r) > 0)
    out = with_matches(docs, gone, text, key)
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(r), i)), "\n")
    return out.withColumn(text, F.when(F.col(r).isNull(), F.col(text)).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
