"""Mixing sources to target weights: repeat each document floor(rate) times plus a Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, small, written

#: Cells of the draw's range, per source, whose words are counted to place the draw.
CELLS = 4096


def words(text) -> F.Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: str) -> F.Column:
    """The hash-seeded uniform number of a document, in [0, 1): the first 52 bits of a digest of its key."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """Adds target to (source_size, weight) rows: weight times one level, at most `most` times the
    size, where what is above goes to the others by weight until none is above. Each step is one
    small aggregation over the table of sources, which is never gathered."""
    cap = F.col("source_size") * F.lit(float(most))
    left, weight = budget, sources.agg(F.sum("weight")).first()[0] or 0.0
    level, full = 0.0, -1
    while weight:
        level = left / weight
        over = F.col("weight") * F.lit(level) >= cap
        a, n, w = sources.agg(F.sum(F.when(over, cap)), F.count(F.when(over, 1)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full:
            break
        full, left, weight = n, budget - (a or 0.0), w or 0.0
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap) if weight else cap)


def rates(docs: DataFrame, weights: tuple[float, ...] | DataFrame, share: float, most: float, text: str, source: str, key: str) -> DataFrame:
    """Per source, written: source, source_size, target, whole (copies that each document has), upto
    (documents whose draw is below it get one more)."""
    light = written(docs.select(F.col(key).alias("k"), F.col(source).alias("source"), words(F.col(text)).alias("size")).withColumn("cell", F.floor(draw("k") * CELLS).cast("int")).groupBy("source", "cell").agg(F.sum("size").alias("size")), "cells")
    by = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        by = by.join(weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["weight"])
    else:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
        by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    size = light.count()
    by = written(by, "sources", size)
    by = targets(by, share * float(by.agg(F.sum("source_size")).first()[0] or 0), most)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    by = by.withColumn("whole", F.floor(rate).cast("int")).withColumn("need", (rate - F.floor(rate)) * F.col("source_size"))
    # The draw's place among the source's words: the cell where the words below it reach the need.
    w = Window.partitionBy("source").orderBy("cell")
    cum = light.withColumn("below", F.sum("size").over(w) - F.col("size"))
    b = by.select(F.col("source").alias("s"), "need")
    part = F.coalesce(F.try_divide(F.col("need") - F.col("below"), F.col("size")), F.lit(0.0))
    cut = cum.join(b, F.col("source").eqNullSafe(F.col("s"))).where("size > 0 and below < need").groupBy(F.col("s")).agg(F.max((F.col("cell") + F.least(part, F.lit(1.0))) / F.lit(float(CELLS))).alias("upto"))
    out = by.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("upto", F.lit(0.0)).alias("upto"))
    return written(out, "rates", size)


def mix_counts(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with the columns _size, _source_size, _target and _copies (named anew where taken).

    Sources' sizes are their words, aggregated in full. weights: by the place of the source in code
    point order, null last, repeating; or a table (source, weight). share: words of the mix over all
    words; most: largest repetition rate. A document comes floor(rate) times, and once more if its
    draw, seeded by the hash of its key, falls below the rate's fraction. The draw is measured in
    the words of the source's documents with smaller hashes (by 4096 cells), so that a source's
    taken words come as near to its target as one cell allows. Null texts have size 0, null sources
    are one source, repeated rows share their draw; an empty table gives an empty one."""
    z, t, g, n, s = fresh(docs, "_size", "_source_size", "_target", "_copies", "_s")
    r = small(rates(docs, weights, share, most, text, source, key)).select(F.col("source").alias(s), F.col("source_size").alias(t), F.col("target").alias(g), "whole", "upto")
    wh, up = fresh(docs, "_whole", "_upto")
    r = r.withColumnRenamed("whole", wh).withColumnRenamed("upto", up)
    out = docs.withColumn(z, words(F.col(text))).join(r, docs[source].eqNullSafe(F.col(s)))
    return out.withColumn(n, F.col(wh) + (draw(key) < F.col(up)).cast("int")).drop(s, wh, up)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as mix_counts() says, with docs' columns."""
    z, t, g, n = fresh(docs, "_size", "_source_size", "_target", "_copies")
    out = mix_counts(docs, **options).where(F.col(n) > 0)
    (i,) = fresh(out, "_i")
    return out.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
