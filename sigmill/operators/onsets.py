"""Onset lists: grids, minimum gaps, subdivision, minimum counts, density, normalisation.

Rows are (keys, onset_s). What needs only neighbours is a window; what depends on the last onset
kept is one pass over sorted rows; only lists shorter than a wanted minimum are folded as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_GAP = 0.02
STEP = 0.05
ARRAY = "array<double>"


def length_seconds(n_samples, sample_rate) -> Column:
    n, rate = (x if isinstance(x, Column) else F.col(x) for x in (n_samples, sample_rate))
    return n.cast("double") / rate.cast("double")


def uniform_grid(signals: DataFrame, keys: list[str], length: str, step: float = STEP) -> DataFrame:
    """(keys, event_idx, onset_s): a grid of single-precision steps over `length` seconds. The step is
    rounded to single precision before the division, so 1 s has 19 onsets of 0.05 s, not 20."""
    s = F.lit(step).cast("float")
    n = F.floor(F.col(length).cast("double") / s.cast("double")).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    out = signals.select(*keys, F.explode(idx).alias("event_idx"))
    return out.withColumn("onset_s", (F.col("event_idx").cast("float") * s).cast("double"))


def tail_filter(onsets: DataFrame, length: float | Column, gap: float = MIN_GAP, x: str = "onset_s") -> DataFrame:
    """Drops onsets later than length - gap."""
    return onsets.where(F.col(x) <= (length if isinstance(length, Column) else F.lit(float(length))) - F.lit(float(gap)))


def gathered(onsets: DataFrame, keys: list[str], x: str = "onset_s") -> DataFrame:
    return onsets.groupBy(*keys).agg(F.sort_array(F.collect_list(x)).alias("onsets"))


def exploded(lists: DataFrame, keys: list[str]) -> DataFrame:
    return lists.select(*keys, F.posexplode("onsets").alias("event_idx", "onset_s"))


def numbered(onsets: DataFrame, keys: list[str], x: str = "onset_s") -> DataFrame:
    """(keys, event_idx, onset_s) in the order of time."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(x)) - 1
    return onsets.select(*keys, at.alias("event_idx"), F.col(x).alias("onset_s"))


def min_gap_dedup(onsets: DataFrame, keys: list[str], gap: float = MIN_GAP, length: float | None = None) -> DataFrame:
    """(keys, event_idx, onset_s): an onset stays if it lies at least gap after the last one that stayed."""
    rows = onsets if length is None else tail_filter(onsets, length, gap)
    return numbered(min_gap_stream(rows, keys, gap), keys)


def min_gap_stream(onsets: DataFrame, keys: list[str], gap: float = MIN_GAP, x: str = "onset_s") -> DataFrame:
    """(keys, onset_s) of what min_gap_dedup() keeps, by one pass over sorted rows, which holds the last
    onset kept and no list. Signals are dealt over tasks whole."""
    src = onsets.select(*keys, F.col(x).cast("double").alias("onset_s"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, 0.0
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            ids = list(zip(*(b.column(k).to_pylist() for k in range(n)), strict=True)) if n else [()] * b.num_rows
            for i, (k, t) in enumerate(zip(ids, b.column(n).to_pylist(), strict=True)):
                if k != last_key or t - last >= gap:
                    keep[i], last_key, last = True, k, t
            yield b.filter(pa.array(keep))

    return src.where("onset_s is not null").repartition(*keys).sortWithinPartitions(*keys, "onset_s").mapInArrow(run, src.schema)


def _points(start: str, end: str, k: str) -> str:
    """SQL: k points that cut [start, end] into equal parts; none for k < 1."""
    return f"case when {k} < 1 then cast(array() as {ARRAY}) else transform(sequence(1, {k}), i -> {start} + ({end} - {start}) * i / ({k} + 1)) end"


def subdivide_gaps(onsets: DataFrame, keys: list[str], k: Column, length: float, x: str = "onset_s") -> DataFrame:
    """Adds k points after each onset, up to the next one or, for the last, up to length. k may depend
    on gap, the distance to there."""
    nxt = F.lead(x, 1, float(length)).over(Window.partitionBy(*keys).orderBy(x))
    rows = onsets.select(*keys, F.col(x).alias("_s"), nxt.alias("_e")).withColumn("gap", F.col("_e") - F.col("_s")).withColumn("_k", k.cast("int"))
    return rows.select(*keys, F.explode(F.expr(f"concat(array(_s), {_points('_s', '_e', '_k')})")).alias(x))


def filled(onsets: str, least: int, length: float) -> Column:
    """At least `least` onsets: the largest gap between neighbours (the first of equal ones) is halved
    again and again; one onset is cut with the length; an empty list becomes equal steps over it."""
    gaps = "transform(sequence(1, size(acc) - 1), j -> acc[j] - acc[j - 1])"
    halve = f"case when size(acc) = 1 then array(acc[0], (acc[0] + {length}D) / 2) else transform(array(cast(array_position({gaps}, array_max({gaps})) as int)), p -> concat(slice(acc, 1, p), array((acc[p - 1] + acc[p]) / 2), slice(acc, p + 1, size(acc)))) [0] end"
    steps = f"filter(sequence(1, {least}), i -> i <= {least} - size({onsets}))"
    empty = f"transform(sequence(0, {least} - 1), i -> {length}D * i / {max(least - 1, 1)})"
    return F.expr(f"case when size({onsets}) = 0 then {empty} else aggregate({steps}, {onsets}, (acc, i) -> {halve}) end")


def min_count_fill(onsets: DataFrame, keys: list[str], least: int, length: float, everyone: DataFrame | None = None) -> DataFrame:
    """(keys, event_idx, onset_s) with at least `least` onsets per signal; only signals with fewer are
    gathered. everyone: the keys of all signals, where signals without onsets count too."""
    rows = onsets.select(*keys, "onset_s", F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    lists = gathered(rows.where(F.col("_n") < least), keys)
    if everyone is not None:
        none = everyone.join(onsets.select(*keys).distinct(), keys, "left_anti")
        lists = lists.unionByName(none.select(*keys, F.expr(f"cast(array() as {ARRAY})").alias("onsets")))
    few = exploded(lists.withColumn("onsets", filled("onsets", least, length)), keys)
    return numbered(rows.where(F.col("_n") >= least), keys).union(few)


def equalize_density(onsets: DataFrame, keys: list[str], length: float, x: str = "onset_s") -> DataFrame:
    """Gaps above Q3 + 1.5 IQR of the signal's gaps get int(gap / median gap) - 1 points."""
    w = Window.partitionBy(*keys)
    gap = F.lead(x).over(w.orderBy(x)) - F.col(x)
    rows = onsets.withColumn("_gap", gap)
    rows = rows.withColumn("_q", F.expr(f"percentile(_gap, array(0.25D, 0.5D, 0.75D)) over (partition by {', '.join(keys)})"))
    rows = rows.select(
        *keys, F.col(x).alias("_s"), (F.col(x) + F.col("_gap")).alias("_e"),
        F.expr("case when _gap > _q[2] + 1.5D * (_q[2] - _q[0]) then greatest(0, cast(floor(try_divide(_gap, _q[1])) as int) - 1) else 0 end").alias("_k"),
    )
    return rows.select(*keys, F.explode(F.expr(f"concat(array(_s), coalesce({_points('_s', '_e', '_k')}, cast(array() as {ARRAY})))")).alias(x))


def largest_gap(onsets: DataFrame, keys: list[str], x: str = "onset_s") -> DataFrame:
    """(keys, s, gap) of each signal's largest gap between neighbours; of equal ones, the first."""
    rows = onsets.select(*keys, F.col(x).alias("s"), (F.lead(x).over(Window.partitionBy(*keys).orderBy(x)) - F.col(x)).alias("gap"))
    return rows.where("gap is not null").groupBy(*keys).agg(F.max(F.struct("gap", (-F.col("s")).alias("m"))).alias("b")).select(*keys, (-F.col("b.m")).alias("s"), "b.gap")


def normalize(onsets: DataFrame, length: float | Column, x: str = "onset_s") -> DataFrame:
    return onsets.withColumn("onset_norm", F.col(x) / (length if isinstance(length, Column) else F.lit(float(length))))


def denormalize(onsets: DataFrame, length: float | Column, x: str = "onset_norm") -> DataFrame:
    return onsets.withColumn("onset_s", F.col(x) * (length if isinstance(length, Column) else F.lit(float(length))))


def pipeline(onsets: DataFrame, keys: list[str], length: float, gap: float = MIN_GAP, least: int = 4) -> DataFrame:
    """Tail filter, minimum gap, minimum count, then both the seconds and the normalised onsets."""
    kept = min_gap_dedup(onsets, keys, gap, length).drop("event_idx")
    return normalize(min_count_fill(kept, keys, least, length), length)
