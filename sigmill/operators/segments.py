"""Events: bounds, assignment of samples, fades, splitting of waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(onsets: DataFrame, keys: list[str], last_end: float | Column, x: str = "onset_s") -> DataFrame:
    """(keys, event_idx, start_s, end_s): an event ends where the next starts, the last one at last_end."""
    w = Window.partitionBy(*keys).orderBy(x)
    end = last_end if isinstance(last_end, Column) else F.lit(float(last_end))
    return onsets.select(*keys, (F.row_number().over(w) - 1).alias("event_idx"), F.col(x).alias("start_s"), F.coalesce(F.lead(x).over(w), end).alias("end_s"))


def assign(points: DataFrame, events: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Points with the event that they lie in: the latest start at or before t, by a union and a running
    window instead of a range join. Points before the first event drop out."""
    cols = [c for c in points.columns if c not in keys]
    p = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_k"), F.struct(*cols).alias("_p"), F.lit(None).cast("int").alias("_e"))
    e = events.select(*keys, F.col("start_s").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col("event_idx").cast("int").alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = p.union(e).withColumn("event_idx", F.last("_e", ignorenulls=True).over(w))
    return out.where("_k = 1 and event_idx is not null").select(*keys, "event_idx", "_p.*")


def fade(samples: str, n_in: int, n_out: int) -> Column:
    """Linear: sample j of the first n_in is multiplied by j / n_in, the same from the end; the lengths
    are at most the event's, and where both meet, both count."""
    v = f"{samples}"
    i, o = f"least({int(n_in)}, size({v}))", f"least({int(n_out)}, size({v}))"
    step_in = f"case when _j < {i} then cast(_j as double) / {i} else 1D end"
    step_out = f"case when size({v}) - 1 - _j < {o} then cast(size({v}) - 1 - _j as double) / {o} else 1D end"
    return F.expr(f"transform({v}, (_x, _j) -> _x * {step_in} * {step_out})")


def split(waves: DataFrame, events: DataFrame, keys: list[str], samples: str, sample_rate: str, n_in: int = 5, n_out: int = 5) -> DataFrame:
    """(keys, event_idx, start_s, end_s, samples): each event's samples, faded. A wave with one event
    stays whole, without fades; samples before the first event drop out, and the last event runs to the
    end of the wave, wherever its bound lies. waves: one row per key.

    The bounds, a few numbers per event, are gathered per wave before the join, so that each wave is
    read once and cut in place; no window or exchange holds a wave more than once."""
    e = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("event_idx", "start_s", "end_s"))).alias("_e"))
    rows = e.join(waves.select(*keys, F.col(samples).cast("array<double>").alias("_x"), F.col(sample_rate).alias("_r")), keys)
    stop = "case when _i = size(_e) - 1 then size(_x) else cast(round(_v.end_s * _r) as int) end"
    first = "cast(round(_v.start_s * _r) as int)"
    whole = "case when size(_e) = 1 then _x else slice(_x, {f} + 1, greatest({s} - {f}, 0)) end".format(f=first, s=stop)
    cut = F.expr(f"transform(_e, (_v, _i) -> named_struct('event_idx', _v.event_idx, 'start_s', _v.start_s, 'end_s', _v.end_s, 'w', {whole}, 'one', size(_e) = 1))")
    out = rows.select(*keys, F.explode(cut).alias("_v")).select(*keys, "_v.event_idx", "_v.start_s", "_v.end_s", F.col("_v.w").alias("_w"), F.col("_v.one").alias("_one"))
    return out.select(*keys, "event_idx", "start_s", "end_s", F.when(F.col("_one"), F.col("_w")).otherwise(fade("_w", n_in, n_out)).alias("samples"))
