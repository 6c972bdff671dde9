"""Statistics of frame descriptors per event, ranges and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STATISTICS


def mean(x) -> Column:
    return F.avg(x)


def weight(x, factor: float = 0.05) -> Column:
    """Of a frame, from its first cepstral coefficient."""
    return F.exp(F.col(x) * F.lit(factor) if isinstance(x, str) else x * F.lit(factor))


def weighted_mean(x: str, w: Column) -> Column:
    """Weighted mean; undivided where the weights don't sum to more than zero."""
    total = F.sum(w)
    return F.when(total > 0, F.try_divide(F.sum(F.col(x) * w), total)).otherwise(F.sum(F.col(x) * w))


def median(x) -> Column:
    """Exact, the middle two interpolated."""
    return F.percentile(x, F.lit(0.5))


def median_of_few(x) -> Column:
    """median() for many groups of few values: a sorted list is cheaper there than counts by value."""
    s = F.sort_array(F.collect_list(x))
    n = F.size(s)
    at = lambda i: F.get(s, F.floor(i).cast("int"))
    return (at((n - 1) / 2) + at(n / 2)) / F.lit(2.0)


def statistics(x: str, w: Column | None = None) -> Column:
    """The record (mean, median, variance, skewness, kurtosis) of x in a group, the frames of one event:
    population moments around the unweighted mean, excess kurtosis; null where a moment isn't defined."""
    parts = [weighted_mean(x, w) if w is not None else mean(x), median_of_few(x), F.var_pop(x), F.skewness(x), F.kurtosis(x)]
    return F.struct(*[p.alias(n) for p, n in zip(parts, STATISTICS, strict=True)])


def event_statistics(frames: DataFrame, keys: list[str], features: list[str], weight_by: str | None = None, unweighted: tuple[str, ...] = (), factor: float = 0.05) -> DataFrame:
    """One row per event, with a statistic record per feature. Selecting single statistics of it leaves
    only their aggregates in the plan."""
    w = weight(weight_by, factor) if weight_by else None
    return frames.groupBy(*keys).agg(*[statistics(f, None if f in unweighted else w).alias(f) for f in features])


def project(events: DataFrame, keys: list[str], features: list[str], statistic: str) -> DataFrame:
    """One statistic of chosen features, as columns."""
    return events.select(*keys, *[F.col(f"{f}.{statistic}").alias(f) for f in features])


def long_form(events: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, mean ... kurtosis)."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("s")) for f in features])).alias("x")
    return events.select(*keys, rows).select(*keys, "x.feature", "x.s.*")


def dimension_range(rows: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """Minimum and maximum without NaN; null for no values."""
    v = F.when(~F.isnan(x), F.col(x))
    return rows.groupBy(*(keys or [])).agg(F.min(v).alias("low"), F.max(v).alias("high"))


def normalization_multiplier(rows: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """1 / max(|low|, |high|); null where all are zero."""
    r = dimension_range(rows, x, keys)
    return r.select(*(keys or []), F.try_divide(F.lit(1.0), F.greatest(F.abs("low"), F.abs("high"))).alias("multiplier"))


def binwise(rows: DataFrame, vector: str, statistic, keys: list[str] | None = None) -> DataFrame:
    """statistic(column) -> aggregate, of each position of a vector column: (keys, bin, value)."""
    bins = rows.select(*(keys or []), F.posexplode(vector).alias("bin", "v"))
    return bins.groupBy(*(keys or []), "bin").agg(statistic(F.col("v").cast("double")).alias("value"))


def transpose(rows: DataFrame, vector: str, order: str) -> DataFrame:
    """(bin, column): the vectors' values at each position, in the order of the rows."""
    bins = rows.select(order, F.posexplode(vector).alias("bin", "v"))
    pairs = F.sort_array(F.collect_list(F.struct(order, "v")))
    return bins.groupBy("bin").agg(F.transform(pairs, lambda p: p["v"]).alias("column"))


def truncate(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order, all if fewer."""
    return rows.orderBy(order).limit(n)


def in_range(rows: DataFrame, x: str, low: float, high: float) -> DataFrame:
    return rows.where(F.col(x).between(low, high))


def equalize_histogram(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("equalized", F.cume_dist().over(Window.partitionBy(*keys).orderBy(x)))
