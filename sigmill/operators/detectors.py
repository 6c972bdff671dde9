"""Onset detection functions over consecutive spectra, and peak picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hfc(mag: str) -> Column:
    """High-frequency content: sum of k |X_k|."""
    return F.expr(f"aggregate(transform({mag}, (v, k) -> v * k), 0D, (s, v) -> s + v)")


def _over(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def flux(mag: str, keys: list[str], order: str) -> Column:
    """Half-wave rectified L1 difference to the frame before; 0 for the first."""
    prev = F.lag(mag).over(_over(keys, order))
    d = F.zip_with(F.col(mag), prev, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return F.when(prev.isNull(), F.lit(0.0)).otherwise(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def rms_rise(x: str, keys: list[str], order: str) -> Column:
    rms = F.sqrt(F.expr(f"aggregate({x}, 0D, (s, v) -> s + v * v) / size({x})"))
    return F.coalesce(F.greatest(rms - F.lag(rms).over(_over(keys, order)), F.lit(0.0)), F.lit(0.0))


def _expected(phase: str, keys: list[str], order: str) -> tuple[Column, Column]:
    w = _over(keys, order)
    return F.lag(phase, 1).over(w), F.lag(phase, 2).over(w)


def complex_domain(mag: str, phase: str, keys: list[str], order: str) -> Column:
    """Sum of the distances to the value that steady magnitude and phase advance predict; 0 for the
    first two frames."""
    p1, p2 = _expected(phase, keys, order)
    m1 = F.lag(mag).over(_over(keys, order))
    at = F.arrays_zip(F.col(mag).alias("m"), F.col(phase).alias("p"), m1.alias("m1"), p1.alias("p1"), p2.alias("p2"))

    def distance(z):
        turn = z["p"] - F.lit(2.0) * z["p1"] + z["p2"]
        return F.sqrt(F.greatest(z["m"] * z["m"] + z["m1"] * z["m1"] - F.lit(2.0) * z["m"] * z["m1"] * F.cos(turn), F.lit(0.0)))

    return F.when(p2.isNull(), F.lit(0.0)).otherwise(F.aggregate(F.transform(at, distance), F.lit(0.0), lambda s, x: s + x))


def complex_phase(mag: str, phase: str, keys: list[str], order: str) -> Column:
    """Magnitude-weighted phase deviation; 0 for the first two frames."""
    p1, p2 = _expected(phase, keys, order)
    at = F.arrays_zip(F.col(mag).alias("m"), F.col(phase).alias("p"), p1.alias("p1"), p2.alias("p2"))

    def deviation(z):
        turn = z["p"] - F.lit(2.0) * z["p1"] + z["p2"]
        return z["m"] * F.acos(F.least(F.greatest(F.cos(turn), F.lit(-1.0)), F.lit(1.0)))

    return F.when(p2.isNull(), F.lit(0.0)).otherwise(F.aggregate(F.transform(at, deviation), F.lit(0.0), lambda s, x: s + x))


#: Fixed order of the detectors.
NAMES = ["hfc", "complex", "complexPhase", "flux", "rms"]


def matrix(rows: DataFrame, keys: list[str], order: str, mag: str, phase: str, frame: str, weights: list[float] | None = None) -> DataFrame:
    """(keys, order, five detector columns). A detector of weight 0 is a column of zeros and costs nothing."""
    made = [lambda: hfc(mag), lambda: complex_domain(mag, phase, keys, order), lambda: complex_phase(mag, phase, keys, order), lambda: flux(mag, keys, order), lambda: rms_rise(frame, keys, order)]
    return rows.select(*keys, order, *[(f() if w > 0 else F.lit(0.0)).alias(n) for n, f, w in zip(NAMES, made, weights or [1.0] * 5, strict=True)])


def combine(rows: DataFrame, keys: list[str], columns: list[str], weights: list[float]) -> DataFrame:
    """Adds strength: detectors scaled to a maximum of 1 per signal, weighted; those of weight 0 are left
    out of the plan."""
    if not sum(weights) > 0:
        raise ValueError("the detectors' weights are all zero")
    used = [(c, k) for c, k in zip(columns, weights, strict=True) if k > 0]
    top = rows.groupBy(*keys).agg(*[F.max(c).alias(f"_top{i}") for i, (c, _) in enumerate(used)])
    parts = [F.coalesce(F.try_divide(F.col(c), F.col(f"_top{i}")), F.lit(0.0)) * F.lit(float(k)) for i, (c, k) in enumerate(used)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.join(top, keys).select(*rows.columns, (total / F.lit(float(sum(weights)))).alias("strength"))


def peak_pick(rows: DataFrame, keys: list[str], order: str, x: str, alpha: float = 0.1, delay: int = 5, silence: float = 0.1, rate: float = 44100.0 / 512) -> DataFrame:
    """(keys, order, x, onset_s): values above the moving median plus alpha times the moving mean of the
    last `delay` frames and this one, above their neighbours and the silence threshold."""
    part, by = ", ".join(keys) or "1", order
    frame = f"over (partition by {part} order by {by} rows between {int(delay)} preceding and current row)"
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(x)
    out = rows.select(*keys, order, x, F.expr(f"percentile({x}, 0.5) {frame} + {float(alpha)}D * avg({x}) {frame}").alias("_t"), F.lag(x, 1).over(w).alias("_a"), F.lead(x, 1).over(w).alias("_b"))
    peak = (v > F.coalesce("_a", F.lit(float("-inf")))) & (v >= F.coalesce("_b", F.lit(float("-inf")))) & (v > F.col("_t")) & (v > F.lit(float(silence)))
    return out.where(peak).select(*keys, order, x, (F.col(order) / F.lit(float(rate))).alias("onset_s"))
