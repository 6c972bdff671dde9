"""Frames, tapers and spectra: built-in array functions, and Arrow kernels for the transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.windows import taper


def n_frames(n, size: int, hop: int) -> Column:
    return F.lit(1) + F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(hop)))).cast("int")


def frames(signals: DataFrame, keys: list[str], samples: str, size: int, hop: int) -> DataFrame:
    """(keys, frame_idx, frame): cut from sample 0 to the end, the last frames padded with zeros."""
    n = F.size(samples)
    padded = F.concat(F.col(samples).cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    cut = F.transform(F.sequence(F.lit(0), n_frames(n, size, hop) - 1), lambda i: F.slice(padded, i * hop + 1, size))
    return signals.where(n > 0).select(*keys, F.posexplode(cut).alias("frame_idx", "frame"))


def onset_frames(signals: DataFrame, keys: list[str], samples: str, size: int, hop: int = 512) -> DataFrame:
    """(keys, frame_idx, frame) as detectors take them: 512 to 2048 samples, the first frame centred on
    sample 0."""
    n = min(max(size, 512), 2048)
    centred = signals.select(*keys, F.concat(F.array_repeat(F.lit(0.0), n // 2), F.col(samples).cast("array<double>")).alias(samples))
    return frames(centred, keys, samples, n, hop)


def weighted(frame: str, kind: str, size: int, pad: bool = False, normalized: bool = False) -> Column:
    w = F.array(*[F.lit(float(x)) for x in taper(kind, size, normalized)])
    out = F.zip_with(F.col(frame), w, lambda x, y: x * y)
    return F.concat(out, F.array_repeat(F.lit(0.0), size)) if pad else out


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def arrays(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, np.float64)
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32)[: len(m) + 1], pa.array(m.ravel()))


def map_frames(rows: DataFrame, keys: list[str], frame: str, made: dict[str, str], kernel: Callable[[np.ndarray], dict[str, np.ndarray]], step: int = 4096) -> DataFrame:
    """(keys, made): a kernel over matrices of frames of one length, in Arrow batches. Rows of other
    lengths than their batch's first are handled by length."""
    src = rows.select(*keys, frame)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"`{k}` {t}" for k, t in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(len(keys)).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[~np.isnan(sizes)] if sizes.dtype.kind == "f" else sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                for at in range(0, part.num_rows, step):
                    p = part.slice(at, step)
                    out = kernel(matrix(p.column(len(keys))))
                    cols = [out[k] for k in made]
                    yield pa.RecordBatch.from_arrays([*p.columns[: len(keys)], *[arrays(c) if c.ndim == 2 else pa.array(c) for c in cols]], [*keys, *made])

    return src.mapInArrow(run, schema)


def spectra(rows: DataFrame, keys: list[str], frame: str, kind: str = "power") -> DataFrame:
    return map_frames(rows, keys, frame, {"spectrum": "array<double>"}, lambda m: {"spectrum": K.spectrum(m, kind)})


def polar_spectra(rows: DataFrame, keys: list[str], frame: str) -> DataFrame:
    def kernel(m):
        mag, phase = K.polar(m)
        return {"mag": mag, "phase": phase}

    return map_frames(rows, keys, frame, {"mag": "array<double>", "phase": "array<double>"}, kernel)


def relational_power(rows: DataFrame, keys: list[str], frame: str, n: int) -> DataFrame:
    """(keys, bin, power) by sums over sine and cosine tables: the built-in form of the transform."""
    x = rows.select(*keys, F.posexplode(frame).alias("i", "v"), F.expr(f"sequence(0, {n // 2})").alias("b"))
    x = x.select(*keys, "i", "v", F.explode("b").alias("bin"))
    angle = F.lit(2 * np.pi / n) * ((F.col("i") * F.col("bin")) % n)
    part = lambda f: F.pow(F.sum(F.col("v") * f(angle)), F.lit(2.0))
    return x.groupBy(*keys, "bin").agg((part(F.cos) + part(F.sin)).alias("power"))
