"""Frame descriptors of spectra, as one Arrow kernel or as built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..schema import CEPSTRAL
from ..settings import Settings
from .framing import map_frames


def _sum(a: str, f: str = "x") -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + {f})"


def centroid(x: str, top: float) -> Column:
    scaled = f"aggregate(transform({x}, (v, i) -> v * i), 0D, (s, v) -> s + v)"
    return F.expr(f"try_divide({scaled} * {float(top)}D / (size({x}) - 1), {_sum(x)})")


def decrease(x: str, top: float) -> Column:
    """Regression slope over frequency: sum of x times the centred axis over the axis's square sum."""
    n = f"size({x})"
    step = f"({float(top)}D / ({n} - 1))"
    num = f"aggregate(transform({x}, (v, i) -> v * (i - ({n} - 1) / 2D)), 0D, (s, v) -> s + v)"
    return F.expr(f"try_divide({num}, {step} * {n} * (cast({n} as double) * {n} - 1) / 12D)")


def crest(x: str) -> Column:
    return F.expr(f"try_divide(array_max({x}) * size({x}), {_sum(x)})")


def flatness(x: str) -> Column:
    mean = f"({_sum(x)} / size({x}))"
    geo = f"exp({_sum(x, 'ln(x)')} / size({x}))"
    return F.expr(f"case when {mean} <= 0 then null when array_min({x}) <= 0 then 1D else greatest(0D, least(1D, log10({geo} / {mean}) / -6D)) end")


def complexity(x: str, threshold: float = 0.005) -> Column:
    return F.expr(f"case when size({x}) < 3 then 0 else size(filter(sequence(1, size({x}) - 2), i -> {x}[i] > {x}[i - 1] and {x}[i] >= {x}[i + 1] and {x}[i] > {float(threshold)}D)) end").cast("double")


def loudness(x: str) -> Column:
    return F.pow(F.expr(_sum(x, "x * x")), F.lit(0.67))


def hz_to_midi(f: str) -> Column:
    return F.when(F.col(f) <= 0, F.lit(0.0)).otherwise(F.lit(69.0) + F.lit(12.0) * F.log2(F.col(f) / F.lit(440.0)))


def pitches(rows: DataFrame, keys: list[str], frame: str, rate: float, settings: Settings | None = None) -> DataFrame:
    """(keys, hz, confidence) per frame; hz is 0 where there is none."""
    p = (settings or Settings()).Pitch
    if p.pitchDetectionAlgorithm != "yin":
        raise NotImplementedError(f"pitch algorithm {p.pitchDetectionAlgorithm}")

    def kernel(m):
        hz, sure = K.yin(m, rate, p.minFrequency, p.maxFrequency, p.tolerance, p.interpolate)
        return {"hz": hz, "confidence": sure}

    return map_frames(rows, keys, frame, {"hz": "double", "confidence": "double"}, kernel)


def bark_bands(rows: DataFrame, keys: list[str], spectrum: str, rate: float, **bank) -> DataFrame:
    return map_frames(rows, keys, spectrum, {"bands": "array<double>"}, lambda m: {"bands": m @ K.bark_filterbank(m.shape[1], rate, **bank).T})


def bfcc(rows: DataFrame, keys: list[str], spectrum: str, rate: float, **options) -> DataFrame:
    return map_frames(rows, keys, spectrum, {"bfcc": "array<double>"}, lambda m: {"bfcc": K.bfcc(m, rate, **options)})


def timbre(rows: DataFrame, keys: list[str], frame: str, rate: float, settings: Settings | None = None) -> DataFrame:
    """(keys, 13 cepstral and 6 spectral columns) of raw frames: taper, transform and features at once."""
    s = settings or Settings()
    b = s.BFCC
    if b.numCoefficients != 13:
        raise ValueError("exactly 13 coefficients are stored")
    bank = {"bands": b.numBands, "low": b.lowFrequencyBound, "high": b.highFrequencyBound, "normalize": b.normalize, "weighting": b.weightingType}

    def kernel(m):
        x = K.spectrum(K.tapered(m, s.Analysis.windowingType), b.spectrumType)
        c = K.bfcc(x, rate, 13, b.liftering, b.dctType, b.spectrumType, **bank)
        out = {name: c[:, i] for i, name in enumerate(CEPSTRAL)}
        top = rate / 2
        out |= {"SpectralCentroid": K.centroid(x, top), "SpectralDecrease": K.decrease(x, top), "SpectralFlatness": K.flatness(x), "SpectralCrest": K.crest(x)}
        return out | {"SpectralComplexity": K.complexity(x, s.SpectralComplexity.magnitudeThreshold), "StrongPeak": K.strong_peak(x)}

    names = [*CEPSTRAL, "SpectralCentroid", "SpectralDecrease", "SpectralFlatness", "SpectralCrest", "SpectralComplexity", "StrongPeak"]
    return map_frames(rows, keys, frame, dict.fromkeys(names, "double"), kernel)
