"""Feature and statistic names, and the schemas of the engine's tables."""

from __future__ import annotations

#: The 22 features in result order, and the 5 statistics.
CEPSTRAL = [f"bfcc{i}" for i in range(13)]
SPECTRAL = ["SpectralCentroid", "SpectralDecrease", "SpectralFlatness", "SpectralCrest", "SpectralComplexity", "StrongPeak"]
FEATURES = [*CEPSTRAL, *SPECTRAL, "Periodicity", "Loudness", "f0"]
TIMBRAL = FEATURES[:18]
STATISTICS = ["mean", "median", "variance", "skewness", "kurtosis"]

SIGNALS = "signal_id string, path string, sample_rate double, bit_depth int, n_samples bigint, chunk_idx int, chunk_start bigint, samples array<float>"
ONSETS = "signal_id string, event_idx int, onset_s double, onset_norm double"
EVENTS = "signal_id string, event_idx int, start_s double, end_s double, samples array<float>"
FRAMES = "signal_id string, event_idx int, frame_idx int, frame array<float>"


def feature(name: str) -> int:
    """The ordinal of a feature name, in any letter case; unknown names are an error."""
    by = {f.lower(): i for i, f in enumerate(FEATURES)}
    try:
        return by[name.lower()]
    except KeyError:
        raise ValueError(f"unknown feature {name!r}") from None


def is_cepstral(name: str) -> bool:
    return feature(name) < len(CEPSTRAL)


def statistic(name: str) -> int:
    try:
        return STATISTICS.index(name.lower())
    except ValueError:
        raise ValueError(f"unknown statistic {name!r}") from None
