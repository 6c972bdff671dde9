"""Analysis settings: one frozen dataclass per branch, checked as a whole."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


def ranged(default, low, high, unit: str = "", power_of_two: bool = False):
    return field(default=default, metadata={"low": low, "high": high, "unit": unit, "power_of_two": power_of_two})


def choice(default: str, *options: str):
    return field(default=default, metadata={"options": options})


#: Names, defaults and ranges of the settings.
WINDOWS = ("hann", "hamming", "hannnsgcq", "triangular", "square", "blackmanharris62", "blackmanharris70", "blackmanharris74", "blackmanharris92")


@dataclass(frozen=True)
class Analysis:
    frameSize: int = ranged(1024, 64, 8192, "samples", True)
    hopSize: int = ranged(1024, 32, 4096, "samples", True)
    windowingType: str = choice("hann", *WINDOWS)
    numThreads: int = ranged(2, 1, 1 << 16)


@dataclass(frozen=True)
class BFCC:
    highFrequencyBound: float = ranged(4000.0, 20.0, 24000.0, "Hz")
    lowFrequencyBound: float = ranged(500.0, 0.0, 5000.0, "Hz")
    liftering: int = ranged(0, 0, 100)
    numBands: int = ranged(40, 1, 128)
    numCoefficients: int = ranged(13, 5, 26)
    normalize: str = choice("unit_sum", "unit_sum", "unit_max")
    BFCC0_frameNormalizationFactor: float = ranged(0.05, 0.0, 1.0)
    BFCC0_eventNormalize: bool = True
    spectrumType: str = choice("power", "power", "magnitude")
    weightingType: str = choice("warping", "warping", "linear")
    dctType: str = choice("typeII", "typeII", "typeIII")


@dataclass(frozen=True)
class Onset:
    segmentation: str = choice("Uniform", "Event", "Uniform")
    silenceThreshold: float = ranged(0.1, 0.0, 1.0)
    alpha: float = ranged(0.1, 0.0, 1.0)
    numFrames_shortOnsetFilter: int = ranged(5, 1, 64)
    weight_hfc: float = ranged(0.5, 0.0, 1.0)
    weight_complex: float = ranged(0.5, 0.0, 1.0)
    weight_complexPhase: float = ranged(0.5, 0.0, 1.0)
    weight_flux: float = ranged(0.5, 0.0, 1.0)
    weight_rms: float = ranged(0.5, 0.0, 1.0)

    def weights(self) -> list[float]:
        """Of the detectors hfc, complex, complexPhase, flux, rms; not all zero."""
        w = [self.weight_hfc, self.weight_complex, self.weight_complexPhase, self.weight_flux, self.weight_rms]
        if not sum(w) > 0:
            raise ValueError("the detectors' weights are all zero")
        return w


@dataclass(frozen=True)
class SBic:
    cpw: float = ranged(1.5, 0.0, 100.0)
    inc1: int = ranged(60, 1, 1 << 20)
    inc2: int = ranged(20, 1, 1 << 20)
    minLength: int = ranged(10, 1, 1 << 20)
    size1: int = ranged(300, 1, 1 << 20)
    size2: int = ranged(200, 1, 1 << 20)


@dataclass(frozen=True)
class Pitch:
    pitchDetectionAlgorithm: str = choice("yin", "yin", "pYin", "chroma")
    interpolate: bool = True
    maxFrequency: float = ranged(3000.0, 20.0, 24000.0, "Hz")
    minFrequency: float = ranged(100.0, 1.0, 24000.0, "Hz")
    tolerance: float = ranged(0.15, 0.0, 1.0)


@dataclass(frozen=True)
class Loudness:
    equalizeLoudness: bool = True


@dataclass(frozen=True)
class Split:
    fadeInSamps: int = ranged(5, 0, 10000, "samples")
    fadeOutSamps: int = ranged(5, 0, 10000, "samples")


@dataclass(frozen=True)
class Complexity:
    magnitudeThreshold: float = ranged(0.005, 0.0, 1e9)


@dataclass(frozen=True)
class Info:
    sampleRate: float = ranged(44100.0, 8000.0, 1e6, "Hz")
    author: str = ""


@dataclass(frozen=True)
class Settings:
    Analysis: Analysis = field(default_factory=Analysis)
    BFCC: BFCC = field(default_factory=BFCC)
    Onset: Onset = field(default_factory=Onset)
    sBic: SBic = field(default_factory=SBic)
    Pitch: Pitch = field(default_factory=Pitch)
    Loudness: Loudness = field(default_factory=Loudness)
    Split: Split = field(default_factory=Split)
    SpectralComplexity: Complexity = field(default_factory=Complexity)
    info: Info = field(default_factory=Info)

    def __post_init__(self):
        self.check()

    def check(self) -> None:
        """Raises ValueError with all that is out of range."""
        wrong = []
        for branch in fields(self):
            b = getattr(self, branch.name)
            for f in fields(b):
                v, m = getattr(b, f.name), f.metadata
                if "options" in m and v not in m["options"]:
                    wrong.append(f"{branch.name}.{f.name}: {v!r} is none of {m['options']}")
                if "low" in m and not (isinstance(v, (int, float)) and m["low"] <= v <= m["high"]):
                    wrong.append(f"{branch.name}.{f.name}: {v!r} is not in {m['low']} to {m['high']}")
                elif m.get("power_of_two") and (int(v) != v or int(v) & (int(v) - 1)):
                    wrong.append(f"{branch.name}.{f.name}: {v!r} is no power of two")
        if wrong:
            raise ValueError("; ".join(wrong))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    def hash(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    @classmethod
    def from_dict(cls, tree: dict[str, Any], fill: bool = False) -> Settings:
        """All or nothing: unknown names are an error, as are missing ones unless fill."""
        parts = {}
        for branch in fields(cls):
            kind = branch.default_factory
            given = tree.get(branch.name)
            if given is None and not fill:
                raise ValueError(f"missing branch {branch.name}")
            given = dict(given or {})
            names = {f.name for f in fields(kind)}
            if extra := set(given) - names:
                raise ValueError(f"unknown in {branch.name}: {sorted(extra)}")
            if not fill and (gone := names - set(given)):
                raise ValueError(f"missing in {branch.name}: {sorted(gone)}")
            parts[branch.name] = kind(**given)
        if extra := set(tree) - set(parts):
            raise ValueError(f"unknown branches: {sorted(extra)}")
        return cls(**parts)

    @classmethod
    def from_json(cls, text: str, fill: bool = False) -> Settings:
        return cls.from_dict(json.loads(text), fill)

    def with_(self, **branches: dict[str, Any]) -> Settings:
        """A copy with changed values: s.with_(Analysis={"hopSize": 512})."""
        return replace(self, **{b: replace(getattr(self, b), **v) for b, v in branches.items()})


def specification() -> list[tuple]:
    """(branch, name, default as text, low, high, whether a power of two) of each setting."""
    out = []
    for branch in fields(Settings):
        for f in fields(branch.default_factory):
            m = f.metadata
            out.append((branch.name, f.name, str(f.default), *(None if m.get(k) is None else float(m[k]) for k in ("low", "high")), bool(m.get("power_of_two"))))
    return out


def nearest_power_of_two(x: float, low: int, high: int) -> int:
    """The power of two nearest to x on a logarithmic scale, within the range."""
    import math

    return min(max(2 ** round(math.log2(max(x, 1))), low), high)
