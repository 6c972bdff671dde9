"""Taper functions of a frame (Harris 1978), as arrays of n weights."""

from __future__ import annotations

import numpy as np

#: Coefficients of the Blackman-Harris family, by side-lobe level in dB.
BLACKMAN_HARRIS = {
    "blackmanharris62": (0.44959, 0.49364, 0.05677),
    "blackmanharris70": (0.42323, 0.49755, 0.07922),
    "blackmanharris74": (0.40217, 0.49703, 0.09892, 0.00188),
    "blackmanharris92": (0.35875, 0.48829, 0.14128, 0.01168),
}


def taper(kind: str, n: int, normalized: bool = False) -> np.ndarray:
    """normalized: scaled so that the weights sum to 2."""
    i = np.arange(n, dtype=np.float64)
    d = max(n - 1, 1)
    if kind == "hann":
        w = 0.5 - 0.5 * np.cos(2 * np.pi * i / d)
    elif kind == "hamming":
        w = 0.53836 - 0.46164 * np.cos(2 * np.pi * i / d)
    elif kind == "hannnsgcq":
        w = 0.5 - 0.5 * np.cos(2 * np.pi * i / n)
    elif kind == "triangular":
        w = 2 / n * (n / 2 - np.abs(i - (n - 1) / 2))
    elif kind == "square":
        w = np.ones(n)
    elif kind in BLACKMAN_HARRIS:
        w = sum((-1) ** k * a * np.cos(2 * np.pi * k * i / d) for k, a in enumerate(BLACKMAN_HARRIS[kind]))
    else:
        raise ValueError(f"unknown window {kind!r}")
    return w * (2 / w.sum()) if normalized else w
