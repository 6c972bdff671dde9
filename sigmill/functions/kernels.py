"""Spectral, cepstral, pitch and change-point kernels over frames (rows of a matrix)."""

from __future__ import annotations

import numpy as np

from .windows import taper


def frame_cut(x: np.ndarray, size: int, hop: int, from_zero: bool = True) -> np.ndarray:
    """Frames to the end of the wave, the last ones padded with zeros. from_zero: the first frame starts
    at sample 0; else it is centred there."""
    if not len(x):
        return np.zeros((0, size))
    if not from_zero:
        x = np.concatenate([np.zeros(size // 2), x])
    n = 1 + max(0, -(-(len(x) - size) // hop))
    padded = np.zeros((n - 1) * hop + size)
    padded[: len(x)] = x[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]


def tapered(frames: np.ndarray, kind: str, pad: bool = True, normalized: bool = False) -> np.ndarray:
    """Weighted frames, padded with as many zeros behind."""
    out = frames * taper(kind, frames.shape[1], normalized)
    return np.concatenate([out, np.zeros_like(out)], axis=1) if pad else out


def spectrum(frames: np.ndarray, kind: str = "power") -> np.ndarray:
    z = np.abs(np.fft.rfft(frames, axis=1))
    return z * z if kind == "power" else z


def polar(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.fft.rfft(frames, axis=1)
    return np.abs(z), np.angle(z)


def hz_to_bark(f):
    """Traunmueller 1990."""
    f = np.asarray(f, float)
    return 26.81 * f / (1960 + f) - 0.53


def bark_to_hz(z):
    z = np.asarray(z, float)
    return 1960 * (z + 0.53) / (26.28 - z)


def bark_filterbank(bins: int, sample_rate: float, bands: int = 40, low: float = 500.0, high: float = 4000.0, normalize: str = "unit_sum", weighting: str = "warping") -> np.ndarray:
    """bands x bins triangles whose edges are evenly spaced in Bark. weighting: the sides are straight in
    Bark (warping) or in Hz (linear)."""
    e = np.linspace(hz_to_bark(low), hz_to_bark(high), bands + 2)
    g = np.arange(bins) * (sample_rate / 2) / max(bins - 1, 1)
    g, e = (hz_to_bark(g), e) if weighting == "warping" else (g, bark_to_hz(e))
    up = (g[None, :] - e[:-2, None]) / (e[1:-1] - e[:-2])[:, None]
    down = (e[2:, None] - g[None, :]) / (e[2:] - e[1:-1])[:, None]
    w = np.clip(np.minimum(up, down), 0, None)
    scale = w.sum(axis=1) if normalize == "unit_sum" else w.max(axis=1)
    return w / np.where(scale > 0, scale, 1)[:, None]


def dct_matrix(n: int, k: int, kind: str = "typeII") -> np.ndarray:
    """k x n, orthonormal."""
    i = np.arange(n)
    if kind == "typeII":
        m = np.cos(np.pi / n * (i[None, :] + 0.5) * np.arange(k)[:, None]) * np.sqrt(2 / n)
        m[0] *= np.sqrt(0.5)
    else:
        m = np.cos(np.pi / n * i[None, :] * (np.arange(k)[:, None] + 0.5)) * np.sqrt(2 / n)
        m[:, 0] *= np.sqrt(0.5)
    return m


def lifter(k: int, n: int) -> np.ndarray:
    return 1 + n / 2 * np.sin(np.pi * np.arange(k) / n) if n else np.ones(k)


#: Below this the logarithm's argument is cut off (-100 dB).
FLOOR = 1e-10


def decibels(x: np.ndarray, spectrum_type: str = "power") -> np.ndarray:
    return (10 if spectrum_type == "power" else 20) * np.log10(np.maximum(x, FLOOR))


def bfcc(spec: np.ndarray, sample_rate: float, coefficients: int = 13, liftering: int = 0, dct: str = "typeII", spectrum_type: str = "power", **bank) -> np.ndarray:
    bands = spec @ bark_filterbank(spec.shape[1], sample_rate, **bank).T
    return decibels(bands, spectrum_type) @ dct_matrix(bands.shape[1], coefficients, dct).T * lifter(coefficients, liftering)


def _ratio(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / np.where(b != 0, b, 1), np.nan)


def centroid(x: np.ndarray, top: float) -> np.ndarray:
    f = np.arange(x.shape[1]) * top / max(x.shape[1] - 1, 1)
    return _ratio((x * f).sum(axis=1), x.sum(axis=1))


def decrease(x: np.ndarray, top: float) -> np.ndarray:
    """Slope of the regression over frequency."""
    f = np.arange(x.shape[1]) * top / max(x.shape[1] - 1, 1)
    c = f - f.mean()
    return (x * c).sum(axis=1) / (c * c).sum()


def flatness(x: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean in dB, over -60 dB, within [0, 1]; any zero: 1 (fully tonal)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.exp(np.log(x).mean(axis=1)) / x.mean(axis=1)
        db = np.where(ratio > 0, 10 * np.log10(ratio), -np.inf)
    return np.where(x.mean(axis=1) > 0, np.clip(db / -60, 0, 1), np.nan)


def crest(x: np.ndarray) -> np.ndarray:
    return _ratio(x.max(axis=1), x.mean(axis=1))


def complexity(x: np.ndarray, threshold: float = 0.005) -> np.ndarray:
    mid = x[:, 1:-1]
    return ((mid > x[:, :-2]) & (mid >= x[:, 2:]) & (mid > threshold)).sum(axis=1).astype(float)


def strong_peak(x: np.ndarray) -> np.ndarray:
    """The largest value over the logarithm (base 10) of its width at half height, in bins; 0 for an
    empty spectrum. Width: last over first bin around it that reach half of it, counted from 1."""
    out = np.zeros(len(x))
    for i, row in enumerate(x):
        k = int(row.argmax())
        if row[k] <= 0:
            continue
        a = b = k
        while a > 0 and row[a - 1] >= row[k] / 2:
            a -= 1
        while b < len(row) - 1 and row[b + 1] >= row[k] / 2:
            b += 1
        out[i] = row[k] / np.log10((b + 2) / (a + 1))
    return out


def loudness(frames: np.ndarray) -> np.ndarray:
    return (frames * frames).sum(axis=1) ** 0.67


def yin(frames: np.ndarray, sample_rate: float, low: float = 100.0, high: float = 3000.0, tolerance: float = 0.15, interpolate: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fundamental frequency (0: none) and confidence per frame (de Cheveigne and Kawahara 2002)."""
    n = frames.shape[1]
    lo, hi = max(2, int(sample_rate / high)), min(n // 2, int(np.ceil(sample_rate / low)) + 1)
    pitch, sure = np.zeros(len(frames)), np.zeros(len(frames))
    if hi <= lo + 1:
        return pitch, sure
    half = n // 2
    for i, x in enumerate(frames):
        z = np.fft.rfft(x[:half], 2 * n)
        corr = np.fft.irfft(np.fft.rfft(x, 2 * n) * np.conj(z), 2 * n)[: hi + 1]
        cum = np.concatenate([[0], np.cumsum(x * x)])
        lags = np.arange(hi + 1)
        d = cum[half] + cum[half + lags] - cum[lags] - 2 * corr
        total = np.cumsum(d[1:])
        if total[-1] <= 1e-12:
            continue
        norm = np.ones(hi + 1)
        norm[1:] = d[1:] * lags[1:] / np.maximum(total, 1e-12)
        below = np.flatnonzero(norm[lo:hi] < tolerance)
        k = int(below[0]) + lo if len(below) else int(norm[lo:hi].argmin()) + lo
        while k + 1 < hi and norm[k + 1] < norm[k]:
            k += 1
        at = float(k)
        if interpolate and 0 < k < hi:
            a, b, c = norm[k - 1], norm[k], norm[k + 1]
            if a - 2 * b + c > 0:
                at += 0.5 * (a - c) / (a - 2 * b + c)
        if norm[k] < 1:
            pitch[i], sure[i] = sample_rate / at, max(0.0, 1 - norm[k])
    return pitch, sure


def hz_to_midi(f):
    f = np.asarray(f, float)
    return np.where(f > 0, 69 + 12 * np.log2(np.where(f > 0, f, 440) / 440), 0.0)


def resample(x: np.ndarray, rate: float, target: float = 44100.0, half: int = 16) -> np.ndarray:
    """Band-limited interpolation with a windowed sinc (Smith and Gossett 1984)."""
    if rate == target or not len(x):
        return np.asarray(x, float)
    n = int(round(len(x) * target / rate))
    cut = min(1.0, target / rate)
    reach = int(np.ceil(half / cut))
    t = np.arange(n) * rate / target
    base = np.floor(t).astype(int)
    out = np.zeros(n)
    for k in range(-reach + 1, reach + 1):
        i = base + k
        d = t - i
        w = cut * np.sinc(cut * d) * np.where(np.abs(d) < reach, 0.5 + 0.5 * np.cos(np.pi * d / reach), 0)
        ok = (i >= 0) & (i < len(x))
        out[ok] += x[i[ok]] * w[ok]
    return out


#: The published equal-loudness design (Robinson 2001) by sample rate: b and a of the
#: tenth-order filter, then b and a of the high-pass of second order behind it.
EQUAL_LOUDNESS = {
    44100: (
        (0.05418656406430, -0.02911007808948, -0.00848709379851, -0.00851165645469, -0.00834990904936, 0.02245293253339, -0.02596338512915, 0.01624864962975, -0.00240879051584, 0.00674613682247, -0.00187763777362),
        (1.0, -3.47845948550071, 6.36317777566148, -8.54751527471874, 9.47693607801280, -8.81498681370155, 6.85401540936998, -4.39470996079559, 2.19611684890774, -0.75104302451432, 0.13149317958808),
        (0.98500175787242, -1.97000351574484, 0.98500175787242),
        (1.0, -1.96977855582618, 0.97022847566350),
    ),
    48000: (
        (0.03857599435200, -0.02160367184185, -0.00123395316851, -0.00009291677959, -0.01655260341619, 0.02161526843274, -0.02074045215285, 0.00594298065125, 0.00306428023191, 0.00012025322027, 0.00288463683916),
        (1.0, -3.84664617118067, 7.81501653005538, -11.34170355132042, 13.05504219327545, -12.28759895145294, 9.48293806319790, -5.87257861775999, 2.75465861874613, -0.86984376593551, 0.13919314567432),
        (0.98621192462708, -1.97242384925416, 0.98621192462708),
        (1.0, -1.97223372919527, 0.97261396931306),
    ),
}


def recursive_filter(b, a, x: np.ndarray, block: int = 256) -> np.ndarray:
    """y[n] = sum of b[k] x[n - k] less the sum of a[k] y[n - k] from k = 1 on; a[0] is 1. Within a block
    by the impulse response of 1 / a, for all blocks at once; only the last outputs go from block to block."""
    x, a = np.asarray(x, float), np.asarray(a, float)
    n, p = len(x), len(a) - 1
    if not n:
        return x
    size = max(min(block, n), p)
    h = np.zeros(size)
    for i in range(size):
        h[i] = (i == 0) - a[1 : min(i, p) + 1] @ h[max(i - p, 0) : i][::-1]
    lag = np.arange(size)[:, None] - np.arange(size)[None, :]
    response = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)
    past = np.array([[-a[m + 1 + j] if m + 1 + j <= p else 0.0 for j in range(p)] for m in range(p)])
    free = response[:, :p] @ past  # of the outputs before, the last one first
    u = np.zeros(-(-n // size) * size)
    u[:n] = np.convolve(x, b)[:n]
    y = u.reshape(-1, size) @ response.T
    state = np.zeros(p)
    for row in y:
        row += free @ state
        state = row[: -p - 1 : -1]
    return y.ravel()[:n]


def equal_loudness(x: np.ndarray, rate: float = 44100.0) -> np.ndarray:
    """The inverse of the equal-loudness contour: two filters in series, from rest. Waves of other rates
    than those of the published tables are filtered at 44.1 kHz and brought back."""
    if rate not in EQUAL_LOUDNESS:
        x = np.asarray(x, float)
        y = resample(equal_loudness(resample(x, rate, 44100.0)), 44100.0, rate)
        return np.concatenate([y, np.zeros(max(0, len(x) - len(y)))])[: len(x)]
    b, a, b2, a2 = EQUAL_LOUDNESS[rate]
    return recursive_filter(b2, a2, recursive_filter(b, a, x))


def bic_segments(features: np.ndarray, cpw: float = 1.5, size1: int = 300, inc1: int = 60, size2: int = 200, inc2: int = 20, min_length: int = 10) -> list[int]:
    """Change points of rows of features, by the Bayesian information criterion (Chen and Gopalakrishnan
    1998): windows of size1 are tried at every inc1-th place, a change is then tried again in size2 around
    it at every inc2-th; a window without one grows by inc1."""
    x = np.asarray(features, float)
    n, d = x.shape

    def logdet(a: np.ndarray) -> float:
        c = np.atleast_2d(np.cov(a, rowvar=False, bias=True)) + 1e-9 * np.eye(d)
        return float(np.linalg.slogdet(c)[1])

    def best(i: int, j: int, step: int) -> tuple[float, int]:
        penalty = 0.5 * cpw * (d + 0.5 * d * (d + 1)) * np.log(j - i)
        whole, top = (j - i) * logdet(x[i:j]), (0.0, -1)
        for k in range(i + min_length, j - min_length + 1, step):
            gain = 0.5 * (whole - (k - i) * logdet(x[i:k]) - (j - k) * logdet(x[k:j])) - penalty
            if gain > top[0]:
                top = (gain, k)
        return top

    out, i = [], 0
    j = min(n, size1)
    while j - i >= 2 * min_length:
        _, k = best(i, j, max(1, inc1))
        if k >= 0:
            a, b = max(i, k - size2 // 2), min(n, k + size2 // 2)
            if b - a >= 2 * min_length:
                _, fine = best(a, b, max(1, inc2))
                k = fine if fine > i else k
            out.append(k)
            i, j = k, min(n, k + size1)
        elif j == n:
            break
        else:
            j = min(n, j + inc1)
    return out


def swept_sine(low: float, high: float, n: int, rate: float = 44100.0) -> np.ndarray:
    """sin(2 pi f i-th / rate) with f linear in i; the phase isn't integrated, so this is no true chirp."""
    f = low + (high - low) * np.arange(n) / max(n - 1, 1)
    return np.sin(2 * np.pi * f * np.arange(n) / rate)


def chirp(low: float, high: float, n: int, rate: float = 44100.0) -> np.ndarray:
    f = low + (high - low) * np.arange(n) / max(n - 1, 1)
    return np.sin(2 * np.pi * np.cumsum(f) / rate)
