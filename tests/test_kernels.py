"""Kernels on synthetic signals, and against the built-in forms."""

import numpy as np
import pytest

from sigmill.functions import kernels as K
from sigmill.functions.windows import BLACKMAN_HARRIS, taper
from sigmill.operators import framing, spectral
from sigmill.settings import WINDOWS

RATE = 44100.0


def sine(f, n=44100):
    return np.sin(2 * np.pi * f * np.arange(n) / RATE)


@pytest.mark.parametrize("kind", WINDOWS)
def test_tapers_are_symmetric(kind):
    w = taper(kind, 64)
    assert w.max() <= 1.0001 and w.min() > -1e-3
    if kind != "hannnsgcq":
        assert np.allclose(w, w[::-1])
    assert taper(kind, 64, normalized=True).sum() == pytest.approx(2)
    assert set(BLACKMAN_HARRIS) < set(WINDOWS)


def test_unknown_taper():
    with pytest.raises(ValueError):
        taper("kaiser", 8)


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 1), (16, 1), (17, 2), (24, 2), (25, 3)])
def test_frame_count(n, count):
    f = K.frame_cut(np.ones(n), 16, 8)
    assert len(f) == count and (not count or f.sum() >= n)


def test_centred_frames():
    assert K.frame_cut(np.arange(1.0, 9), 4, 4, from_zero=False).tolist() == [[0, 0, 1, 2], [3, 4, 5, 6], [7, 8, 0, 0]]


def test_yin_and_midi():
    f = K.frame_cut(sine(440.0), 2048, 1024)[:-1]
    hz, sure = K.yin(f, RATE)
    assert np.allclose(K.hz_to_midi(hz), 69, atol=0.05) and (sure > 0.9).all()
    hz, _ = K.yin(np.zeros((1, 2048)), RATE)
    assert hz[0] == 0 and K.hz_to_midi(hz)[0] == 0


def test_centroid_rises_with_a_chirp():
    x = K.chirp(100, 4000, 44100)
    c = K.centroid(K.spectrum(K.tapered(K.frame_cut(x, 1024, 1024)[:-1], "hann")), RATE / 2)
    rank = np.argsort(np.argsort(c))
    assert np.corrcoef(rank, np.arange(len(c)))[0, 1] > 0.95


def test_impulse_is_flat():
    x = np.zeros((1, 1024))
    x[0, 512] = 1
    s = K.spectrum(x)
    assert K.crest(s)[0] == pytest.approx(1) and K.flatness(s)[0] == pytest.approx(0, abs=1e-9) and K.decrease(s, RATE / 2)[0] == pytest.approx(0, abs=1e-12)
    assert np.isnan(K.centroid(np.zeros((1, 9)), 1.0)[0]) and np.isnan(K.flatness(np.zeros((1, 9)))[0])


def test_filterbank_and_dct():
    b = K.bark_filterbank(1025, RATE)
    assert b.shape == (40, 1025) and np.allclose(b.sum(axis=1), 1)
    assert np.allclose(K.bark_filterbank(1025, RATE, normalize="unit_max").max(axis=1), 1)
    assert not np.allclose(b, K.bark_filterbank(1025, RATE, weighting="linear"))
    for kind in ("typeII", "typeIII"):
        m = K.dct_matrix(40, 40, kind)
        assert np.allclose(m @ m.T, np.eye(40))
    assert np.allclose(K.hz_to_bark(K.bark_to_hz(7.5)), 7.5)
    assert K.lifter(13, 0).tolist() == [1.0] * 13 and K.lifter(13, 22)[0] == 1


def test_resample_keeps_a_tone():
    x = np.sin(2 * np.pi * 500 * np.arange(4000) / 22050)
    y = K.resample(x, 22050.0)
    assert len(y) == 8000
    want = np.sin(2 * np.pi * 500 * np.arange(8000) / 44100)
    assert np.abs(y - want)[200:-200].max() < 0.01
    assert K.resample(x, 44100.0) is not None and (K.resample(x, 44100.0) == x).all()


@pytest.mark.parametrize("rate", [44100.0, 48000.0, 96000.0])
def test_equal_loudness_follows_the_published_curve(rate):
    """Gains of the published design, read from its transfer function: -35.4 dB at 30 Hz, -6.0 at 2 kHz,
    -0.7 at 3.5 kHz, -15.7 at 8 kHz."""
    n = int(rate)
    level = lambda x: 20 * np.log10(np.sqrt(2 * np.mean(x[n // 2 : -2000] ** 2)))
    gain = lambda f: level(K.equal_loudness(np.sin(2 * np.pi * f * np.arange(n) / rate), rate))
    for f, want in ((30.0, -35.4), (2000.0, -6.0), (3500.0, -0.7), (8000.0, -15.7)):
        assert gain(f) == pytest.approx(want, abs=0.4)


@pytest.mark.parametrize("n", [0, 1, 5, 256, 257, 1000])
def test_recursive_filter_against_the_sum(n):
    x = np.random.default_rng(n).normal(size=n)
    b, a = K.EQUAL_LOUDNESS[44100][:2]
    y = np.zeros(n)
    for i in range(n):
        y[i] = sum(b[k] * x[i - k] for k in range(min(i + 1, len(b)))) - sum(a[k] * y[i - k] for k in range(1, min(i + 1, len(a))))
    assert np.allclose(K.recursive_filter(b, a, x), y, atol=1e-12)


def test_bic_keeps_to_its_steps():
    """Without a second search (size2 too short for one), changes lie at the first search's places."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(9, 1, (150, 2))])
    for step in (1, 20, 60):
        found = K.bic_segments(x, inc1=step, size2=10)
        assert found and all((k - i - 10) % step == 0 for i, k in zip([0, *found], found))
    assert 150 in K.bic_segments(x, inc1=20, inc2=1)


def test_bic_finds_a_change():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(6, 1, (150, 3))])
    found = K.bic_segments(x)
    assert any(abs(k - 150) <= 5 for k in found)
    assert K.bic_segments(rng.normal(0, 1, (15, 3))) == []


def test_strong_peak_and_complexity():
    x = np.array([[0, 0.1, 0.6, 1.0, 0.6, 0.1, 0.02, 0.001, 0.003, 0.001]])
    assert K.strong_peak(x)[0] == pytest.approx(1 / np.log10(6 / 3)) and K.complexity(x)[0] == 1
    assert K.strong_peak(np.zeros((1, 5)))[0] == 0


def test_arrow_and_builtin_forms_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(20)] + [(90, [0.0] * 64), (91, rng.normal(size=16).tolist())]
    df = spark.createDataFrame(rows, "id long, frame array<double>")
    s = framing.spectra(df, ["id"], "frame").cache()
    rel = {(r["id"], r["bin"]): r["power"] for r in framing.relational_power(df.where("id < 91"), ["id"], "frame", 64).collect()}
    for r in s.where("id < 91").collect():
        assert np.allclose(r["spectrum"], [rel[r["id"], k] for k in range(33)], atol=1e-9)
    out = s.select("id", "spectrum", spectral.centroid("spectrum", 100.0).alias("a"), spectral.decrease("spectrum", 100.0).alias("b"), spectral.flatness("spectrum").alias("c"), spectral.crest("spectrum").alias("d"), spectral.complexity("spectrum").alias("e"))
    for r in out.collect():
        x = np.array([r["spectrum"]])
        for k, f in (("a", lambda v: K.centroid(v, 100.0)), ("b", lambda v: K.decrease(v, 100.0)), ("c", K.flatness), ("d", K.crest), ("e", K.complexity)):
            want = f(x)[0]
            assert (r[k] is None and np.isnan(want)) or r[k] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_other_pitch_algorithms_are_an_error(spark):
    from sigmill.settings import Settings

    df = spark.createDataFrame([(1, [0.0] * 64)], "id long, frame array<double>")
    with pytest.raises(NotImplementedError):
        spectral.pitches(df, ["id"], "frame", RATE, Settings().with_(Pitch={"pitchDetectionAlgorithm": "pYin"}))
