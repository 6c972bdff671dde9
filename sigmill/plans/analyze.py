"""Waves to event features: onsets, events, frames, descriptors, statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import detectors as D
from ..operators import conditioning, framing, onsets, segments, stats
from ..schema import FEATURES, TIMBRAL
from ..settings import Settings

KEYS = ["signal_id", "event_idx"]
HOP, RATE = 512, 44100.0


def find_onsets(waves: DataFrame, s: Settings, rate: float) -> DataFrame:
    """(signal_id, onset_s) of waves (signal_id, samples): a uniform grid, or the peaks of the weighted
    detectors."""
    length = F.size("samples") / F.lit(rate)
    if s.Onset.segmentation == "Uniform":
        return onsets.uniform_grid(waves.select("signal_id", length.alias("length")), ["signal_id"], "length").select("signal_id", "onset_s")
    w = s.Onset.weights()
    if rate != RATE:  # detectors work at one rate, times don't depend on it
        waves, rate = conditioning.resample(waves, ["signal_id"], "samples", rate, RATE), RATE
    f = framing.onset_frames(waves, ["signal_id"], "samples", s.Analysis.frameSize, HOP)

    def kernel(m):
        mag, phase = K.polar(K.tapered(m, "hamming", normalized=True))
        return {"mag": mag, "phase": phase, "frame": m}

    p = framing.map_frames(f, ["signal_id", "frame_idx"], "frame", {"mag": "array<double>", "phase": "array<double>", "frame": "array<double>"}, kernel)
    d = D.matrix(p, ["signal_id"], "frame_idx", "mag", "phase", "frame", w)
    d = D.combine(d, ["signal_id"], D.NAMES, w)
    return D.peak_pick(d, ["signal_id"], "frame_idx", "strength", s.Onset.alpha, s.Onset.numFrames_shortOnsetFilter, s.Onset.silenceThreshold, rate / HOP).select("signal_id", "onset_s")


def prepare(waves: DataFrame, s: Settings, rate: float) -> DataFrame:
    """(signal_id, event_idx, onset_s, onset_norm): tail filter, minimum gap, at least 4."""
    found = find_onsets(waves, s, rate)
    n = waves.select("signal_id", onsets.length_seconds(F.size("samples"), F.lit(rate)).alias("length"))
    found = found.join(n, "signal_id").where(F.col("onset_s") <= F.col("length") - onsets.MIN_GAP)
    kept = onsets.min_gap_stream(found, ["signal_id"], onsets.MIN_GAP).join(n, "signal_id")
    # Short lists are filled on the scale of the length.
    count = F.count("*").over(Window.partitionBy("signal_id"))
    kept = kept.withColumn("few", count < 4).withColumn("x", F.when(F.col("few"), F.col("onset_s") / F.col("length")).otherwise(F.col("onset_s")))
    out = onsets.min_count_fill(kept.select("signal_id", F.col("x").alias("onset_s")), ["signal_id"], 4, 1.0)
    few = kept.select("signal_id", "length", "few").distinct()
    out = out.join(few, "signal_id").withColumn("onset_s", F.when(F.col("few"), F.col("onset_s") * F.col("length")).otherwise(F.col("onset_s")))
    return out.select("signal_id", "event_idx", "onset_s", (F.col("onset_s") / F.col("length")).alias("onset_norm"))


def frame_features(events: DataFrame, s: Settings, rate: float) -> DataFrame:
    """(signal_id, event_idx, frame_idx, 22 columns): the three families read the same frames, so that one
    pass makes them all; equal loudness is filtered event by event, before framing."""
    a, p, b = s.Analysis, s.Pitch, s.BFCC
    if p.pitchDetectionAlgorithm != "yin":
        raise NotImplementedError(f"pitch algorithm {p.pitchDetectionAlgorithm}")
    if b.numCoefficients != 13:
        raise ValueError("exactly 13 coefficients are stored")
    bank = {"bands": b.numBands, "low": b.lowFrequencyBound, "high": b.highFrequencyBound, "normalize": b.normalize, "weighting": b.weightingType}
    names = list(FEATURES)
    src = events.select("signal_id", "event_idx", F.col("samples").cast("array<double>").alias("samples"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for sid, idx, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.asarray(x, float)
                m = K.frame_cut(x, a.frameSize, a.hopSize)
                if not len(m):
                    continue
                t = K.tapered(m, a.windowingType)
                spec = K.spectrum(t, b.spectrumType)
                c = K.bfcc(spec, rate, 13, b.liftering, b.dctType, b.spectrumType, **bank)
                hz, sure = K.yin(t, rate, p.minFrequency, p.maxFrequency, p.tolerance, p.interpolate)
                loud = K.loudness(K.frame_cut(K.equal_loudness(x, rate) if s.Loudness.equalizeLoudness else x, a.frameSize, a.hopSize))
                top = rate / 2
                made = [K.centroid(spec, top), K.decrease(spec, top), K.flatness(spec), K.crest(spec), K.complexity(spec, s.SpectralComplexity.magnitudeThreshold), K.strong_peak(spec)]
                cols = [*(c[:, i] for i in range(13)), *made, sure, loud, K.hz_to_midi(hz)]
                n = len(m)
                yield pa.RecordBatch.from_arrays([pa.array([sid] * n, batch.schema.field(0).type), pa.array([idx] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(v, from_pandas=True) for v in cols]], [*KEYS, "frame_idx", *names])

    kind = src.schema["signal_id"].dataType.simpleString()
    schema = f"signal_id {kind}, event_idx int, frame_idx int, " + ", ".join(f"{n} double" for n in names)
    return src.mapInArrow(run, schema)


def timbre_space(waves: DataFrame, rate: float, settings: Settings | None = None) -> DataFrame:
    """(signal_id, event_idx, 22 statistic records) of waves (signal_id, samples) of one sample rate. Empty
    waves and waves without onsets give no rows."""
    s = settings or Settings()
    waves = waves.where(F.size("samples") > 0).select("signal_id", "samples", F.lit(float(rate)).alias("_rate"))
    on = prepare(waves, s, rate)
    last = waves.select("signal_id", ((F.size("samples") - 1) / F.lit(float(rate))).alias("_end"))
    e = segments.bounds(on.join(last, "signal_id"), ["signal_id"], F.col("_end"))
    ev = segments.split(waves, e, ["signal_id"], "samples", "_rate", s.Split.fadeInSamps, s.Split.fadeOutSamps)
    f = frame_features(ev.repartition(*KEYS), s, rate)
    plain = tuple(x for x in FEATURES if x not in TIMBRAL)
    return stats.event_statistics(f, KEYS, FEATURES, "bfcc0", plain, s.BFCC.BFCC0_frameNormalizationFactor)

