"""Change points of feature sequences by the Bayesian information criterion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..settings import SBic, Settings
from . import framing


def cepstra(waves: DataFrame, key: str, samples: str, rate: float, settings: Settings | None = None) -> DataFrame:
    """(key, frame_idx, cepstra) of waves: the features that bic() searches, by the analysis's frames,
    taper and Bark bands."""
    s = settings or Settings()
    b = s.BFCC
    bank = {"bands": b.numBands, "low": b.lowFrequencyBound, "high": b.highFrequencyBound, "normalize": b.normalize, "weighting": b.weightingType}

    def kernel(m):
        x = K.spectrum(K.tapered(m, s.Analysis.windowingType), b.spectrumType)
        return {"cepstra": K.bfcc(x, rate, b.numCoefficients, b.liftering, b.dctType, b.spectrumType, **bank)}

    f = framing.frames(waves, [key], samples, s.Analysis.frameSize, s.Analysis.hopSize)
    return framing.map_frames(f, [key, "frame_idx"], "frame", {"cepstra": "array<double>"}, kernel)


def bic(rows: DataFrame, key: str, order: str, features: str, settings: SBic | None = None) -> DataFrame:
    """(key, start_frame): 0 and each change point, per sequence of feature arrays by order. A sequence is
    searched window by window, so it is one task's work."""
    s = settings or SBic()
    src = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(features).alias("f")))).alias("x"))
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(1).to_pylist()):
                found = K.bic_segments(np.array([p["f"] for p in x]), s.cpw, s.size1, s.inc1, s.size2, s.inc2, s.minLength)
                n = len(found) + 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array([0, *found], pa.int32())], [key, "start_frame"])

    return src.mapInArrow(run, f"`{key}` {kind}, start_frame int")
