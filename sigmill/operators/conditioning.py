"""Signal conditioning per wave: resampling and the equal-loudness filter, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import kernels as K


def map_waves(rows: DataFrame, keys: list[str], samples: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, samples as doubles): a kernel over one wave at a time. A null wave stays null."""
    src = rows.select(*keys, samples)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"`{samples}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(len(keys))[i].values
                out = None if x is None else kernel(x.to_numpy(zero_copy_only=False).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns[: len(keys)]), pa.array([out], pa.list_(pa.float64()))], [*keys, samples])

    return src.mapInArrow(run, schema)


def resample(rows: DataFrame, keys: list[str], samples: str, rate: float, target: float = 44100.0) -> DataFrame:
    return map_waves(rows, keys, samples, lambda x: K.resample(x, rate, target))


def equal_loudness(rows: DataFrame, keys: list[str], samples: str, rate: float = 44100.0) -> DataFrame:
    return map_waves(rows, keys, samples, lambda x: K.equal_loudness(x, rate))
