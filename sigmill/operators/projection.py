"""Projection of feature vectors: covariances and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import project


def covariance(rows: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, covariance) of all pairs i <= j, in one pass."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k:]]
    one = rows.agg(*[F.covar_pop(a, b).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    rows_ = F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{n}").alias("covariance")) for n, (a, b) in enumerate(pairs)])).alias("x")
    return one.select(rows_).select("x.*")


def pca(rows: DataFrame, keys: list[str], features: list[str] | str, k: int = 6) -> DataFrame:
    """(keys, pc array): centred rows on the k first components; each component's loading of largest size
    is positive. features: columns, or the name of one array column. Fewer than 2 rows: an empty table."""
    if isinstance(features, str):
        v = rows.select(*keys, array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    else:
        v = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(rows).select(*keys, "_v")
    if len(v.take(2)) < 2:
        return v.limit(0).select(*keys, F.expr("cast(array() as array<double>)").alias("pc"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    n = len(centred.first()["_c"])
    model = PCA(k=min(k, n), inputCol="_c", outputCol="_p").fit(centred)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), range(load.shape[1])])
    signs = F.array(*[F.lit(float(s or 1.0)) for s in sign])
    return model.transform(centred).select(*keys, F.zip_with(vector_to_array("_p"), signs, lambda a, b: a * b).alias("pc"))


def pca_of_statistic(events: DataFrame, keys: list[str], features: list[str], statistic: str, k: int = 6) -> DataFrame:
    """(keys, pc array) of one statistic of chosen features (stats.event_statistics()) over all events;
    events where it isn't defined drop out; fewer than 2: an empty table."""
    return pca(project(events, keys, features, statistic), keys, features, k)
