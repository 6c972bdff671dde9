"""The engine's inputs, derived from business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of the month that the events lie in.
LENGTH = 2_592_000.0
DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, onset_s): a user's events as onsets, in seconds since the start of 2024."""
    s = F.expr("cast(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) as double) / 1e6D")
    return table(spark, sf_dir, "events").select("user_id", s.alias("onset_s"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("cast(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) as double) / 1e6D")
    return table(spark, sf_dir, "events").select("user_id", s.alias("t"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, frame): each embedding as a frame of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("frame"))
