"""Summaries of attributions in long form: ``attribution(item, pos, dim, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.attention import ATTRIBUTION_BINS, weight_histogram


def mean_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("value").alias("mean_value"))


def attribution_matrix(attribution: DataFrame) -> DataFrame:
    return mean_by(attribution, ["pos", "dim"])


def attribution_by_dimension(attribution: DataFrame) -> DataFrame:
    return mean_by(attribution, ["dim"])


def attribution_by_position(attribution: DataFrame) -> DataFrame:
    return mean_by(attribution, ["pos"])


def static_attribution_mean(static_attribution: DataFrame) -> DataFrame:
    return mean_by(static_attribution, ["dim"])


def attribution_histogram(attribution: DataFrame, bins: int = ATTRIBUTION_BINS) -> DataFrame:
    return weight_histogram(attribution, "value", bins)
