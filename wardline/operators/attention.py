"""Attention weights in long form: softmax pooling and summaries.

Tables: ``attention(layer, batch, head, q, k, weight)``, ``pooling(batch, head, pos, weight)``,
``outputs(batch, pos, dim, value)``. All summaries are plain aggregates that merge before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.vectors import dot
from wardline.operators.ordered import head_k
from wardline.operators.sequences import mean_vector

# Fixed values
TOP_POSITIONS = 5
TOP_FEATURES = 10
WEIGHT_BINS = 30
ATTRIBUTION_BINS = 50
CRITICAL_WEIGHT = 0.1
FIRST_BATCHES = 10

# Scores are summed in bands of this width, so exp() neither overflows nor vanishes inside a band.
_BAND = 16.0


def score_bands(df: DataFrame, score: str) -> DataFrame:
    """Add the band of a score and its exponential relative to the band."""
    band = F.floor(F.col(score) / _BAND)
    return df.withColumns({"_band": band, "_mass": F.exp(F.col(score) - band * _BAND)})


def softmax_pool_weights(df: DataFrame, keys: Sequence[str], score: str, name: str = "weight") -> DataFrame:
    """Softmax of the scores of each group.

    The normaliser of a group is one aggregate that merges before the shuffle, not a window over the
    group; a hot group is then joined to its one normaliser row, which the adaptive skew join splits.
    """
    keys = list(keys)
    masses = score_bands(df, score).groupBy(*keys, "_band").agg(F.sum("_mass").alias("_mass"))
    totals = _relative_mass(masses, keys).groupBy(*keys).agg(F.max("_top").alias("_top"), F.sum("_weight").alias("_total"))
    weight = F.exp(F.col(score) - F.col("_top") * _BAND) / F.col("_total")
    # null-safe: the rows without a key are a group as well
    named = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_top", "_total")
    same = reduce(and_, [df[k].eqNullSafe(named[f"_of_{k}"]) for k in keys], F.lit(True))
    return df.join(named, same).withColumn(name, weight).drop("_top", "_total", *[f"_of_{k}" for k in keys])


def _relative_mass(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mass of each band relative to the largest band of its key; a key has score range / width bands."""
    top = F.max("_band").over(Window.partitionBy(*keys))
    return bands.withColumn("_top", top).withColumn("_weight", F.col("_mass") * F.exp((F.col("_band") - F.col("_top")) * _BAND))


def attention_score(step: Column, query: Column, width: int) -> Column:
    return dot(step, query) / F.sqrt(F.lit(float(width)))


def softmax_attention_pool(df: DataFrame, entity: str, step: str, query: Column, width: int, name: str = "pooled") -> DataFrame:
    """One vector per sequence: steps weighted by the softmax of their score against the query.

    Steps are averaged per (entity, band) and the few bands of an entity are merged, so no step is
    shuffled and no sequence has to fit a task.
    """
    scored = score_bands(df.select(entity, step, attention_score(F.col(step), query, width).alias("_score")), "_score")
    mass = F.sum("_mass").alias("_mass")
    by_band = mean_vector(scored, [entity, "_band"], step, "_mean", weight="_mass", extra=[mass])
    merged = _relative_mass(by_band, [entity]).where(F.col("_weight") > 0)
    return mean_vector(merged, [entity], "_mean", name, weight="_weight")


def layer_attention_mean(attention: DataFrame) -> DataFrame:
    """Mean weight of every (layer, query, key) cell over batches and heads."""
    return attention.groupBy("layer", "q", "k").agg(F.avg("weight").alias("mean_weight"))


def layer_global_local(attention: DataFrame) -> DataFrame:
    """Per layer: mean weight, and mean weight on the diagonal."""
    return attention.groupBy("layer").agg(
        F.avg("weight").alias("global_attention"),
        F.avg(F.when(F.col("q") == F.col("k"), F.col("weight"))).alias("local_attention"),
    )


def position_importance(pooling: DataFrame) -> DataFrame:
    return pooling.groupBy("head", "pos").agg(F.avg("weight").alias("importance"))


def combined_importance(importance: DataFrame) -> DataFrame:
    """Mean over heads of the importance of each position."""
    return importance.groupBy("pos").agg(F.avg("importance").alias("importance"))


def head_statistics(importance: DataFrame) -> DataFrame:
    """Mean and both deviations of each head over positions."""
    return importance.groupBy("head").agg(
        F.avg("importance").alias("mean_attention"),
        F.stddev_samp("importance").alias("std_sample"),
        F.stddev_pop("importance").alias("std_population"),
    )


def top_k_positions(importance: DataFrame, k: int = TOP_POSITIONS) -> DataFrame:
    """The ``k`` most important positions of each head, ranked from 0."""
    order = [F.col("importance").desc_nulls_last(), F.col("pos").asc()]
    # few rows per head: one per position, already merged
    return head_k(importance, ["head"], order, k, "rank", hot_rows=None)


def top_k_features(outputs: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The ``k`` largest mean outputs of each position, ranked from 0."""
    means = outputs.groupBy("pos", "dim").agg(F.avg("value").alias("importance"))
    return head_k(means, ["pos"], [F.col("importance").desc_nulls_last(), F.col("dim").asc()], k, "rank", hot_rows=None)


def critical_positions(pooling: DataFrame, threshold: float = CRITICAL_WEIGHT) -> DataFrame:
    return pooling.where(F.col("weight") > threshold)


def first_n_batches(df: DataFrame, n: int = FIRST_BATCHES, batch: str = "batch") -> DataFrame:
    return df.where(F.col(batch) < n)


def weight_histogram(df: DataFrame, value: str, bins: int = WEIGHT_BINS) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value; the top edge joins the last bin.

    All bins are listed. A single distinct value is spread over the range one half to either side.
    """
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    same = low == high
    start = F.when(same, low - 0.5).otherwise(low)
    width = F.when(same, F.lit(1.0)).otherwise(high - low) / bins
    place = F.least(F.floor((F.col(value) - start) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def feature_by_position(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("pos").agg(F.avg("value").alias("mean_value"))


def feature_by_dimension(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("dim").agg(F.avg("value").alias("mean_value"))


def temporal_attribution(weights: DataFrame, events: DataFrame, entity: str, k: int = TOP_POSITIONS) -> DataFrame:
    """The ``k`` heaviest positions of each (entity, head) with the events at those positions of that entity.

    ``weights`` has ``(entity, head, pos, weight)``. The result has at most entities x heads x ``k`` rows.
    """
    order = [F.col("weight").desc_nulls_last(), F.col("pos").asc()]
    return head_k(weights, [entity, "head"], order, k, "rank").join(events, [entity, "pos"], "inner")
