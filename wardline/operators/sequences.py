"""Per-entity sequences: order, first row, arrays, padding, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.ordered import HOT_ROWS, gather, head_k, with_position

RELATIVE_TIME = "relative_time_to_final_event"
STEP_PART_ROWS = 5_000
# Fixed value: sequence length of the truncated variant.
TRUNCATED_LENGTH = 100


def timeline_order(time: str = RELATIVE_TIME, ties: Sequence[str] = ("event_type", "event_text")) -> list[Column]:
    """Earliest event first: most minutes before the final event first, unknown times last."""
    return [F.col(time).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]


def timeline_sort_values(time: str = RELATIVE_TIME, ties: Sequence[str] = ("event_type", "event_text")) -> list[Column]:
    """The same order as ascending values."""
    return [F.col(time).isNull(), -F.col(time), *[F.col(t) for t in ties]]


def position_index(
    df: DataFrame, entity: str, order: Sequence[Column] | None = None, name: str = "pos", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Step index of each row inside its entity's sequence."""
    return with_position(df, [entity], order or timeline_order(), name, hot_rows)


def timeline_sort(df: DataFrame, entity: str, time: str, ties: Sequence[str], name: str = "pos") -> DataFrame:
    """Rows in timeline order within each entity, the order made explicit as ``name``."""
    return with_position(df, [entity], timeline_order(time, ties), name)


def head_k_per_entity(
    df: DataFrame, entity: str, order: Sequence[Column], k: int = TRUNCATED_LENGTH, keep: str = "first", latest: Sequence[Column] = ()
) -> DataFrame:
    """The first ``k`` steps of each sequence; ``keep="last"`` takes the ``latest`` order instead."""
    return head_k(df, [entity], order if keep == "first" else latest, k)


def first_row_per_entity(df: DataFrame, entity: str, columns: Sequence[str], sort_values: Sequence[Column]) -> DataFrame:
    """Columns of the first row of each sequence.

    The order may hold texts, so each task sorts its rows by entity to find its first rows; one row per entity and task
    is shuffled.
    """
    first = F.min_by(F.struct(*columns), F.struct(*sort_values))
    return df.groupBy(entity).agg(first.alias("_first")).select(entity, "_first.*")


def sequence_per_entity(
    df: DataFrame,
    entity: str,
    steps: Sequence[str],
    time: str = RELATIVE_TIME,
    ties: Sequence[str] = ("event_type", "event_text"),
    part_rows: int = STEP_PART_ROWS,
    name: str = "steps",
) -> DataFrame:
    """Ordered steps per entity: ``(entity, part, first_pos, steps)``, keyed by (entity, part).

    A sequence has a part for every ``part_rows`` steps; ``first_pos`` is the place of a part's first step in the whole.

    A step holds the columns ``steps``; a column that also orders the steps is stored once.
    """
    untimed, counted_down, *tied = timeline_sort_values(time, ties)
    carried = [c for c in steps if c not in ties and c != time]
    layout = [untimed.alias("_untimed"), counted_down.alias("_countdown"), *tied, *[F.col(c) for c in carried]]

    def step(item: Column) -> Column:
        return F.struct(*[(-item["_countdown"] if c == time else item[c]).alias(c) for c in steps])

    return gather(df, [entity], timeline_order(time, ties), layout, part_rows, name, step)


def sequence_lengths(df: DataFrame, entity: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("length"))


def max_sequence_length(df: DataFrame, entity: str) -> DataFrame:
    return sequence_lengths(df, entity).agg(F.max("length").alias("max_length"))


def cohort_summary(df: DataFrame, entity: str, label: Column, sort_values: Sequence[Column]) -> DataFrame:
    """Entities, positives, their rate and the mean sequence length; the label of an entity is that of its first row."""
    labels = first_row_per_entity(df.withColumn("_label", label), entity, ["_label"], sort_values)
    lengths = sequence_lengths(df, entity).withColumnRenamed(entity, "_of")
    return labels.join(lengths, F.col(entity).eqNullSafe(F.col("_of"))).agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("_label").alias("positives"),
        F.avg("_label").alias("positive_rate"),
        F.avg("length").alias("mean_length"),
    )


def align_by_entity(sequences: DataFrame, statics: DataFrame, labels: DataFrame, entity: str) -> DataFrame:
    """One row per sequence with its static columns and its label; a sequence without either keeps NULL there."""
    return sequences.join(statics, entity, "left").join(labels, entity, "left")


def pad_steps(df: DataFrame, batch: str, entity: str, filler: dict[str, Column], pos: str = "pos") -> DataFrame:
    """Pad every sequence to the longest of its batch, in long form, and add its mask ``real``.

    ``df`` has a row per step with ``batch``, ``entity``, its 0-based ``pos`` and the columns of ``filler``. The missing
    positions are added as rows, so a sequence of any length is padded whole and never meets in one cell.
    """
    lengths = df.groupBy(batch, entity).agg(F.count(F.lit(1)).alias("_n"))
    longest = lengths.groupBy(F.col(batch).alias("_batch")).agg(F.max("_n").alias("_longest"))
    short = lengths.join(longest, F.col(batch).eqNullSafe(F.col("_batch"))).where(F.col("_n") < F.col("_longest")).select(
        batch, entity, F.explode(F.sequence(F.col("_n"), F.col("_longest") - 1)).alias(pos)
    ).withColumn(pos, F.col(pos).cast(df.schema[pos].dataType))
    added = short.withColumns({name: value.cast(df.schema[name].dataType) for name, value in filler.items()}).withColumn("real", F.lit(False))
    return df.select(batch, entity, pos, *filler).withColumn("real", F.lit(True)).unionByName(added)


def mean_vector(
    df: DataFrame, keys: Sequence[str], vector: str, name: str = "mean", weight: str | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """Element-wise (weighted) mean of equally long arrays, merged before the shuffle; NULL arrays do not count."""
    packed = df.where(F.col(vector).isNotNull()).withColumn("_vector", array_to_vector(F.col(vector).cast("array<double>")))
    mean = Summarizer.mean(F.col("_vector")) if weight is None else Summarizer.mean(F.col("_vector"), F.col(weight))
    return packed.groupBy(*keys).agg(vector_to_array(mean).alias(name), *extra)


def sequence_mean_pool(df: DataFrame, entity: str, vector: str) -> DataFrame:
    """Mean step vector of each sequence."""
    return mean_vector(df, [entity], vector, "pooled")
