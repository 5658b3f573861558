"""From flat event rows to encoded sequences, static vectors, labels and splits.

Step vectors are wide, so they are joined to the steps by text key only after the steps of a sequence
have been chosen, and one sequence is stored in parts of bounded length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import label_to_int
from wardline.operators.embedding import WIDTH, Encoder, embed_text
from wardline.operators.fits import UNKNOWN, fit, one_hot_column, scaled_column, static_vector, width
from wardline.operators.sequences import (
    RELATIVE_TIME,
    STEP_PART_ROWS,
    first_row_per_entity,
    head_k_per_entity,
    sequence_per_entity,
    timeline_order,
    timeline_sort_values,
)
from wardline.operators.split import SEED, TEST_SHARE, VALIDATION_SHARE, stratified_split
from wardline.session import stored
from wardline.sources.schemas import STATIC_CATEGORIES, STATIC_NUMBER
from wardline.sources.vector_cache import vector_cache_buckets, vector_cache_lookup

LABEL = "patient_expired_in_hospital"
TIES = ("event_type", "event_text", "icu_stay_id")


def flat_events(base: DataFrame, events: DataFrame) -> DataFrame:
    """Event rows with the columns of their stay: the input of feature building."""
    return events.join(base, "icu_stay_id", "inner")


def row_order() -> tuple[list[Column], list[Column]]:
    """Timeline order with a tie-break by event and stay, as descending columns and ascending values."""
    return timeline_order(RELATIVE_TIME, TIES), timeline_sort_values(RELATIVE_TIME, TIES)


def entity_rows(flat: DataFrame, entity: str = "patient_id", static: Sequence[str] = STATIC_CATEGORIES, number: str = STATIC_NUMBER) -> DataFrame:
    """One row per entity: static columns and label of the first event."""
    _, sort_values = row_order()
    first = first_row_per_entity(flat, entity, [*static, number, LABEL], sort_values)
    return first.withColumn("label", label_to_int(F.col(LABEL))).drop(LABEL)


def fit_features(
    flat: DataFrame, static: Sequence[str] = STATIC_CATEGORIES, number: str | None = STATIC_NUMBER, kind: str = "event_type", time: str = RELATIVE_TIME
) -> DataFrame:
    """Event types, static categories and both number columns, fitted in one pass over the rows."""
    kinds = flat.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in static})
    return fit(kinds, [kind, *static], [time, *([number] if number else [])])


def step_vector(fitted: DataFrame, embedding: Column, kind: str = "event_type", time: str = RELATIVE_TIME) -> Column:
    """Event type, text vector and scaled time of a step, in this order, as 4-byte numbers."""
    code, scaled = one_hot_column(fitted, kind), F.array(scaled_column(fitted, time))
    return F.concat(code.cast("array<float>"), embedding.cast("array<float>"), scaled.cast("array<float>"))


@dataclass(frozen=True)
class TrainingSet:
    sequences: DataFrame  # (entity, part, first_pos, steps)
    entities: DataFrame  # (entity, static vector, label, split)
    dims: DataFrame  # one row (input_dim, static_dim)


def feature_dims(
    fitted: DataFrame, embedding_width: int, time_width: int = 1, static: Sequence[str] = STATIC_CATEGORIES, numbers: int = 1, kind: str = "event_type"
) -> DataFrame:
    """Widths of a step and of a static vector, from the fitted categories."""
    return fitted.sparkSession.range(1).select(
        (width(fitted, [kind]) + embedding_width + time_width).alias("input_dim"), (width(fitted, static) + numbers).alias("static_dim")
    )


def prepare_training_set(
    flat: DataFrame,
    cache_path: str,
    embedding_width: int = WIDTH,
    encoder: Encoder | None = None,
    entity: str = "patient_id",
    max_events: int | None = None,
    fit_on: str = "all",
    static: Sequence[str] = STATIC_CATEGORIES,
    number: str = STATIC_NUMBER,
    part_rows: int = STEP_PART_ROWS,
    shares: tuple[float, float] = (TEST_SHARE, VALIDATION_SHARE),
    seed: int = SEED,
) -> TrainingSet:
    """Encode event rows for a sequence model.

    Texts that the cache at ``cache_path`` lacks are encoded and added, so no step is without a vector. ``fit_on="train"``
    fits categories and scalers on the training entities only; the default fits on all rows. ``max_events`` keeps the
    earliest events of an entity.
    """
    entities = stored(stratified_split(entity_rows(flat, entity, static, number), entity, "label", *shares, seed), "entities")
    rows = flat if fit_on == "all" else flat.join(entities.where(F.col("split") == "train").select(entity), entity, "left_semi")
    fitted = fit_features(rows, static, number)
    order, _ = row_order()
    steps = flat if max_events is None else head_k_per_entity(flat, entity, order, max_events)
    steps = steps.select(entity, "icu_stay_id", "event_type", "event_text", RELATIVE_TIME)
    vectors = embed_text(flat.sparkSession, steps, "event_text", cache_path, encoder)
    keyed = vector_cache_lookup(steps, "event_text", vectors, vector_cache_buckets(flat.sparkSession, cache_path))
    encoded = keyed.withColumn("vector", step_vector(fitted, F.col("embedding"))).drop("embedding")
    sequences = sequence_per_entity(encoded, entity, ["vector"], RELATIVE_TIME, TIES, part_rows)
    return TrainingSet(
        sequences=sequences.withColumn("steps", F.transform("steps", lambda s: s["vector"])),
        entities=entities.select(entity, static_vector(fitted, static, number).alias("static"), "label", "split"),
        dims=feature_dims(fitted, embedding_width, 1, static),
    )
