"""Scalar column expressions. All are JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest logarithm a binary cross-entropy term may take.
LOG_FLOOR = -100.0


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``, truncated to zero; needs no time zone."""
    return F.call_function("div", end - start, F.expr("interval '1' minute"))


def final_event_time(expired: Column, death_time: Column, end_time: Column) -> Column:
    """Death time for expired patients, otherwise the end of the stay; NULLs pass through."""
    return F.when(expired == 1, death_time).otherwise(end_time)


def true_false(condition: Column) -> Column:
    """``'True'`` or ``'False'``; an unknown condition is ``'False'``."""
    return F.when(condition, F.lit("True")).otherwise(F.lit("False"))


def flag_in_stay(time: Column, start: Column, end: Column) -> Column:
    return true_false(time.between(start, end))


def flag_nonempty(value: Column) -> Column:
    return true_false(value.isNotNull() & (value != ""))


def is_missing(value: Column, floating: bool = True) -> Column:
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def label_to_int(label: Column) -> Column:
    return F.coalesce(label.cast("int"), F.lit(0))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def natural_log(x: Column) -> Column:
    """Natural logarithm with minus infinity at zero and NaN below, where Spark gives NULL."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def _floored_log(x: Column) -> Column:
    # ln(0) is NULL in Spark and minus infinity in the loss; both end at the floor
    return F.greatest(F.coalesce(F.ln(x), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR))


def cross_entropy(probability: Column, label: Column) -> Column:
    """Binary cross-entropy of one row; NULL inputs give NULL."""
    y = label.cast("double")
    loss = -(y * _floored_log(probability) + (1.0 - y) * _floored_log(1.0 - probability))
    return F.when(probability.isNotNull(), loss)
