"""Array (vector) column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: base of the sinusoidal codes.
WAVE_BASE = 10000.0


def one_hot(value: Column, categories: Column) -> Column:
    """One slot per category, in order; a value outside the categories gives zeros only."""
    zero = F.lit(0.0)
    place, width = F.array_position(categories, value), F.size(categories)
    marked = F.concat(
        F.array_repeat(zero, (place - 1).cast("int")), F.array(F.lit(1.0)), F.array_repeat(zero, (width - place).cast("int"))
    )
    return F.when(place > 0, marked).otherwise(F.array_repeat(zero, width))


def standardize(value: Column, mean: Column, deviation: Column) -> Column:
    """``(x - mean) / deviation``; a zero deviation scales by 1, NULL stays NULL."""
    return (value.cast("double") - mean) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def time_waves(scaled: Column, width: int = 16) -> Column:
    """Sine at even and cosine at odd slots; slot ``i`` divides by ``base ** (i / width)``."""
    angles = [scaled / F.lit(WAVE_BASE ** (i / width)) for i in range(width)]
    return F.array(*[F.cos(angle) if i % 2 else F.sin(angle) for i, angle in enumerate(angles)])


def position_waves(position: Column, width: int = 256) -> Column:
    """Sine and cosine pairs; the pair ``k`` turns at ``exp(-2k ln(base) / width)``."""
    def slot(i: Column) -> Column:
        pair = i - (i % 2)
        angle = position * F.exp(pair * (-F.ln(F.lit(WAVE_BASE)) / F.lit(float(width))))
        return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), slot)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def truncate(sequence: Column, length: int) -> Column:
    return F.slice(sequence, 1, length)


def pad(sequence: Column, length: Column, filler: Column) -> Column:
    """Append ``filler`` up to ``length`` items; a longer sequence is left as it is."""
    missing = F.greatest(length - F.size(sequence), F.lit(0))
    return F.concat(sequence, F.array_repeat(filler, missing))


def padding_mask(real_length: Column, length: Column) -> Column:
    """True at real steps, false at padding."""
    return F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: i <= real_length)
