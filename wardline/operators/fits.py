"""Fitted values: one aggregate over the input gives a small table that every encoder reads.

``fit`` reads the input once however many columns are fitted. Up to FEW rows the table is a local one and nothing is
written; beyond, it is stored. Its rows are
``(column, category, slot, n, mean, deviation, filled_deviation)``: one row per category of a category column
and one row per number column. A fit that was written to Parquet can be read back and applied the same way.

Categories are numbered in sorted order by the number of distinct values before them, without collecting them.
``slots`` looks the number up by a join, for any number of categories; ``one_hot_column`` is the dense array, which
is an explicit request for as many numbers as there are categories.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wardline.functions.vectors import one_hot, standardize
from wardline.operators.ordered import with_position
from wardline.session import stored

#: Fitted rows that are numbered on the driver; a fit with more categories is numbered and stored by Spark.
FEW = 10_000
UNKNOWN = "Unknown"  # fixed value: stands for a missing category


def impute_constant(value: Column, constant: str = UNKNOWN) -> Column:
    return F.coalesce(value, F.lit(constant))


def impute_mean(df: DataFrame, column: str) -> Column:
    """The column with its NULLs (or NaNs) replaced by its mean."""
    number = _number(F.col(column))
    return F.coalesce(number, df.agg(F.avg(number)).scalar())


def _number(column: Column) -> Column:
    number = column.cast("double")
    return F.when(~F.isnan(number), number)


def _category(column: str, impute: str | None) -> Column:
    value = F.col(column).cast("string")
    return value if impute is None else impute_constant(value, impute)


def fit(df: DataFrame, categories: Sequence[str] = (), numbers: Sequence[str] = (), impute: str | None = None) -> DataFrame:
    """Fit category and number columns in one pass over ``df``; a category that is missing counts as ``impute``.

    The deviation is that of the population. ``filled_deviation`` is the deviation after missing values were set to
    the mean: they add nothing to the squares and count as rows.
    """
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [F.struct(F.lit(c).alias("column"), F.lit(True).alias("listed"), _category(c, impute).alias("category"), nothing.alias("x")) for c in categories]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(False).alias("listed"), no_text.alias("category"), _number(F.col(c)).alias("x")) for c in numbers]
    seen = df.select(F.inline(F.array(*cells))).groupBy("column", "listed", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("present"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation")
    )
    seen = seen.where(~F.col("listed") | F.col("category").isNotNull())
    few = seen.limit(FEW + 1).collect()
    if len(few) <= FEW:
        return df.sparkSession.createDataFrame(_numbered(few))
    seen = stored(seen, "fit")
    numbered = with_position(seen.where("listed"), ["column"], [F.col("category")], "slot")
    whole = numbered.unionByName(seen.where("not listed").withColumn("slot", F.lit(None).cast("long")))
    filled = F.col("deviation") * F.sqrt(F.col("present") / F.col("n"))
    return stored(whole.select(
        "column", "category", F.col("slot").cast("int").alias("slot"), "n", "mean", "deviation", filled.alias("filled_deviation")
    ), "fit")


def _numbered(seen: list[Row]) -> pa.Table:
    """The fitted table from its few rows."""
    listed = sorted((r for r in seen if r["listed"]), key=lambda r: (r["column"], r["category"].encode("utf-8", "surrogatepass")))
    rows, before = [], {}
    for r in listed:
        before[r["column"]] = before.get(r["column"], -1) + 1
        rows.append((r["column"], r["category"], before[r["column"]], r["n"], r["mean"], r["deviation"], None))
    for r in seen:
        if not r["listed"]:
            filled = None if r["deviation"] is None else r["deviation"] * math.sqrt(r["present"] / r["n"])
            rows.append((r["column"], None, None, r["n"], r["mean"], r["deviation"], filled))
    kinds = {
        "column": pa.string(), "category": pa.string(), "slot": pa.int32(), "n": pa.int64(), "mean": pa.float64(),
        "deviation": pa.float64(), "filled_deviation": pa.float64(),
    }
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def fit_categories(fitted: DataFrame, column: str) -> DataFrame:
    """``(slot, category)`` of a fitted column, one row per category."""
    return fitted.where((F.col("column") == column) & F.col("category").isNotNull()).select("slot", "category")


def fit_scaler(fitted: DataFrame, column: str, mean_fill: bool = False) -> DataFrame:
    """One row ``(mean, deviation)`` of a fitted number column."""
    deviation = F.col("filled_deviation" if mean_fill else "deviation").alias("deviation")
    return fitted.where((F.col("column") == column) & F.col("category").isNull()).select("mean", deviation)


def width(fitted: DataFrame, columns: Sequence[str]) -> Column:
    """Number of categories of the columns together, as a scalar."""
    listed = fitted.where(F.col("column").isin(*columns) & F.col("category").isNotNull())
    return listed.agg(F.count(F.lit(1)).cast("int")).scalar()


def slots(df: DataFrame, fitted: DataFrame, column: str, name: str, impute: str | None = None) -> DataFrame:
    """Add the slot of each row's category, NULL where the fit does not know it; for any number of categories."""
    known = fit_categories(fitted, column).select(F.col("category").alias("_category"), F.col("slot").alias(name))
    keyed = df.withColumn("_value", _category(column, impute))
    return keyed.join(known, F.col("_value") == F.col("_category"), "left").drop("_value", "_category")


def one_hot_column(fitted: DataFrame, column: str, impute: str | None = None) -> Column:
    """Dense one-hot array over all categories of a fitted column."""
    categories = fit_categories(fitted, column).agg(F.array_sort(F.collect_list("category"))).scalar()
    return one_hot(_category(column, impute), categories)


def scaled_column(fitted: DataFrame, column: str, mean_fill: bool = False) -> Column:
    """The number as deviations from its mean; missing ones are NULL, or at the mean with ``mean_fill``."""
    scaler = fit_scaler(fitted, column, mean_fill)
    mean = scaler.select("mean").scalar()
    value = F.coalesce(_number(F.col(column)), mean) if mean_fill else F.col(column)
    return standardize(value, mean, scaler.select("deviation").scalar())


def static_vector(fitted: DataFrame, categories: Sequence[str], number: str | None) -> Column:
    """One-hot columns in the given order, then the scaled number."""
    parts = [one_hot_column(fitted, c, UNKNOWN) for c in categories]
    if number is not None:
        parts.append(F.array(scaled_column(fitted, number, mean_fill=True)))
    return F.concat(*parts)
