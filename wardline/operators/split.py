"""Stratified train / validation / test split and label-free samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.ordered import HOT_ROWS, with_position

# Fixed values
SEED = 42
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.2


def key_hash(key: Column, seed: int = SEED) -> Column:
    """A stable pseudo-random order of keys, the same for every layout of the data."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test_share: float = TEST_SHARE,
    validation_share: float = VALIDATION_SHARE,
    seed: int = SEED,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``split``: within each label, the first keys in hash order are test, then validation.

    Shares are rounded half up per label, validation is a share of what the test set leaves. A label
    may hold most of the rows: its keys are counted by buckets of the hash order, and only the buckets in which a
    share ends are ranked. Rows without a label are training rows.
    """
    hashed = df.withColumn("_hash", key_hash(F.col(key), seed)).withColumn("_bucket", F.substring("_hash", 1, 4))
    # how many keys of each label stand before each bucket of the hash order: at most 65,536 small rows per label
    counts = hashed.where(F.col(label).isNotNull()).groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    along = Window.partitionBy(label).orderBy("_bucket")
    placed = counts.select(
        label, "_bucket", "_in", F.sum("_in").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_until"),
        F.sum("_in").over(Window.partitionBy(label)).alias("_n"),
    )
    n_test = half_up(F.col("_n") * F.lit(test_share))
    n_validation = half_up((F.col("_n") - n_test) * F.lit(validation_share))
    ends = placed.withColumn("_test", n_test).withColumn("_both", n_test + n_validation)

    def border(end: str) -> Column:
        """The bucket in which the first ``end`` keys end, with the keys before it."""
        reached = F.col("_until") > F.col(end)
        return F.min(F.when(reached, F.struct("_bucket", (F.col("_until") - F.col("_in")).alias("before"))))

    borders = ends.groupBy(label).agg(
        border("_test").alias("_a"), border("_both").alias("_b"), F.first("_test").alias("_test"), F.first("_both").alias("_both")
    ).withColumnRenamed(label, "_label")
    joined = hashed.join(borders, hashed[label] == borders["_label"], "left")
    # past the last key there is no border bucket: everything lies before it
    last = F.lit("g")
    first_border, second_border = F.coalesce("_a._bucket", last), F.coalesce("_b._bucket", last)
    bucket, known = F.col("_bucket"), F.col("_label").isNotNull()
    clear = joined.where(~known | ((bucket != first_border) & (bucket != second_border)))
    whole = F.when(~known, "train").when(bucket < first_border, "test").when(bucket < second_border, "validation").otherwise("train")
    # only the keys in a border bucket are ranked
    ranked = with_position(joined.where(known & ((bucket == first_border) | (bucket == second_border))), [label, "_bucket"], [F.col("_hash"), F.col(key)], "_place", hot_rows)
    before = F.when(bucket == first_border, F.col("_a.before")).otherwise(F.col("_b.before"))
    place = F.col("_place") + before
    cut = F.when(place < F.col("_test"), "test").when(place < F.col("_both"), "validation").otherwise("train")
    return clear.withColumn("split", whole).select(*df.columns, "split").unionByName(
        ranked.withColumn("split", cut).select(*df.columns, "split")
    )


def dataset_of(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def write_datasets(df: DataFrame, path: str) -> None:
    """One folder per split, so a dataset is read by partition pruning."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = SEED) -> DataFrame:
    """About ``fraction`` of the keys by hash; the same keys whatever the layout. No shuffle."""
    return df.where(F.conv(F.substring(key_hash(F.col(key), seed), 1, 8), 16, 10).cast("long") < int(fraction * 2**32))
