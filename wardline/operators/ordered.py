"""Order inside groups of any size.

Every reference result that needs an order inside a stay or a patient (timelines, ordered arrays,
ordered text, ranks) goes through this module. A group is *hot* when it holds more rows than one task
should sort. One pre-aggregated count tells whether there are hot groups:

* without them, one shuffle on the group key and one window do the work;
* hot groups are cut into range slices of the full order, so a slice has a bounded number of rows even
  when one group, one instant or one set of equal rows holds most of the table. Slices are numbered in
  order and stored with a checkpoint, which keeps the cut stable when a task is run again. A value per
  row is then the value inside its slice combined with the value of the slices before it.

Both ways give the same answer; no row is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut_lineage, placement

HOT_ROWS = 1_000_000
SLICE_ROWS = 250_000
# a counted list of up to this many hot keys is sent to every task, a longer one is joined as any table
BROADCAST_KEYS = 100_000


@dataclass
class _Split:
    light: DataFrame
    hot: DataFrame | None
    hot_rows: int


def _match(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for ours, theirs in pairs:
        condition = condition & left[ours].eqNullSafe(right[theirs])
    return condition


def _split_hot(df: DataFrame, keys: Sequence[str], limit: int | None) -> _Split:
    """Separate the groups with more than ``limit`` rows; ``None`` states that there are none."""
    if limit is None:
        return _Split(df, None, 0)
    names = [f"_hot_{k}" for k in keys]
    sizes = (
        df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
    )
    rows, groups = sizes.agg(F.sum("_rows"), F.count(F.lit(1))).first()
    if not groups:
        return _Split(df, None, 0)
    # stored, as it is used twice; there are at most (all rows / limit) hot keys
    sizes = cut_lineage(sizes)
    if groups <= BROADCAST_KEYS:
        sizes = F.broadcast(sizes)
    on = _match(df, sizes, list(zip(keys, names)))
    return _Split(df.join(sizes, on, "left_anti"), df.join(sizes, on, "left_semi"), int(rows))


def crowded(limit: int, sources: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> set[str]:
    """Names of the tables in which some key has more than ``limit`` rows.

    One job counts the keys of all tables, from the key columns alone. A group that is made of the rows
    of one key cannot be larger than the key, so tables that are not named need no further count.
    """
    tests = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
        .agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("keys"))
        for name, (df, keys) in sources.items()
    ]
    counts = reduce(DataFrame.unionByName, tests).collect()  # one row per table
    return {row["name"] for row in counts if row["keys"]}


def _slices(split: _Split, keys: Sequence[str], order: Sequence[Column], slice_rows: int) -> DataFrame:
    """Hot rows with ``_slice``: consecutive ranges of (group, order), each of bounded size."""
    # the first checkpoint fixes the row numbers, which let equal rows go to different slices
    stored = cut_lineage(split.hot).withColumn("_row", F.monotonically_increasing_id())
    # a slice may be sorted on disk, so a few per core are enough; their number does not grow with the data
    most = 8 * max(1, split.hot.sparkSession.sparkContext.defaultParallelism)
    n = max(2, min(most, -(-split.hot_rows // slice_rows)))
    ranged = stored.repartitionByRange(n, *[F.col(k) for k in keys], *order, F.col("_row"))
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def _carry(sliced: DataFrame, keys: Sequence[str], summary: Column, combine, name: str) -> DataFrame:
    """Per (group, slice): ``combine`` of the summaries of the group's earlier slices."""
    per_slice = sliced.groupBy(*keys, "_slice").agg(summary.alias("_summary"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.withColumn(name, combine("_summary").over(earlier))
    return carried.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_slice").alias("_c_slice"), name)


def _attach(sliced: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = [(k, f"_c_{k}") for k in keys] + [("_slice", "_c_slice")]
    return sliced.join(carried, _match(sliced, carried, pairs), "left")


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "pos",
    hot_rows: int | None = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add the 0-based place of each row in its group; ``order`` must be a total order."""
    keys, order = list(keys), list(order)
    split = _split_hot(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    light = split.light.withColumn(name, F.row_number().over(window).cast("long") - 1)
    if split.hot is None:
        return light
    sliced = _slices(split, keys, order, slice_rows)
    carried = _carry(sliced, keys, F.count(F.lit(1)), F.sum, "_before")
    local = Window.partitionBy(*keys, "_slice").orderBy(*order, F.col("_row"))
    inside = sliced.withColumn("_inside", F.row_number().over(local).cast("long") - 1)
    placed = _attach(inside, carried, keys).withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0)))
    return light.unionByName(placed.select(*light.columns))


def _numbered_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], part_rows: int, slice_rows: int
) -> DataFrame | None:
    """Rows with ``part``, the consecutive parts of each group; None where every group fits one part."""
    split = _split_hot(df, keys, part_rows)
    if split.hot is None:
        return None
    placed = with_position(split.hot, keys, order, "_pos", hot_rows=HOT_ROWS, slice_rows=slice_rows)
    numbered = placed.withColumn("part", F.floor(F.col("_pos") / part_rows).cast("int")).drop("_pos")
    return numbered.unionByName(split.light.withColumn("part", F.lit(0)))


def running_min(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str,
    name: str,
    hot_rows: int | None = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add the smallest ``value`` of the earlier rows of the group (NULL on the first row)."""
    keys, order = list(keys), list(order)
    split = _split_hot(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    light = split.light.withColumn(name, F.min(value).over(window))
    if split.hot is None:
        return light
    sliced = _slices(split, keys, order, slice_rows)
    carried = _carry(sliced, keys, F.min(value), F.min, "_before")
    local = Window.partitionBy(*keys, "_slice").orderBy(*order, F.col("_row"))
    inside = sliced.withColumn("_inside", F.min(value).over(local.rowsBetween(Window.unboundedPreceding, -1)))
    placed = _attach(inside, carried, keys).withColumn(name, F.least("_inside", "_before"))
    return light.unionByName(placed.select(*light.columns))


def _head(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k)


def head_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    name: str = "pos",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark limits the groups before the shuffle (WindowGroupLimit), so a group sends at most ``k`` rows
    per input task. Hot groups have rows in very many tasks; their heads are first taken over sets of
    input tasks and then over the sets.
    """
    keys, order = list(keys), list(order)
    split = _split_hot(df, keys, hot_rows)
    rows = split.light
    if split.hot is not None:
        sets = max(2, int((split.hot_rows / SLICE_ROWS) ** 0.5))
        grouped = split.hot.withColumn("_set", F.spark_partition_id() % sets)
        rows = rows.unionByName(_head(grouped, [*keys, "_set"], order, k).select(*rows.columns))
    return _head(rows, keys, order, k).withColumn(name, F.col("_rank").cast("long") - 1).drop("_rank")


def gather(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    layout: Sequence[Column],
    part_rows: int,
    name: str,
    pick: Callable[[Column], Column] | None = None,
    slice_rows: int = SLICE_ROWS,
    may_split: bool = True,
    place: Sequence[str] = (),
) -> DataFrame:
    """One ordered array per group and part: ``(keys, part, first_pos, name)``, keyed by (keys, part).

    Part ``p`` holds the places from ``first_pos = p * part_rows`` on, so a group of up to ``part_rows`` rows has part 0
    alone. ``may_split=False`` is for callers that have counted already and know that no group is larger.

    ``layout`` are the fields of an item. Their natural ascending order, NULL first, must agree with
    ``order``, so ascending stand-ins come first and carried values last. Layout expressions run after
    the shuffle, which carries the columns they need. ``pick`` turns a sorted item into the one to keep.
    ``place`` names the keys by which rows of unsplit groups may lie already; Spark leaves out a shuffle that changes nothing.
    """
    keys = list(keys)
    parted = _numbered_parts(df, keys, order, part_rows, slice_rows) if may_split else None
    rows, cell = (df, keys) if parted is None else (parted, [*keys, "part"])
    # lists do not shrink before a shuffle, so the plain rows are shuffled and gathered once
    items = F.sort_array(F.collect_list(F.struct(*layout)))
    if place and parted is None:
        placed = rows.repartition(placement(rows.sparkSession), *place)
    else:
        placed = rows.repartition(*cell)
    arrays = placed.groupBy(*cell).agg(items.alias(name))
    part = F.lit(0) if parted is None else F.col("part")
    kept = F.col(name) if pick is None else F.transform(name, pick)
    first = part.cast("long") * part_rows
    return arrays.select(*keys, part.alias("part"), first.alias("first_pos"), kept.alias(name))
