"""Order inside hot groups gives the same answer as a plain window, whatever the skew."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.operators import ordered


def skewed(spark):
    """One key with most rows, all at one instant and many of them equal; a NULL key; small keys."""
    rows = [("hot", 5, f"t{i % 4}", float(i % 11)) for i in range(90)]
    rows += [("warm", i % 6, "x", float(50 - i)) for i in range(40)]
    rows += [(None, None if i % 3 == 0 else i, "n", float(i)) for i in range(25)]
    rows += [(f"cold{i}", i, "c", None if i % 2 else 1.0) for i in range(30)]
    return spark.createDataFrame(rows, "k string, at int, tag string, v double").repartition(5)


def order():
    return [F.col("at").asc_nulls_first(), F.col("tag").asc(), F.col("v").asc_nulls_first()]


def expected(spark):
    groups = defaultdict(list)
    for r in skewed(spark).collect():
        groups[r.k].append(((r["at"] is not None, r["at"] or 0), r.tag, (r.v is not None, r.v or 0.0), r))
    return {k: [x[3] for x in sorted(g, key=lambda x: x[:3])] for k, g in groups.items()}


@pytest.mark.parametrize("hot_rows", [None, 10, 1000])
def test_positions_of_skewed_groups(spark, hot_rows):
    placed = ordered.with_position(skewed(spark), ["k"], order(), hot_rows=hot_rows, slice_rows=8).collect()
    found = defaultdict(dict)
    for r in placed:
        assert r.pos not in found[r.k]
        found[r.k][r.pos] = (r["at"], r.tag, r.v)
    for key, rows in expected(spark).items():
        assert [found[key][i] for i in range(len(rows))] == [(r["at"], r.tag, r.v) for r in rows]


def test_hot_group_is_cut_into_bounded_slices(spark):
    split = ordered._split_hot(skewed(spark), ["k"], 10)
    assert split.hot_rows == 90 + 40 + 25
    sizes = ordered._slices(split, ["k"], order(), 8).groupBy("_slice").count().collect()
    # the 90 rows at one instant, most of them equal, do not end in one slice
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 40


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_parts_are_consecutive_and_whole(spark, part_rows):
    layout = [F.col("at"), F.col("tag"), F.col("v")]
    arrays = ordered.gather(skewed(spark), ["k"], order(), layout, part_rows, "items", slice_rows=8).collect()
    found = defaultdict(dict)
    for r in arrays:
        assert len(r["items"]) <= part_rows
        found[r.k][r.part] = [tuple(i) for i in r["items"]]
    for key, rows in expected(spark).items():
        joined = [i for part in sorted(found[key]) for i in found[key][part]]
        assert joined == [(r["at"], r.tag, r.v) for r in rows]
        assert sorted(found[key]) == list(range(-(-len(rows) // part_rows)))


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_running_minimum(spark, hot_rows):
    numbered = ordered.with_position(skewed(spark), ["k"], order(), hot_rows=None)
    found = ordered.running_min(numbered, ["k"], [F.col("pos")], "v", "low", hot_rows=hot_rows, slice_rows=8).collect()
    found = {(r.k, r.pos): r.low for r in found}
    for key, rows in expected(spark).items():
        low = None
        for i, r in enumerate(rows):
            assert found[key, i] == low
            low = r.v if low is None else low if r.v is None else min(low, r.v)


def test_crowded_names_the_tables_with_a_large_key(spark):
    df = skewed(spark)
    assert ordered.crowded(50, {"a": (df, ["k"]), "b": (df, ["k", "v"])}) == {"a"}


@pytest.mark.parametrize("hot_rows", [None, 10, 1000])
def test_head_k(spark, hot_rows):
    kept = ordered.head_k(skewed(spark), ["k"], order(), 3, hot_rows=hot_rows).collect()
    assert {r.pos for r in kept} == {0, 1, 2}
    for key, rows in expected(spark).items():
        ours = sorted((r for r in kept if r.k == key), key=lambda r: r.pos)
        assert [(r["at"], r.tag, r.v) for r in ours] == [(r["at"], r.tag, r.v) for r in rows[:3]]


def test_head_k_limits_groups_before_the_shuffle(spark):
    plan = ordered.head_k(skewed(spark), ["k"], order(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
