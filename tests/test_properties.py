"""Properties that hold for any input, and edge values."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import scalars, text, vectors
from wardline.operators import attention, fits, scoring, sequences, split
from wardline.session import SETTINGS


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_minutes_truncate_to_zero(spark):
    def minutes(a, b):
        return one(spark, scalars.minutes_between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")))[0]

    assert minutes("2024-01-01 00:00:59", "2024-01-01 00:01:30") == 0
    assert minutes("2024-01-01 00:01:30", "2024-01-01 00:00:00") == -1
    assert minutes("2024-03-09 12:00:00", "2024-03-11 12:00:00") == 2880  # no daylight saving in between


def test_minutes_do_not_depend_on_the_time_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        gap = scalars.minutes_between(F.lit("2024-03-09 12:00:00").cast("timestamp_ntz"), F.lit("2024-03-11 12:00:00").cast("timestamp_ntz"))
        assert one(spark, gap)[0] == 2880
    finally:
        spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])


@pytest.mark.parametrize("raw,clean", [("\t a b \n", "a b"), (" x　", "x"), ("", ""), ("  ", ""), ("a\n", "a"), (None, None)])
def test_strip_white(spark, raw, clean):
    assert one(spark, text.strip_white(F.lit(raw).cast("string")))[0] == clean


@pytest.mark.parametrize("number,shown", [
    (1.0, "1"), (0.0, "0"), (-3.0, "-3"), (2.5, "2.5"), (0.00015, "0.00015"), (1.5e-5, "1.5e-05"), (1e7, "10000000"),
    (12345678.5, "12345678.5"), (1e15, "1e+15"), (1e20, "1e+20"), (-1.5e300, "-1.5e+300"), (float("nan"), "nan"),
    (float("-inf"), "-inf"), (None, None),
])
def test_num_to_text(spark, number, shown):
    assert one(spark, text.num_to_text(F.lit(number).cast("double")))[0] == shown


def test_loss_is_clamped_and_ignores_missing_probabilities(spark):
    rows = spark.createDataFrame([(0.0, 1), (1.0, 1), (0.5, 0), (None, 1)], "p double, y int")
    assert [r[0] for r in rows.select(scalars.cross_entropy(F.col("p"), F.col("y"))).collect()] == [100.0, 0.0, pytest.approx(math.log(2)), None]


def test_natural_log_at_and_below_zero(spark):
    row = one(spark, *[scalars.natural_log(F.lit(x).cast("double")).alias(n) for n, x in (("a", 1.0), ("b", 0.0), ("c", -1.0), ("d", None))])
    assert row.a == 0.0 and row.b == float("-inf") and math.isnan(row.c) and row.d is None


def test_waves(spark):
    row = one(spark, vectors.time_waves(F.lit(0.7), 16).alias("t"), vectors.position_waves(F.lit(3), 8).alias("p"))
    assert row.t == pytest.approx([math.cos(0.7 / 10000 ** (i / 16)) if i % 2 else math.sin(0.7 / 10000 ** (i / 16)) for i in range(16)])
    assert row.p == pytest.approx([(math.cos if i % 2 else math.sin)(3 * math.exp(-(i - i % 2) * math.log(10000) / 8)) for i in range(8)])


def test_one_hot_of_unknown_and_null_is_zero(spark):
    source = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "c string")
    fit, filled_fit = fits.fit(source, ["c"]), fits.fit(source, ["c"], impute=fits.UNKNOWN)
    df = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "c string")
    code = fits.one_hot_column(fit, "c").alias("v")
    assert {r.c: r.v for r in df.select("c", code).collect()} == {"a": [1, 0], "b": [0, 1], "zz": [0, 0], None: [0, 0]}
    filled = {r.c: r.v for r in df.select("c", fits.one_hot_column(filled_fit, "c", fits.UNKNOWN).alias("v")).collect()}
    assert filled[None] == [1, 0, 0] and filled["zz"] == [0, 0, 0]  # 'Unknown' sorts before 'a'


def test_any_number_of_categories(spark):
    df = spark.range(10_001).select(F.format_string("c%05d", "id").alias("c"))
    fitted = fits.fit(df, ["c"])
    assert df.select(fits.width(fitted, ["c"]).alias("w")).first().w == 10_001
    found = fits.slots(df.union(spark.createDataFrame([("zz",), (None,)], "c string")), fitted, "c", "slot").collect()
    assert {r.c: r.slot for r in found} == {**{f"c{i:05d}": i for i in range(10_001)}, "zz": None, None: None}


def test_fit_of_several_columns_in_one_pass(spark):
    df = spark.createDataFrame([("a", "x", 1.0, None), ("b", None, None, 5.0), ("a", "x", 3.0, float("nan"))], "c string, d string, u double, v double")
    rows = {(r.column, r.category): r for r in fits.fit(df, ["c", "d"], ["u", "v"], fits.UNKNOWN).collect()}
    assert {k: r.slot for k, r in rows.items() if k[1]} == {("c", "a"): 0, ("c", "b"): 1, ("d", "Unknown"): 0, ("d", "x"): 1}
    assert (rows["u", None].mean, rows["u", None].deviation) == (2.0, 1.0)
    assert rows["u", None].filled_deviation == pytest.approx(math.sqrt(2 / 3))
    assert (rows["v", None].mean, rows["v", None].filled_deviation) == (5.0, 0.0)


def test_scaling(spark, tables):
    df = tables.customer
    fitted = fits.fit(df, numbers=["c_acctbal"])
    z = df.select(fits.scaled_column(fitted, "c_acctbal").alias("z")).agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert z.m == pytest.approx(0, abs=1e-9) and z.s == pytest.approx(1)
    odd = spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "x double")
    odd_fit = fits.fit(odd, numbers=["x"])
    assert [r[0] for r in odd.select(fits.scaled_column(odd_fit, "x")).collect()][:3] == [0.0, 0.0, None]
    assert [r[0] for r in odd.select(fits.scaled_column(odd_fit, "x", mean_fill=True)).collect()] == [0.0] * 4


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_split_covers_every_key_once_with_rounded_shares(spark, hot_rows):
    df = spark.range(103).select("id", F.when(F.col("id") % 9 == 0, 1).otherwise(0).alias("y")).unionAll(
        spark.createDataFrame([(1000, 2)], "id long, y int")
    )
    rows = split.stratified_split(df, "id", "y", hot_rows=hot_rows).collect()
    assert len(rows) == len({r.id for r in rows}) == 104
    for label in (0, 1, 2):
        n = sum(r.y == label for r in rows)
        test = math.floor(n * 0.2 + 0.5)
        validation = math.floor((n - test) * 0.2 + 0.5)
        counts = [sum(r.y == label and r.split == s for r in rows) for s in ("test", "validation", "train")]
        assert counts == [test, validation, n - test - validation]
    again = split.stratified_split(df.repartition(7), "id", "y", hot_rows=hot_rows).collect()
    assert sorted(rows) == sorted(again)


def test_rows_without_a_label_are_training_rows(spark):
    df = spark.createDataFrame([(i, None if i < 3 else 1) for i in range(13)], "id int, y int")
    found = {r.id: r.split for r in split.stratified_split(df, "id", "y").collect()}
    assert [found[i] for i in range(3)] == ["train"] * 3 and sorted(found.values()).count("test") == 2


def test_datasets_are_read_by_split(spark, tmp_path):
    rows = split.stratified_split(spark.range(50).withColumn("y", F.lit(1)), "id", "y")
    split.write_datasets(rows, str(tmp_path / "sets"))
    back = spark.read.parquet(str(tmp_path / "sets"))
    assert [split.dataset_of(back, s).count() for s in ("train", "validation", "test")] == [32, 8, 10]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("aab"), st.floats(-900, 900)), min_size=1, max_size=40))
def test_softmax_weights(spark, rows):
    df = spark.createDataFrame([(k, float(s), i) for i, (k, s) in enumerate(rows)], "k string, s double, i int")
    found = {r.i: r.weight for r in attention.softmax_pool_weights(df, ["k"], "s").collect()}
    assert len(found) == len(rows)
    for key in {k for k, _ in rows}:
        scores = {i: s for i, (k, s) in enumerate(rows) if k == key}
        top = max(scores.values())
        total = sum(math.exp(s - top) for s in scores.values())
        for i, s in scores.items():
            assert found[i] == pytest.approx(math.exp(s - top) / total, abs=1e-12)


def test_attention_pooling_of_distant_scores(spark):
    rows = [(1, [500.0, 1.0]), (1, [-500.0, 9.0]), (1, [499.0, 3.0]), (2, [0.0, 4.0])]
    df = spark.createDataFrame(rows, "e int, v array<double>")
    pooled = {r.e: r.pooled for r in attention.softmax_attention_pool(df, "e", "v", F.array(F.lit(1.0), F.lit(0.0)), 1).collect()}
    a, b = 1 / (1 + math.exp(-1)), 1 / (1 + math.exp(1))
    assert pooled[1] == pytest.approx([500 * a + 499 * b, 1 * a + 3 * b]) and pooled[2] == [0.0, 4.0]


def test_histogram_lists_all_bins_and_keeps_the_top_edge(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,), (None,)], "w double")
    assert [r.n for r in attention.weight_histogram(df, "w", 4).orderBy("bin").collect()] == [1, 0, 1, 2]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "w double")
    assert [r.n for r in attention.weight_histogram(flat, "w", 3).orderBy("bin").collect()] == [0, 2, 0]


def test_gradients_add_up_to_the_change_of_score(spark):
    w, bias = [0.5, -1.0, 2.0], 0.3
    weights = F.array(*[F.lit(x) for x in w])
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, [2.0, 1.0, 0.0])], "i int, v array<double>")
    sums = {r.i: r.s for r in scoring.integrated_gradients(df, "i", "v", weights, bias).groupBy("i").agg(F.sum("value").alias("s")).collect()}
    for row in df.collect():
        z = sum(a * b for a, b in zip(row.v, w)) + bias
        assert sums[row.i] == pytest.approx(1 / (1 + math.exp(-z)) - 1 / (1 + math.exp(-bias)), abs=1e-9)


def test_padding_and_mask(spark):
    df = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 1.0), (0, 2, 1, 2.0), (0, 2, 2, 3.0), (1, 3, 0, 5.0)], "b int, e int, pos long, v double")
    rows = sequences.pad_steps(df, "b", "e", {"v": F.lit(0.0)}).collect()
    assert sorted((r.e, r.pos, r.v, r.real) for r in rows) == [
        (1, 0, 1.0, True), (1, 1, 0.0, False), (1, 2, 0.0, False), (2, 0, 1.0, True), (2, 1, 2.0, True), (2, 2, 3.0, True), (3, 0, 5.0, True),
    ]


def test_padding_of_a_sequence_longer_than_a_part(spark):
    n = sequences.STEP_PART_ROWS + 7
    df = spark.range(n).select(F.lit(0).alias("b"), F.lit(1).alias("e"), F.col("id").alias("pos"), F.lit(2.0).alias("v"))
    rows = sequences.pad_steps(df.union(spark.createDataFrame([(0, 9, 0, 4.0)], "b int, e int, pos long, v double")), "b", "e", {"v": F.lit(0.0)})
    assert {(r.e, r.n, r.real, r.last) for r in rows.groupBy("e").agg(F.count("*").alias("n"), F.sum(F.col("real").cast("int")).alias("real"), F.max("pos").alias("last")).collect()} == {
        (1, n, n, n - 1), (9, n, 1, n - 1)
    }


def test_label_of_an_entity_is_that_of_its_first_row(spark):
    df = spark.createDataFrame([(1, 10, 0), (1, 5, 1), (2, 3, 1), (2, None, 0)], "e int, t int, y int")
    summary = sequences.cohort_summary(df, "e", F.col("y"), sequences.timeline_sort_values("t", ["y"])).first()
    assert tuple(summary) == (2, 1, 0.5, 2.0)


def test_split_of_many_labels(spark):
    df = spark.range(10_010).select("id", (F.col("id") % 1_001).cast("int").alias("y"))
    counts = {tuple(r) for r in split.stratified_split(df, "id", "y").groupBy("y").pivot("split", ["test", "validation", "train"]).count().drop("y").distinct().collect()}
    assert counts == {(2, 2, 6)}


def test_weights_of_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 2.0)], "k string, s double")
    assert sorted(r.weight for r in attention.softmax_pool_weights(df, ["k"], "s").collect()) == [0.5, 0.5, 1.0]


def test_baseline_beats_the_constant_predictor(spark, tables):
    df = tables.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") > 4).cast("int").alias("y"))
    rows = split.stratified_split(df, "vec_id", "y")
    train = split.dataset_of(rows, "train")
    model = scoring.mortality_baseline(train, "v", "y")
    scored = scoring.score_baseline(model, rows, "v")
    assert scored.where("probability < 0 or probability > 1").count() == 0
    rate = train.agg(F.avg("y")).first()[0]
    constant = -(rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    losses = {r.split: r.row_mean for r in scoring.evaluate_splits(scored, "probability", "y").collect()}
    assert set(losses) == {"train", "validation", "test"} and losses["train"] < constant


def test_a_hidden_layer_learns_what_a_linear_scorer_cannot(spark):
    rows = spark.range(400).selectExpr("id", "id % 2 AS a", "floor(id / 2) % 2 AS b", "id % 7 AS noise").selectExpr(
        "id", "array(cast(a AS double) * 100, cast(b AS double), cast(noise AS double), 5.0D) AS x", "cast(a <> b AS int) AS y"
    )
    awkward = rows.unionByName(spark.sql("SELECT 1000L AS id, cast(NULL AS array<double>) AS x, 1 AS y UNION ALL SELECT 1001L, array(0D, 0D, 0D, 5D), NULL"))
    fitted = scoring.two_layer_baseline(awkward, "x", "y", units=6, max_iter=300, seed=3)
    score, gradient = scoring.two_layer(*fitted)
    loss = lambda p: F.avg(scalars.cross_entropy(p, F.col("y")))
    assert rows.agg(loss(score(F.col("x")))).first()[0] < 0.1
    model = scoring.mortality_baseline(rows, "x", "y")
    assert scoring.score_baseline(model, rows, "x").agg(loss(F.col("probability"))).first()[0] > 0.68
    # along the path the attributions add up to the change of the score, also for the trained scorer
    few = rows.where("id < 8")
    sums = {r.id: r.total for r in scoring.path_gradients(few, "id", "x", gradient, 4000).groupBy("id").agg(F.sum("value").alias("total")).collect()}
    zero = F.array(*[F.lit(0.0)] * 4)
    for r in few.select("id", (score(F.col("x")) - score(zero)).alias("change")).collect():
        assert sums[r.id] == pytest.approx(r.change, abs=1e-3)
    assert all(row[3] == 0 for row in fitted[0])  # an input that does not vary


def test_best_epoch_ignores_missing_losses(spark):
    history = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, None), (1, 3, 0.5), (1, 4, 0.4)], "run int, epoch int, loss double")
    assert tuple(scoring.best_epoch(history, "run", "epoch", "loss").first()) == (1, 4, 0.4)
    marked = scoring.running_best(history, "run", "epoch", "loss").orderBy("epoch").collect()
    assert [r.is_best for r in marked] == [True, True, False, False, True]


def test_keep_last_takes_the_latest_events(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)], "e int, minutes int")
    kept = sequences.head_k_per_entity(df, "e", [F.col("minutes").desc()], 2, keep="last", latest=[F.col("minutes").asc()])
    assert sorted(r.minutes for r in kept.collect()) == [0, 1]


def test_sample_is_stable_across_layouts(spark):
    df = spark.range(2000)
    a = {r.id for r in split.sample_fraction(df, "id", 0.1).collect()}
    b = {r.id for r in split.sample_fraction(df.repartition(9), "id", 0.1).collect()}
    assert a == b and 140 < len(a) < 260


def test_path_gradients_add_up_to_the_score(spark):
    import random

    rng = random.Random(3)
    hidden = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(3)]
    score, gradient = scoring.two_layer(hidden, [0.2, -0.4, 0.0], [1.0, -2.0, 0.5], -0.1)
    df = spark.createDataFrame([(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(20)] + [(99, None)], "i int, v array<double>")
    found = scoring.path_gradients(df, "i", "v", gradient, steps=64).groupBy("i").agg(F.sum("value").alias("sum"))
    zero = F.array(*[F.lit(0.0)] * 5)
    wanted = {r.i: r.d for r in df.where("i < 99").select("i", (score(F.col("v")) - score(zero)).alias("d")).collect()}
    got = {r.i: r["sum"] for r in found.collect()}
    assert set(got) == set(wanted) and all(abs(got[i] - wanted[i]) < 1e-3 for i in wanted)


def test_training_history_goes_down_and_misses_what_is_missing(spark):
    rows = [(i, "train" if i % 4 else "test", [1.0 if i % 3 else -1.0, (i % 5) / 5], int(i % 3 > 0)) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, "train", None, 1), (901, "train", [0.0, 0.0], None)], "i int, split string, x array<double>, y int")
    history, weights, bias = scoring.training_history(df, "x", "y", epochs=6, rate=1.0)
    losses = history.orderBy("epoch").collect()
    assert [r.epoch for r in losses] == list(range(7)) and all(r.validation is None for r in losses)
    assert all(b.train < a.train and b.test < a.test for a, b in zip(losses, losses[1:]))
    assert abs(losses[0].train - 0.6931471805599453) < 1e-12 and weights[0] > 0.5 and len(weights) == 2
    empty, weights, bias = scoring.training_history(df.limit(0), "x", "y", epochs=1)
    assert [tuple(r) for r in empty.orderBy("epoch").collect()] == [(0, None, None, None), (1, None, None, None)] and (weights, bias) == ([], 0.0)
