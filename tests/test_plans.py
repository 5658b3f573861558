"""Physical plans: what is shuffled, pushed down and pruned."""

import re

import pytest
from pyspark.sql import functions as F

from suite.all_queries import QUERIES
from suite.clinical_view import clinical_tables
from wardline.operators import cohort, events, fits, rollups, sequences, split
from wardline.plans import exports


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_join_and_no_row_at_a_time_python(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_scan_reads_the_needed_columns_only(tables):
    text = plan(cohort.stay_reference(*[clinical_tables(tables)[t] for t in ("icustays", "admissions")]))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert schemas and all("o_totalprice" not in s for s in schemas)


def test_not_null_filter_reaches_the_scan(tables):
    text = plan(cohort.matched_only(tables.orders, tables.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], "l_shipdate"))
    assert "IsNotNull(l_shipdate)" in text and "LeftOuter" not in text


def test_event_array_shuffles_events_once(spark, tables):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = events.canonical_events(
            tables.events.select(F.col("user_id").alias("stay_id"), "ts", F.col("ts").alias("final_time"), "props"), F.col("ts"), "event", F.col("props")
        )
        text = plan(events.event_array(stored))
        assert text.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_texts_are_shuffled_once_on_the_way_to_the_wide_export(spark, tables):
    data = clinical_tables(tables)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = rollups.all_rollups(data)
        alone = sum(plan(t.texts).count("Exchange hashpartitioning") for t in texts)
        whole = plan(exports.wide_export(data)).count("Exchange hashpartitioning")
        base = plan(exports.base_of(data)).count("Exchange hashpartitioning")
        assert whole <= alone + base + 1  # one more, for the cohort rows
        assert "Union" not in plan(exports.wide_export(data))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_row_shuffles_a_row_per_entity_and_task(tables):
    text = plan(sequences.first_row_per_entity(tables.events, "user_id", ["event_id", "value"], [F.col("ts"), F.col("event_id")]))
    assert "Window" not in text and "partial_min_by" in text and text.count("Exchange") == 1


def test_fit_is_applied_without_reading_its_input_again(tables):
    fitted = fits.fit(tables.events, ["event_type"], ["value"])
    text = plan(tables.events.select(fits.scaled_column(fitted, "value"), fits.one_hot_column(fitted, "event_type")))
    assert "Join" not in text and "Subquery" in text
    assert text.count("events.parquet") == 1


def test_static_vector_of_nine_categories_reads_its_input_once(tables):
    columns = [f"c{i}" for i in range(9)]
    df = tables.customer.select("c_acctbal", *[F.col("c_mktsegment").alias(c) for c in columns])
    fitted = fits.fit(df, columns, ["c_acctbal"], fits.UNKNOWN)
    text = plan(df.select(fits.static_vector(fitted, columns, "c_acctbal")))
    assert text.count("customer.parquet") == 1


def test_second_embedding_run_moves_no_text(spark, tables, tmp_path):
    from wardline.operators.embedding import embed_text

    path = str(tmp_path / "cache")
    embed_text(spark, tables.documents, "text", path)
    text = plan(embed_text(spark, tables.documents, "text", path))
    assert "SortAggregate" not in text and "documents.parquet" not in text


def test_sample_needs_no_shuffle(tables):
    assert "Exchange" not in plan(split.sample_fraction(tables.events, "event_id", 0.1))
