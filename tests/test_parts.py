"""The exports of the given tables are the same whether stays are split into parts or not."""

import pytest
from pyspark.sql import functions as F

from suite.clinical_view import clinical_tables
from wardline.operators import events
from wardline.plans import exports

TEXTS = ["chronology_of_medications", "diagnosis", "procedure_list", "microbiology_cultures", "labevents"]


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    from suite.registry import Tables

    return {name: df.cache() for name, df in clinical_tables(Tables(spark, sf_dir)).items()}


def test_events_in_parts(data):
    whole = events.event_flatten(exports.event_arrays_of(data))
    arrays = exports.event_arrays_of(data, part_rows=15)
    assert arrays.agg(F.max("part")).first()[0] >= 2 and arrays.agg(F.max(F.size("events"))).first()[0] == 15
    parts = events.event_flatten(arrays)
    assert whole.count() == parts.count() and whole.exceptAll(parts).count() == 0


def test_texts_in_parts(data):
    def joined(df):
        by_part = F.sort_array(F.collect_list(F.struct("part", *TEXTS)))
        rows = df.groupBy("icu_stay_id").agg(by_part.alias("p"), F.count(F.lit(1)).alias("parts"))
        texts = [F.array_join(F.col(f"p.{c}"), "\n").alias(c) for c in TEXTS]
        return rows.select("icu_stay_id", *texts)

    split = exports.wide_export(data, part_rows=20)
    assert split.agg(F.max("part")).first()[0] >= 2
    assert joined(exports.wide_export(data)).exceptAll(joined(split)).count() == 0
    assert split.where("part = 0").count() == data["icustays"].count()
