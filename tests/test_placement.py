"""Rows meet by patient (or by stay) once: what is long is not shuffled, and what patients share is still found."""

import pytest

from suite.all_queries import QUERIES
from suite.clinical_view import clinical_tables
from tests.clinical import clinical
from wardline.operators import cohort, events, rollups
from wardline.plans import exports
from wardline.sources.schemas import schema_of

LINES = ["procedureevents", "microbiologyevents", "ingredientevents"]


@pytest.fixture()
def large(spark):
    """Plans as for tables that are too large to be sent to every task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def with_stays(spark, data, *rows):
    more = spark.createDataFrame([tuple(r.get(f) for f in schema_of("icustays").names) for r in rows], schema_of("icustays"))
    return data | {"icustays": data["icustays"].unionByName(more)}


def test_event_texts_are_not_shuffled(tables, large):
    arrays = plan(exports.event_arrays_of(clinical_tables(tables)))
    assert "hashpartitioning(icu_stay_id" not in arrays
    export = plan(exports.structured_export(clinical_tables(tables)))
    assert "hashpartitioning(icu_stay_id" not in export and "hashpartitioning(stay_id" not in export


def test_common_lines_are_joined_once(tables, large):
    data = clinical_tables(tables, [s.table for s in events.SOURCES.values()])
    assert all("Exchange" not in plan(data[name]) and "Join" not in plan(data[name]) for name in LINES)
    assert "Exchange" not in plan(exports.timeline(data)) and "Exchange" not in plan(exports.event_arrays_of(data))
    plain = clinical_tables(tables)
    for name in LINES + ["prescriptions", "labevents"]:
        assert data[name].schema == plain[name].schema
        assert data[name].count() == plain[name].count() and data[name].exceptAll(plain[name]).isEmpty()


def test_wide_texts_are_not_shuffled(tables, large):
    text = plan(exports.wide_export(clinical_tables(tables)))
    assert "hashpartitioning(stay_id" not in text and "hashpartitioning(icu_stay_id" not in text


def test_items_of_a_stay_are_shuffled_once(spark, sf_dir, large):
    # lines, orders of the lines, stays to be joined and stays to be kept
    assert plan(QUERIES["rollup_procedure_events"](spark, sf_dir)).count("Exchange hashpartitioning") <= 4


def test_owned_stays(spark):
    def stays(*rows):
        return spark.createDataFrame(rows, "subject_id bigint, stay_id bigint")

    assert cohort.owned(stays((1, 1), (1, 1), (1, 2), (2, 3))) and cohort.owned(stays((1, 1), (1, None)))
    assert not cohort.owned(stays((1, 1), (2, 1))) and not cohort.owned(stays((1, 1), (None, 1)))
    assert cohort.owned(stays((1, 1), (None, 2))) and not cohort.owned(stays((1, 1), (None, 2)), known=True)


def test_patients_who_share_a_stay_number(spark):
    data = clinical(spark)
    shared = with_stays(spark, data, dict(subject_id=12, hadm_id=120, stay_id=1), dict(subject_id=None, hadm_id=100, stay_id=7))
    arrays = exports.event_arrays_of(shared)
    assert arrays.count() == arrays.select("icu_stay_id").distinct().count()
    flat = events.event_flatten(arrays).drop("pos")
    assert sorted(map(str, flat.collect())) == sorted(str(r) for r in exports.timeline(shared).collect())
    export = exports.structured_export(shared).where("icu_stay_id = 1").collect()
    assert len(export) == 2 and export[0].events == export[1].events
    wide = {(r.patient_id, r.icu_stay_id): r for r in exports.wide_export(shared).collect()}
    assert wide[10, 1].labevents == wide[12, 1].labevents and wide[None, 7].diagnosis == wide[10, 2].diagnosis is not None


def test_rollups_by_patient_are_those_by_stay(spark):
    data = clinical(spark)
    stays = data["icustays"]
    again = with_stays(spark, data, dict(subject_id=10, hadm_id=101, stay_id=1))  # a stay of two admissions
    for tables in (data, again):
        found = rollups.all_rollups(tables)
        assert all("subject_id" in r.texts.columns for r in found)
        stays = tables["icustays"]
        for name, r in zip(["medications", "diagnoses", "procedures", "procedure_events", "microbiology", "labs", "ingredients"], found, strict=True):
            if name == "diagnoses":
                plain = rollups.rollup_diagnoses(stays, tables["diagnoses_icd"], tables["d_icd_diagnoses"])
            elif name == "procedures":
                plain = rollups.rollup_procedures(stays, tables["procedures_icd"], tables["d_icd_procedures"])
            else:
                rollup = rollups.ROLLUPS[name]
                plain = rollups.field_rollup(rollup, tables[rollup.table], stays)
            assert sorted(map(str, r.texts.drop("subject_id").collect())) == sorted(map(str, plain.texts.collect())), name
