"""Exact texts, times and fan-out on hand-made clinical rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.clinical import at, clinical
from wardline.operators import cohort, embedding, events, rollups
from wardline.plans import exports, training
from wardline.sources.tables import conform, scan_tables


@pytest.fixture(scope="module")
def data(spark):
    return clinical(spark)


@pytest.fixture(scope="module")
def wide(data):
    return {r.icu_stay_id: r for r in exports.wide_export(data).collect()}


@pytest.fixture(scope="module")
def timeline(data):
    return exports.timeline(data).collect()


def test_cohort_has_a_row_per_stay_and_23_columns(data):
    base = exports.base_of(data)
    rows = {r.icu_stay_id: r for r in base.collect()}
    assert len(base.columns) == 23 and sorted(rows) == [1, 2, 3, 4, 5]
    assert rows[1].icu_length_of_stay_in_minutes == 3600
    assert rows[4].icu_length_of_stay_in_minutes == 1  # 90 seconds, truncated
    assert rows[5].patient_gender is None  # no such patient


def test_medications_cover_all_admissions_of_the_patient(wide):
    lines = wide[3].chronology_of_medications.split("\n")
    assert len(lines) == 5
    assert lines[0].startswith("Start Time:|Stop Time:|")  # no start time comes first
    assert "|Drug:Insulin|" in lines[0] and lines[0].endswith("|Administered in ICU:False")


def test_medication_text_and_stay_bounds_are_inclusive(wide):
    lines = wide[1].chronology_of_medications.split("\n")
    assert lines[2] == (
        "Start Time:2150-01-02 00:00:00|Stop Time:2150-01-03 00:00:00|Drug Type:MAIN|Drug:Aspirin|Drug Ontology:ASA81"
        "|Composition Strength of Prescribed Medicine:81mg Tab|Drug Form:TAB|Prescribed Dose for Patient:81  "
        "|Unit Measurement of Prescribed Dose:mg|Amount of Medicine in Single Formulary Dose:1"
        "|Amount of Medicine in Formulary Dose:TAB|Number of Doses per 24 Hours:1|Route of Administration:PO|Administered in ICU:True"
    )
    assert [line.rsplit(":", 1)[1] for line in lines] == ["False", "False", "True", "True", "False"]


def test_stay_without_rows_gets_the_empty_text_or_null(wide):
    row = wide[4]
    assert row.chronology_of_medications.startswith("Start Time:|Stop Time:|Drug Type:|")
    assert row.chronology_of_medications.endswith("|Administered in ICU:False")
    assert row.labevents == (
        "Sample Collection Time:|Sample Received Time:|Value:|Unit of Measurement of Value:|Reference Range Lower:"
        "|Reference Range Upper:|Abnormal Flag:False|Priority:|Comments:"
    )
    assert row.ingredient_events == "Start Time:|End Time:|Input Ingredient:|Rate:N/A|Status Description:"
    assert row.procedure_event_list.startswith("Start Time:|End Time:|Event Recorded Time")
    assert row.diagnosis is None and row.procedure_list is None and row.microbiology_cultures is None


def test_skeleton_can_be_left_out(data):
    rows = {r.icu_stay_id: r for r in exports.wide_export(data, skeleton=False).collect()}
    assert rows[4].labevents is None and rows[1].labevents is not None


def test_diagnoses_are_distinct_sorted_titles(wide):
    assert wide[1].diagnosis == "Anemia\nSepsis" == wide[2].diagnosis


def test_procedure_without_date_is_dropped_and_unknown_code_is_named(wide):
    assert wide[1].procedure_list == "Unknown Procedure (2150-01-02)\nBypass (2150-01-03)"


def test_microbiology_without_store_time_has_no_text(wide):
    lines = wide[1].microbiology_cultures.split("\n")
    # the sample that was never timed has no collection time either
    assert [line.split("Test Name:")[1].split("|")[0] for line in lines] == ["both", "time only"]
    assert lines[0].startswith("Sample Collection Time:2150-01-03 00:00:00|")


def test_lab_and_ingredient_fallbacks(wide):
    labs = wide[1].labevents
    assert "|Value:neg|" in labs and "|Value:7.25|" in labs and "|Abnormal Flag:True|" in labs
    assert "|Reference Range Lower:1|" in labs and 'line one\nsaid "two", three\t' in labs
    assert wide[1].ingredient_events.split("\n") == [
        "Start Time:2150-01-02 05:00:00|End Time:2150-01-02 06:00:00|Input Ingredient:250 |Rate:12.5 mL/hour|Status Description:Running",
        "Start Time:2150-01-02 06:00:00|End Time:|Input Ingredient:|Rate:N/A|Status Description:",
    ]


def test_admission_events_go_to_every_stay_of_the_admission(timeline):
    labs = sorted((r.icu_stay_id, r.event_time) for r in timeline if r.event_type == "labevent")
    assert labs == [(1, at(2, 4)), (1, at(2, 4)), (1, at(9)), (2, at(2, 4)), (2, at(2, 4)), (2, at(9)), (5, at(5, 1))]


def test_relative_time_counts_to_death_or_stay_end(timeline):
    by = {(r.icu_stay_id, r.event_type, r.event_time): r.relative_time_to_final_event for r in timeline}
    assert by[1, "labevent", at(2, 4)] == (2 * 24 + 8) * 60
    assert by[1, "labevent", at(9)] == -(4 * 24 + 12) * 60  # after the end
    assert by[3, "prescription", at(25)] == -(4 * 24 + 6) * 60  # from the death time
    assert by[5, "labevent", at(5, 1)] is None  # died, no death time


def test_event_texts(timeline):
    texts = {r.event_text for r in timeline}
    assert "Drug:Aspirin |Strength:81mg Tab |Form:TAB |Ontology:ASA81 |Dose:81" in texts  # trailing blanks are stripped
    assert any(t and t.endswith('|Clinician Comments:line one\nsaid "two", three') for t in texts)
    micro = [r for r in timeline if r.event_type == "microbiology" and r.icu_stay_id == 1]
    assert sorted(r.event_time for r in micro) == [at(3), at(3), at(3, 10)]
    assert sum(r.event_text is None for r in micro) == 1
    assert not any(r.event_text and "Insulin" in r.event_text for r in timeline)  # no start time, no event


def test_structured_export_orders_events_and_keeps_empty_stays(data):
    rows = {r.icu_stay_id: r for r in exports.structured_export(data).collect()}
    assert rows[4].events is None
    times = [e.event_time for e in rows[1].events]
    assert times == sorted(times) and len(times) == 3 + 1 + 3 + 3 + 2
    tied = [e.event_type for e in rows[1].events if e.event_time == at(3)]
    assert tied == ["microbiology", "microbiology"] and [e.event_text for e in rows[1].events if e.event_time == at(3)][0] is None
    assert {r.icu_stay_id: r.events for r in exports.structured_export(data, empty_array=True).collect()}[4] == []


def test_small_parts_hold_the_same_events(data):
    whole = events.event_flatten(exports.event_arrays_of(data)).collect()
    parts = exports.event_arrays_of(data, part_rows=5)
    assert parts.where("part > 0").count() > 0
    assert sorted(map(str, whole)) == sorted(map(str, events.event_flatten(parts).collect()))
    # flattening gives back the events that went in
    assert sorted(str(r[:1] + r[2:]) for r in whole) == sorted(str(tuple(r)) for r in exports.timeline(data).collect())


def test_attached_parts_are_the_whole_stay(data):
    whole = {r.icu_stay_id: r.events for r in exports.structured_export(data).collect()}
    found = {}
    for r in exports.structured_export(data, part_rows=5).orderBy("icu_stay_id", "part").collect():
        assert r.events is None or len(r.events) <= 5
        found.setdefault(r.icu_stay_id, []).append(r.events)
    assert len(found[1]) > 1 and found[4] == [None]
    assert {k: None if v == [None] else [e for part in v for e in part] for k, v in found.items()} == whole


def test_small_text_parts_join_to_the_whole_text(data, wide):
    texts = {}
    for r in exports.wide_export(data, part_rows=2).orderBy("icu_stay_id", "part").collect():
        for column in ("chronology_of_medications", "labevents", "diagnosis", "procedure_list", "microbiology_cultures"):
            if r[column] is not None:
                texts.setdefault((r.icu_stay_id, column), []).append(r[column])
    assert any(len(t) > 1 for t in texts.values())
    for (stay, column), pieces in texts.items():
        assert "\n".join(pieces) == wide[stay][column]


def halves(texts):
    return np.array([[0.5, -0.5] for _ in texts])


def test_flat_rows_feed_a_training_set(spark, data, tmp_path):
    flat = training.flat_events(exports.base_of(data), exports.timeline(data))
    path = str(tmp_path / "cache")
    embedding.embed_text(spark, flat.where("patient_id = 10"), "event_text", path, halves)
    built = training.prepare_training_set(flat, path, 2, halves)
    dims = built.dims.first()
    kinds = flat.select("event_type").distinct().count()
    assert dims.input_dim == kinds + 2 + 1
    people = {r.patient_id: r for r in built.entities.collect()}
    assert sorted(people) == [10, 12] and all(len(r.static) == dims.static_dim for r in people.values())
    steps = {r.patient_id: r.steps for r in built.sequences.collect()}
    assert len(steps[10]) == flat.where("patient_id = 10").count()
    assert all(s is not None and len(s) == dims.input_dim for r in steps.values() for s in r)
    assert all(x is not None for r in steps.values() for s in r for x in s[:-1])
    scaled = [s[-1] for s in steps[10]]
    assert scaled == sorted(scaled, reverse=True)
    assert steps[12][0][-1] is None  # no death time: the scaled time stays unknown
    # the label is that of the first event in timeline order
    assert people[12].label == 1
    short = training.prepare_training_set(flat, path, 2, halves, max_events=2)
    assert max(len(r.steps) for r in short.sequences.collect()) == 2


def test_an_empty_cache_leaves_no_step_without_a_vector(spark, data, tmp_path):
    flat = training.flat_events(exports.base_of(data), exports.timeline(data))
    built = training.prepare_training_set(flat, str(tmp_path / "cache"))
    steps = [s for r in built.sequences.collect() for s in r.steps]
    width = built.dims.first().input_dim
    assert len(steps) == flat.count() and all(s is not None and len(s) == width for s in steps)


def test_fit_on_train_uses_training_entities_only(spark, data, tmp_path):
    flat = training.flat_events(exports.base_of(data), exports.timeline(data))
    built = training.prepare_training_set(flat, str(tmp_path / "cache"), 2, halves, fit_on="train", shares=(0.0, 0.0))
    assert built.dims.first().input_dim == flat.select("event_type").distinct().count() + 3


def test_scan_tables_checks_the_schema(spark, data, tmp_path):
    for name, df in data.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    back = scan_tables(spark, str(tmp_path))
    assert exports.wide_export(back).count() == 5
    with pytest.raises(ValueError, match="missing columns"):
        conform(data["labevents"].drop("flag"), data["labevents"].schema, "labevents")


def test_keyed_left_join_is_a_left_join(spark, data):
    stays = data["icustays"].unionByName(data["icustays"].limit(1).withColumn("hadm_id", F.lit(None).cast("long")))
    for keys in (["subject_id"], ["subject_id", "hadm_id"], ["subject_id", "hadm_id", "starttime"]):
        left = stays.withColumn("starttime", F.col("intime"))
        right = data["prescriptions"].select(*keys, "drug")
        ours, plain = cohort.keyed_left_join(left, right, keys), left.join(right, keys, "left")
        assert ours.columns == plain.columns and sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))


def test_single_rollup_lists_every_stay_whole_or_in_parts(data, wide):
    for part_rows in (1, 1000):
        rolled = rollups.rollup_diagnoses(data["icustays"], data["diagnoses_icd"], data["d_icd_diagnoses"], part_rows)
        found = {}
        for r in rollups.with_all_stays(data["icustays"], rolled).orderBy("stay_id", "part").collect():
            found.setdefault(r.stay_id, []).append(r.diagnosis)
        assert sorted(found) == [1, 2, 3, 4, 5] and len(found[1]) == (2 if part_rows == 1 else 1)
        assert all("\n".join(texts) == wide[stay].diagnosis if texts != [None] else wide[stay].diagnosis is None for stay, texts in found.items())


def test_culture_texts_have_no_default():
    assert rollups.empty_text(rollups.ROLLUPS["microbiology"]) is None
