"""Schemas of the twelve clinical tables and of the flat event file."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Column names of the public clinical tables this library reads.
CLINICAL = {
    "icustays": "subject_id bigint, hadm_id bigint, stay_id bigint, first_careunit string, last_careunit string, "
    "intime timestamp_ntz, outtime timestamp_ntz, los double",
    "patients": "subject_id bigint, gender string, anchor_age int, anchor_year int, anchor_year_group string, dod date",
    "admissions": "hadm_id bigint, hospital_expire_flag int, admission_type string, admission_location string, "
    "discharge_location string, insurance string, language string, marital_status string, race string, "
    "deathtime timestamp_ntz",
    "prescriptions": "subject_id bigint, hadm_id bigint, starttime timestamp_ntz, stoptime timestamp_ntz, "
    "drug_type string, drug string, formulary_drug_cd string, prod_strength string, form_rx string, "
    "dose_val_rx string, dose_unit_rx string, form_val_disp string, form_unit_disp string, "
    "doses_per_24_hrs double, route string",
    "diagnoses_icd": "hadm_id bigint, icd_code string, icd_version int",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
    "procedures_icd": "subject_id bigint, hadm_id bigint, icd_code string, icd_version int, chartdate date",
    "d_icd_procedures": "icd_code string, icd_version int, long_title string",
    "procedureevents": "stay_id bigint, subject_id bigint, hadm_id bigint, starttime timestamp_ntz, "
    "endtime timestamp_ntz, storetime timestamp_ntz, value double, patientweight double, valueuom string, "
    "location string, locationcategory string, statusdescription string",
    "microbiologyevents": "subject_id bigint, hadm_id bigint, chartdate timestamp_ntz, charttime timestamp_ntz, "
    "storedate timestamp_ntz, storetime timestamp_ntz, spec_type_desc string, test_name string, org_name string, "
    "ab_name string, interpretation string",
    "labevents": "subject_id bigint, hadm_id bigint, charttime timestamp_ntz, storetime timestamp_ntz, value string, "
    "valuenum double, ref_range_lower double, ref_range_upper double, valueuom string, flag string, "
    "priority string, comments string",
    "ingredientevents": "subject_id bigint, stay_id bigint, hadm_id bigint, starttime timestamp_ntz, "
    "endtime timestamp_ntz, amount double, rate double, amountuom string, rateuom string, statusdescription string",
}

# Static features in the order they enter the static vector.
STATIC_CATEGORIES = [
    "patient_gender",
    "first_icu_careunit",
    "last_icu_careunit",
    "admission_type",
    "admission_location",
    "discharge_location",
    "insurance",
    "marital_status",
    "patient_race",
]
STATIC_NUMBER = "patient_age"

FLAT_EVENTS = (
    "patient_id bigint, event_time timestamp_ntz, event_type string, event_text string, "
    "relative_time_to_final_event bigint, patient_expired_in_hospital int, "
    + ", ".join(f"{c} string" for c in STATIC_CATEGORIES)
    + f", {STATIC_NUMBER} double"
)


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(CLINICAL[table])


def column_types(table: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema_of(table)}
