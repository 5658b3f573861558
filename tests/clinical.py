"""Hand-made clinical rows that reach the cases the generated tables do not."""

from datetime import date, datetime

from wardline.sources.schemas import CLINICAL, schema_of


def at(day, hour=0, minute=0, second=0):
    return datetime(2150, 1, day, hour, minute, second)


ROWS = {
    # stays 1 and 2 share an admission; patient 10 has two admissions; stay 4 has no events; 5 died without a time
    "icustays": [
        dict(subject_id=10, hadm_id=100, stay_id=1, first_careunit="MICU", last_careunit="MICU", intime=at(2), outtime=at(4, 12), los=2.5),
        dict(subject_id=10, hadm_id=100, stay_id=2, first_careunit="SICU", last_careunit="MICU", intime=at(6), outtime=at(8), los=2.0),
        dict(subject_id=10, hadm_id=101, stay_id=3, first_careunit="CCU", last_careunit="CCU", intime=at(20), outtime=at(21), los=1.0),
        dict(subject_id=11, hadm_id=110, stay_id=4, first_careunit="CCU", last_careunit=None, intime=at(3), outtime=at(3, 0, 1, 30), los=0.0),
        dict(subject_id=12, hadm_id=120, stay_id=5, first_careunit="CCU", last_careunit="CCU", intime=at(5), outtime=at(6), los=1.0),
    ],
    "patients": [
        dict(subject_id=10, gender="F", anchor_age=60, anchor_year=2150, anchor_year_group="2008 - 2010", dod=date(2150, 1, 21)),
        dict(subject_id=11, gender="M", anchor_age=None, anchor_year=2151, anchor_year_group=None, dod=None),
    ],
    "admissions": [
        dict(hadm_id=100, hospital_expire_flag=0, admission_type="URGENT", race="WHITE", insurance="Other", language="en"),
        dict(hadm_id=101, hospital_expire_flag=1, admission_type="URGENT", deathtime=at(20, 18)),
        dict(hadm_id=110, hospital_expire_flag=0, admission_type="EW EMER."),
        dict(hadm_id=120, hospital_expire_flag=1, admission_type="EW EMER."),
    ],
    "prescriptions": [
        dict(subject_id=10, hadm_id=100, starttime=at(2), stoptime=at(3), drug_type="MAIN", drug="Aspirin", prod_strength="81mg Tab",
             form_rx="TAB", formulary_drug_cd="ASA81", dose_val_rx="81  ", dose_unit_rx="mg", form_val_disp="1", form_unit_disp="TAB",
             doses_per_24_hrs=1.0, route="PO"),
        dict(subject_id=10, hadm_id=100, starttime=at(4, 12), drug="Heparin"),
        dict(subject_id=10, hadm_id=100, starttime=None, drug="Insulin"),
        dict(subject_id=10, hadm_id=101, starttime=at(25), drug="Late"),
        dict(subject_id=10, hadm_id=100, starttime=at(1), drug="Early"),
    ],
    "diagnoses_icd": [dict(hadm_id=100, icd_code=c, icd_version=9) for c in ("A", "B", "C", "zz")],
    "d_icd_diagnoses": [dict(icd_code="A", icd_version=9, long_title="Sepsis"), dict(icd_code="B", icd_version=9, long_title="Sepsis"),
                        dict(icd_code="C", icd_version=9, long_title="Anemia"), dict(icd_code="zz", icd_version=10, long_title="Other")],
    "procedures_icd": [
        dict(subject_id=10, hadm_id=100, icd_code="P", icd_version=9, chartdate=date(2150, 1, 3)),
        dict(subject_id=10, hadm_id=100, icd_code="Q", icd_version=9, chartdate=date(2150, 1, 2)),
        dict(subject_id=10, hadm_id=100, icd_code="P", icd_version=9, chartdate=None),
    ],
    "d_icd_procedures": [dict(icd_code="P", icd_version=9, long_title="Bypass")],
    "procedureevents": [
        dict(stay_id=1, subject_id=10, hadm_id=100, starttime=at(2, 1), endtime=at(2, 2), storetime=at(2, 3), value=60.0,
             patientweight=70.5, valueuom="min", location="Arm", locationcategory="Left", statusdescription="FinishedRunning"),
    ],
    "microbiologyevents": [
        dict(subject_id=10, hadm_id=100, chartdate=at(3), charttime=at(3, 9), storedate=None, storetime=None, test_name="none stored"),
        dict(subject_id=10, hadm_id=100, chartdate=at(3), charttime=at(3, 9), storedate=at(5), storetime=at(5, 1), test_name="both"),
        dict(subject_id=10, hadm_id=100, chartdate=None, charttime=at(3, 10), storetime=at(5, 2), test_name="time only"),
        dict(subject_id=10, hadm_id=100, chartdate=None, charttime=None, storetime=at(5, 2), test_name="never"),
    ],
    "labevents": [
        dict(subject_id=10, hadm_id=100, charttime=at(2, 4), storetime=at(2, 5), value="neg", valuenum=1.0, flag="", priority="STAT",
             comments="line one\nsaid \"two\", three\t"),
        dict(subject_id=10, hadm_id=100, charttime=at(2, 4), value=None, valuenum=7.25, flag="abnormal", ref_range_lower=1.0),
        dict(subject_id=10, hadm_id=100, charttime=at(9), value=None, valuenum=None, flag=None),
        dict(subject_id=10, hadm_id=100, charttime=None, value="lost"),
        dict(subject_id=12, hadm_id=120, charttime=at(5, 1), value="x"),
    ],
    "ingredientevents": [
        dict(subject_id=10, stay_id=1, hadm_id=100, starttime=at(2, 6), endtime=None, amount=None, rate=None, amountuom="mL"),
        dict(subject_id=10, stay_id=1, hadm_id=100, starttime=at(2, 5), endtime=at(2, 6), amount=250.0, rate=12.5, amountuom=None,
             rateuom="mL/hour", statusdescription="Running"),
    ],
}


def clinical(spark):
    out = {}
    for table in CLINICAL:
        schema = schema_of(table)
        rows = [tuple(r.get(f.name) for f in schema) for r in ROWS[table]]
        out[table] = spark.createDataFrame(rows, schema)
    return out
