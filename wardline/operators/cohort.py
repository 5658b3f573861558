"""Cohort rows and the joins around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import final_event_time, minutes_between
from wardline.session import placement

# Cohort column <- source column.
STAY_COLUMNS = {
    "patient_id": "subject_id",
    "admission_id": "hadm_id",
    "icu_stay_id": "stay_id",
    "first_icu_careunit": "first_careunit",
    "last_icu_careunit": "last_careunit",
    "icu_intime": "intime",
    "icu_outtime": "outtime",
    "icu_length_of_stay_in_days": "los",
}
PATIENT_COLUMNS = {
    "patient_gender": "gender",
    "patient_age": "anchor_age",
    "patient_year": "anchor_year",
    "patient_year_group": "anchor_year_group",
    "patient_date_of_death": "dod",
}
ADMISSION_COLUMNS = {
    "admission_type": "admission_type",
    "admission_location": "admission_location",
    "discharge_location": "discharge_location",
    "insurance": "insurance",
    "native_language": "language",
    "marital_status": "marital_status",
    "patient_race": "race",
    "patient_death_time": "deathtime",
}


def renamed(columns: dict[str, str]) -> list[Column]:
    return [F.col(old).alias(new) for new, old in columns.items()]


def cohort_projection(stays: DataFrame) -> DataFrame:
    """Stay columns under their cohort names, plus the stay length in minutes."""
    return stays.select(
        *renamed(STAY_COLUMNS),
        minutes_between(F.col("intime"), F.col("outtime")).alias("icu_length_of_stay_in_minutes"),
    )


def cohort_base(stays: DataFrame, patients: DataFrame, admissions: DataFrame, by_patient: bool = False) -> DataFrame:
    """One row per stay with its patient and admission, 23 columns; ``by_patient`` places the rows as those of stored sources."""
    people = patients.select(F.col("subject_id").alias("patient_id"), *renamed(PATIENT_COLUMNS))
    visits = admissions.select(
        F.col("hadm_id").alias("admission_id"),
        F.col("hospital_expire_flag").alias("patient_expired_in_hospital"),
        *renamed(ADMISSION_COLUMNS),
    )
    # patients last, so that the rows lie by patient, as their events do
    visited = cohort_projection(stays).join(visits, "admission_id", "left")
    placed = visited.repartition(placement(stays.sparkSession), "patient_id") if by_patient else visited
    joined = placed.join(people, "patient_id", "left")
    return joined.select(
        *STAY_COLUMNS,
        "icu_length_of_stay_in_minutes",
        "patient_expired_in_hospital",
        *PATIENT_COLUMNS,
        *ADMISSION_COLUMNS,
    )


def stay_reference(stays: DataFrame, admissions: DataFrame) -> DataFrame:
    """The few stay columns an event branch needs, with the time of the final event.

    Patients are left out: their key is unique and no column of theirs is used.
    """
    visits = admissions.select("hadm_id", "hospital_expire_flag", "deathtime")
    final = final_event_time(F.col("hospital_expire_flag"), F.col("deathtime"), F.col("outtime"))
    return stays.join(visits, "hadm_id", "left").select(
        "stay_id", "subject_id", "hadm_id", "intime", "outtime", final.alias("final_time")
    )


def owned(stays: DataFrame, known: bool = False) -> bool:
    """Whether every stay number belongs to one patient, so that a patient's rows hold the whole of each stay.

    A stay without a patient has no rows by patient; ``known`` asks that there is none, for what is joined by admission alone.
    """
    patient = F.col("subject_id")
    per_stay = stays.groupBy("stay_id").agg(
        F.min(patient).alias("least"), F.max(patient).alias("most"), F.count(patient).alias("known"), F.count(F.lit(1)).alias("rows")
    )
    lost = F.col("known").between(0 if known else 1, F.col("rows") - 1)
    return per_stay.where((F.col("least") != F.col("most")) | lost).isEmpty()


def keyed_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys to a table that may hold very many rows of one key.

    A skewed right side cannot be split under a left join, but can under an inner one. So matches come
    from an inner join, and the left rows without any from a test against the distinct right keys.
    """
    keys = list(keys)
    matched = left.join(right, keys, "inner")
    unmatched = left.join(right.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def dictionary_join(rows: DataFrame, dictionary: DataFrame, keys: Sequence[str], title: str) -> DataFrame:
    """Look up the title of a code, which the dictionary holds once; unknown codes keep their row."""
    return rows.join(dictionary.select(*keys, title), list(keys), "left")


def matched_only(left: DataFrame, right: DataFrame, keys: Sequence[str], required: str) -> DataFrame:
    """A left join followed by a not-null test on the right side, written as the inner join it is."""
    return left.join(right.where(F.col(required).isNotNull()), list(keys), "inner")


def for_all_parts(base: DataFrame, parts: DataFrame) -> DataFrame:
    """Cohort rows with ``part``: part 0 for every stay, and the parts above 0 that ``parts`` lists.

    Joining on (stay, part) spreads an oversized stay over as many tasks as it has parts.
    """
    further = parts.where(F.col("part") > 0).select("icu_stay_id", "part").distinct()
    first = base.withColumn("part", F.lit(0))
    return first.unionByName(base.join(further, "icu_stay_id").select(*first.columns))
