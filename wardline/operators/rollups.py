"""Ordered text per stay.

A rollup joins its items to the stays with an inner join, which the adaptive skew join may split on
either side, and gives one text per (stay, part). Stays without items are added afterwards: they get
the text of an unmatched row where every field has a default, otherwise NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fields
from wardline.functions.text import from_columns, from_nothing
from wardline.operators.cohort import dictionary_join, for_all_parts, keyed_left_join, owned
from wardline.operators.ordered import crowded, gather
from wardline.session import placement, stored_by
from wardline.sources.schemas import column_types

TEXT_PART_ROWS = 50_000
# Fixed values
ITEM_SEPARATOR = "\n"
UNKNOWN_PROCEDURE = "Unknown Procedure"


@dataclass(frozen=True)
class Rollup:
    table: str
    column: str
    keys: tuple[str, ...]
    order: str
    fields: list[fields.Field]
    has_defaults: bool = True  # every field has a default, so a stay without rows still gets a text


# Result columns, join keys and order columns.
ROLLUPS = {
    "medications": Rollup(
        "prescriptions", "chronology_of_medications", ("subject_id",), "starttime", fields.MEDICATION_ROLLUP
    ),
    "procedure_events": Rollup(
        "procedureevents", "procedure_event_list", ("subject_id", "hadm_id", "stay_id"), "starttime",
        fields.PROCEDURE_EVENT,
    ),
    "microbiology": Rollup(
        "microbiologyevents", "microbiology_cultures", ("subject_id", "hadm_id"), "charttime", fields.MICROBIOLOGY,
        has_defaults=False,
    ),
    "labs": Rollup("labevents", "labevents", ("subject_id", "hadm_id"), "charttime", fields.LAB_ROLLUP),
    "ingredients": Rollup(
        "ingredientevents", "ingredient_events", ("subject_id", "hadm_id", "stay_id"), "starttime", fields.INGREDIENT
    ),
}


@dataclass(frozen=True)
class StayTexts:
    """``(stay_id, part, column)`` of the stays with items; the text of the others; whether stays may have several parts.

    Texts made by patient have ``subject_id`` too and lie by it.
    """

    texts: DataFrame
    column: str
    default: Column | None
    may_split: bool


def ordered_text(
    rows: DataFrame, at: Column, item: Column, column: str, part_rows: int = TEXT_PART_ROWS, may_split: bool = True,
    patient: Sequence[str] = (),
) -> DataFrame:
    """Join the ``item`` texts of a stay in ``at`` order: ``(stay_id, part, column)``.

    NULL items do not count, as in any text aggregate. The text of an item is longer than the columns it is
    made of, so it is built after the shuffle; only where stays may be split is it needed before.
    """
    if may_split:
        rows = rows.select("stay_id", at.alias("at"), item.alias("item")).where(F.col("item").isNotNull())
        at, item = F.col("at"), F.col("item")
    order = [at.asc_nulls_first(), item.asc()]
    layout = [at.alias("at"), item.alias("item")]
    keys = [*patient, "stay_id"]
    gathered = gather(rows, keys, order, layout, part_rows, "_items", lambda x: x["item"], may_split=may_split, place=patient)
    text = F.when(F.exists("_items", lambda x: x.isNotNull()), F.array_join("_items", ITEM_SEPARATOR))
    return gathered.select(*keys, "part", text.alias(column))


def _by_patient(rows: DataFrame) -> DataFrame:
    """Rows placed by patient; Spark leaves the shuffle out where they lie so already."""
    return rows.repartition(placement(rows.sparkSession), "subject_id")


def _stay_columns(stays: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return stays.select("stay_id", *[k for k in keys if k != "stay_id"], "intime", "outtime")


def field_rollup(
    rollup: Rollup, rows: DataFrame, stays: DataFrame, part_rows: int = TEXT_PART_ROWS, may_split: bool | None = None,
    by_patient: bool = False,
) -> StayTexts:
    """Items of one source per stay. ``may_split`` tells whether a key of the source may exceed a part.

    ``by_patient`` is for stays that are whole in their patient's rows: raw rows meet by patient and nothing else moves.
    """
    if may_split is None:
        may_split = bool(crowded(part_rows, {rollup.table: (rows, rollup.keys)}))
    spare = [c for c in ("stay_id", "hadm_id", "subject_id") if c in rows.columns and c not in rollup.keys]
    raw = _by_patient(rows.drop(*spare)) if by_patient else rows.drop(*spare)
    joined = raw.join(_stay_columns(stays, rollup.keys), list(rollup.keys), "inner")
    item = fields.field_text(rollup.fields, "|", from_columns)
    patient = ["subject_id"] if by_patient else []
    texts = ordered_text(joined, F.col(rollup.order), item, rollup.column, part_rows, may_split, patient)
    return StayTexts(texts, rollup.column, empty_text(rollup), may_split)


def empty_text(rollup: Rollup) -> Column | None:
    """The text of a stay without any row of this kind."""
    if not rollup.has_defaults:
        return None
    types = column_types(rollup.table) | {"intime": "timestamp_ntz", "outtime": "timestamp_ntz"}
    return fields.field_text(rollup.fields, "|", from_nothing(types))


def rollup_procedures(
    stays: DataFrame, procedures: DataFrame, titles: DataFrame, part_rows: int = TEXT_PART_ROWS, may_split: bool | None = None,
    by_patient: bool = False,
) -> StayTexts:
    """``title (date)`` by date; a procedure without a date has no text. Titles are looked up before rows go to several stays."""
    if may_split is None:
        may_split = bool(crowded(part_rows, {"procedures": (procedures, ("subject_id", "hadm_id"))}))
    named = dictionary_join(procedures, titles, ["icd_code", "icd_version"], "long_title").drop("icd_code", "icd_version")
    raw = _by_patient(named) if by_patient else named
    titled = raw.join(stays.select("stay_id", "subject_id", "hadm_id"), ["subject_id", "hadm_id"], "inner")
    item = F.concat(
        F.coalesce("long_title", F.lit(UNKNOWN_PROCEDURE)), F.lit(" ("), F.col("chartdate").cast("string"), F.lit(")")
    )
    patient = ["subject_id"] if by_patient else []
    texts = ordered_text(titled, F.col("chartdate"), item, "procedure_list", part_rows, may_split, patient)
    return StayTexts(texts, "procedure_list", None, may_split)


def rollup_diagnoses(
    stays: DataFrame, diagnoses: DataFrame, titles: DataFrame, part_rows: int = TEXT_PART_ROWS, may_split: bool | None = None,
    by_patient: bool = False,
) -> StayTexts:
    """Distinct titles in order; repeated titles are merged before they are gathered.

    ``by_patient`` gathers the titles of an admission before its stays get them, as no admission exceeds a part.
    """
    if may_split is None:
        may_split = bool(crowded(part_rows, {"diagnoses": (diagnoses, ("hadm_id",))}))
    named = dictionary_join(diagnoses, titles, ["icd_code", "icd_version"], "long_title").where(F.col("long_title").isNotNull())
    if by_patient:
        per_visit = named.select("hadm_id", "long_title").repartition("hadm_id").groupBy("hadm_id").agg(F.collect_set("long_title").alias("titles"))
        ours = per_visit.join(stays.select("subject_id", "stay_id", "hadm_id"), "hadm_id", "inner")
        lists = _by_patient(ours).groupBy("subject_id", "stay_id").agg(F.flatten(F.collect_list("titles")).alias("titles"))
        text = F.array_join(F.sort_array(F.array_distinct("titles")), ITEM_SEPARATOR)
        return StayTexts(lists.select("subject_id", "stay_id", F.lit(0).alias("part"), text.alias("diagnosis")), "diagnosis", None, False)
    joined = named.join(stays.select("stay_id", "hadm_id"), "hadm_id", "inner")
    distinct = joined.select("stay_id", "long_title").distinct()
    title = F.col("long_title")
    return StayTexts(ordered_text(distinct, title, title, "diagnosis", part_rows, may_split), "diagnosis", None, may_split)


def with_all_stays(stays: DataFrame, rolled: StayTexts, skeleton: bool = True) -> DataFrame:
    """The texts of all stays, with and without items: ``(stay_id, part, column)``."""
    ids = stays.select("stay_id")
    joined = keyed_left_join(ids, rolled.texts, ["stay_id"]) if rolled.may_split else ids.join(rolled.texts, "stay_id", "left")
    text = F.coalesce(rolled.column, rolled.default) if rolled.default is not None and skeleton else F.col(rolled.column)
    return joined.select("stay_id", F.coalesce("part", F.lit(0)).alias("part"), text.alias(rolled.column))


def all_rollups(tables: dict[str, DataFrame], part_rows: int = TEXT_PART_ROWS) -> list[StayTexts]:
    """Every rollup in export order. One job tells which sources have a key beyond one part.

    Where none has and a stay number belongs to one patient, the stays are stored by patient and all sources meet them there.
    """
    stays = tables["icustays"]
    sources = {r.table: (tables[r.table], r.keys) for r in ROLLUPS.values()}
    sources["diagnoses_icd"] = (tables["diagnoses_icd"], ("hadm_id",))
    sources["procedures_icd"] = (tables["procedures_icd"], ("subject_id", "hadm_id"))
    large = crowded(part_rows, sources)
    by_patient = not large and owned(stays, known=True)
    if by_patient:
        stays = stored_by(stays.select("subject_id", "hadm_id", "stay_id", "intime", "outtime"), "subject_id", "stays")

    def of(name: str) -> StayTexts:
        rollup = ROLLUPS[name]
        return field_rollup(rollup, tables[rollup.table], stays, part_rows, rollup.table in large, by_patient)

    diagnoses, procedures = tables["diagnoses_icd"], tables["procedures_icd"]
    return [
        of("medications"),
        rollup_diagnoses(stays, diagnoses, tables["d_icd_diagnoses"], part_rows, "diagnoses_icd" in large, by_patient),
        rollup_procedures(stays, procedures, tables["d_icd_procedures"], part_rows, "procedures_icd" in large, by_patient),
        of("procedure_events"),
        of("microbiology"),
        of("labs"),
        of("ingredients"),
    ]


def assemble_wide(base: DataFrame, rollups: list[StayTexts], skeleton: bool = True) -> DataFrame:
    """Cohort rows with their texts: one row per stay, or one per part of an oversized stay.

    Each rollup is aggregated before it is joined, so no join multiplies rows. Where every stay is in one
    part, the joins are on the stay alone, or with its patient, and keep the partitioning the texts were gathered in.
    """
    texts = [r.texts.withColumnsRenamed({"stay_id": "icu_stay_id", "subject_id": "patient_id"}) for r in rollups]
    large = [text.select("icu_stay_id", "part") for text, r in zip(texts, rollups) if r.may_split]
    if large:
        wide = for_all_parts(base, reduce(DataFrame.unionByName, large))
        for text in texts:
            wide = wide.join(text, ["icu_stay_id", "part"], "left")
    else:
        wide = base.withColumn("part", F.lit(0))
        for text in texts:
            keys = [c for c in ("patient_id", "icu_stay_id") if c in text.columns]
            wide = wide.join(text.drop("part"), keys, "left")

    def shown(r: StayTexts) -> Column:
        if r.default is None or not skeleton:
            return F.col(r.column)
        return F.when(F.col("part") == 0, F.coalesce(r.column, r.default)).otherwise(F.col(r.column)).alias(r.column)

    return wide.select(*base.columns, "part", *[shown(r) for r in rollups])
