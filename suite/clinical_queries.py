"""Cohort, rollups, event branches and exports on the clinical view of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite.clinical_view import clinical_tables, with_views
from suite.registry import Tables, query
from wardline.functions import fields
from wardline.operators import cohort, events, rollups
from wardline.plans import exports


def _text(labels: list, expressions: list[str], separator: str, nullable: tuple[int, ...] = ()) -> str:
    """The labelled text in SQL: labels from the field list, values from ``expressions``."""
    pieces = []
    for i, ((label, _, _), expression) in enumerate(zip(labels, expressions, strict=True)):
        value = f"cast({expression} AS string)"
        pieces.append(f"'{separator if i else ''}{label}'")
        pieces.append(value if i in nullable else f"coalesce({value}, '')")
    return " || ".join(pieces)


def _num(x: str) -> str:
    return rf"regexp_replace(cast({x} AS string), '\.0$', '')"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'True' ELSE 'False' END"


_RX_VALUES = ["p.starttime", "p.stoptime", "drug_type", "drug", "formulary_drug_cd", "prod_strength", "form_rx", "dose_val_rx",
              "dose_unit_rx", "form_val_disp", "form_unit_disp", _num("doses_per_24_hrs"), "route",
              _flag("p.starttime >= i.intime AND p.starttime <= i.outtime")]
_PROC_VALUES = ["p.starttime", "p.endtime", "p.storetime", _num("p.value"), "valueuom", "location", "locationcategory",
                _num("patientweight"), "statusdescription"]
_MICRO_VALUES = ["coalesce(p.chartdate, p.charttime)", "spec_type_desc", "coalesce(p.storedate, p.storetime)", "test_name",
                 "org_name", "ab_name", "interpretation"]
_LAB_VALUES = ["p.charttime", "p.storetime", f"coalesce(p.value, {_num('p.valuenum')})", "valueuom", _num("ref_range_lower"),
               _num("ref_range_upper"), _flag("length(p.flag) > 0"), "priority", "comments"]
_ING_VALUES = ["p.starttime", "p.endtime", f"CASE WHEN amount IS NULL THEN '' ELSE {_num('amount')} || ' ' || coalesce(amountuom, '') END",
               f"CASE WHEN rate IS NULL THEN 'N/A' ELSE {_num('rate')} || ' ' || coalesce(rateuom, '') END", "statusdescription"]
_EVENT_RX_VALUES = ["drug", "prod_strength", "form_rx", "formulary_drug_cd", "dose_val_rx"]

_ROLLUP_SQL = {
    "medications": ("prescriptions", ["subject_id"], "p.starttime", _text(fields.MEDICATION_ROLLUP, _RX_VALUES, "|")),
    "procedure_events": ("procedureevents", ["subject_id", "hadm_id", "stay_id"], "p.starttime",
                         _text(fields.PROCEDURE_EVENT, _PROC_VALUES, "|")),
    "microbiology": ("microbiologyevents", ["subject_id", "hadm_id"], "p.charttime",
                     _text(fields.MICROBIOLOGY, _MICRO_VALUES, "|", (0, 2))),
    "labs": ("labevents", ["subject_id", "hadm_id"], "p.charttime", _text(fields.LAB_ROLLUP, _LAB_VALUES, "|")),
    "ingredients": ("ingredientevents", ["subject_id", "hadm_id", "stay_id"], "p.starttime",
                    _text(fields.INGREDIENT, _ING_VALUES, "|")),
}


def _rollup_sql(name: str) -> str:
    table, keys, order, text = _ROLLUP_SQL[name]
    on = " AND ".join(f"p.{k} = i.{k}" for k in keys)
    return f"""SELECT stay_id, 0 AS part, string_agg(item, chr(10) ORDER BY sort_at NULLS FIRST, item) AS {rollups.ROLLUPS[name].column}
      FROM (SELECT i.stay_id, {order} AS sort_at, {text} AS item FROM icustays i LEFT JOIN {table} p ON {on}) GROUP BY stay_id"""


_PROCEDURES_SQL = """SELECT stay_id, 0 AS part, string_agg(item, chr(10) ORDER BY sort_at NULLS FIRST, item) AS procedure_list FROM (
    SELECT i.stay_id, p.chartdate AS sort_at, coalesce(d.long_title, 'Unknown Procedure') || ' (' || cast(p.chartdate AS string) || ')' AS item
    FROM icustays i LEFT JOIN procedures_icd p ON p.subject_id = i.subject_id AND p.hadm_id = i.hadm_id
    LEFT JOIN d_icd_procedures d ON d.icd_code = p.icd_code AND d.icd_version = p.icd_version) GROUP BY stay_id"""
_DIAGNOSES_SQL = """SELECT stay_id, 0 AS part, string_agg(title, chr(10) ORDER BY title) AS diagnosis FROM (
    SELECT DISTINCT i.stay_id, d.long_title AS title FROM icustays i LEFT JOIN diagnoses_icd p ON p.hadm_id = i.hadm_id
    LEFT JOIN d_icd_diagnoses d ON d.icd_code = p.icd_code AND d.icd_version = p.icd_version) GROUP BY stay_id"""


def _one(t: Tables, name: str) -> DataFrame:
    tables = clinical_tables(t)
    rollup = rollups.ROLLUPS[name]
    rolled = rollups.field_rollup(rollup, tables[rollup.table], tables["icustays"])
    return rollups.with_all_stays(tables["icustays"], rolled)


for _name in _ROLLUP_SQL:
    query(f"rollup_{_name}", with_views(_rollup_sql(_name)))(lambda t, name=_name: _one(t, name))


@query("rollup_procedures", with_views(_PROCEDURES_SQL))
def rollup_procedures(t: Tables) -> DataFrame:
    tables = clinical_tables(t)
    rolled = rollups.rollup_procedures(tables["icustays"], tables["procedures_icd"], tables["d_icd_procedures"])
    return rollups.with_all_stays(tables["icustays"], rolled)


@query("rollup_diagnoses", with_views(_DIAGNOSES_SQL))
def rollup_diagnoses(t: Tables) -> DataFrame:
    tables = clinical_tables(t)
    rolled = rollups.rollup_diagnoses(tables["icustays"], tables["diagnoses_icd"], tables["d_icd_diagnoses"])
    return rollups.with_all_stays(tables["icustays"], rolled)


def _renames(columns: dict[str, str], table: str) -> str:
    return ", ".join(f"{table}.{old} AS {new}" for new, old in columns.items())


_STAY_SQL = _renames(cohort.STAY_COLUMNS, "i") + ", date_sub('minute', i.intime, i.outtime) AS icu_length_of_stay_in_minutes"
_BASE_SQL = f"""SELECT {_STAY_SQL}, a.hospital_expire_flag AS patient_expired_in_hospital,
    {_renames(cohort.PATIENT_COLUMNS, "p")}, {_renames(cohort.ADMISSION_COLUMNS, "a")}
    FROM icustays i LEFT JOIN patients p ON p.subject_id = i.subject_id LEFT JOIN admissions a ON a.hadm_id = i.hadm_id"""


@query("cohort_projection", with_views(f"SELECT {_STAY_SQL} FROM icustays i"))
def cohort_projection(t: Tables) -> DataFrame:
    return cohort.cohort_projection(clinical_tables(t)["icustays"])


@query("cohort_base", with_views(_BASE_SQL))
def cohort_base(t: Tables) -> DataFrame:
    return exports.base_of(clinical_tables(t))


@query("star_projection", with_views(f"WITH base AS ({_BASE_SQL}) SELECT b.*, icu_length_of_stay_in_minutes / 60.0::double AS stay_hours FROM base b"))
def star_projection(t: Tables) -> DataFrame:
    base = exports.base_of(clinical_tables(t)).alias("b")
    return base.select("b.*", (F.col("icu_length_of_stay_in_minutes") / 60.0).alias("stay_hours"))


_TEXTS = ["chronology_of_medications", "diagnosis", "procedure_list", "procedure_event_list", "microbiology_cultures", "labevents",
          "ingredient_events"]
_WIDE_SQL = f"""WITH base AS ({_BASE_SQL}), r1 AS ({_rollup_sql("medications")}), r2 AS ({_DIAGNOSES_SQL}), r3 AS ({_PROCEDURES_SQL}),
  r4 AS ({_rollup_sql("procedure_events")}), r5 AS ({_rollup_sql("microbiology")}), r6 AS ({_rollup_sql("labs")}),
  r7 AS ({_rollup_sql("ingredients")})
  SELECT b.*, 0 AS part, {", ".join(f"md5(r{i + 1}.{c}) AS {c}" for i, c in enumerate(_TEXTS))} FROM base b
  {" ".join(f"LEFT JOIN r{i} ON r{i}.stay_id = b.icu_stay_id" for i in range(1, 8))}"""


@query("assemble_wide", with_views(_WIDE_SQL))
def assemble_wide(t: Tables) -> DataFrame:
    sources = [*[r.table for r in rollups.ROLLUPS.values()], "diagnoses_icd", "procedures_icd"]
    wide = exports.wide_export(clinical_tables(t, sources))
    return wide.withColumns({c: F.md5(c) for c in _TEXTS})


_FINAL = "CASE WHEN a.hospital_expire_flag = 1 THEN a.deathtime ELSE i.outtime END"
_BRANCH_SQL = {
    "event_prescription": ("prescriptions", "hadm_id", "p.starttime", "prescription", _text(fields.PRESCRIPTION_EVENT, _EVENT_RX_VALUES, " |")),
    "event_procedure": ("procedureevents", "stay_id", "p.starttime", "procedure_event", _text(fields.PROCEDURE_EVENT, _PROC_VALUES, " |")),
    "event_lab": ("labevents", "hadm_id", "p.charttime", "labevent", _text(fields.LAB_EVENT, _LAB_VALUES, "|")),
    "event_microbiology": ("microbiologyevents", "hadm_id", "coalesce(p.chartdate, p.charttime)", "microbiology",
                           _text(fields.MICROBIOLOGY, _MICRO_VALUES, "|", (0, 2))),
    "event_ingredient": ("ingredientevents", "stay_id", "p.starttime", "ingredient", _text(fields.INGREDIENT, _ING_VALUES, "|")),
}


def _branch_sql(key: str) -> str:
    table, second, time, kind, text = _BRANCH_SQL[key]
    return f"""SELECT i.stay_id AS icu_stay_id, {time} AS event_time, '{kind}' AS event_type, {_strip(text)} AS event_text,
      date_sub('minute', {time}, {_FINAL}) AS relative_time_to_final_event
      FROM icustays i JOIN {table} p ON p.subject_id = i.subject_id AND p.{second} = i.{second}
      LEFT JOIN admissions a ON a.hadm_id = i.hadm_id WHERE {time} IS NOT NULL"""


_EVENT_TABLES = [source.table for source in events.SOURCES.values()]
_UNION_SQL = " UNION ALL ".join(_branch_sql(k) for k in _BRANCH_SQL)
_POSITION_SQL = f"""SELECT icu_stay_id, row_number() OVER (PARTITION BY icu_stay_id ORDER BY event_time NULLS FIRST, event_type NULLS FIRST,
    event_text NULLS FIRST, relative_time_to_final_event NULLS FIRST) - 1 AS pos, event_time, event_type, md5(event_text) AS event_text,
    relative_time_to_final_event FROM ({_UNION_SQL})"""


def _branch(t: Tables, kind: str) -> DataFrame:
    tables = clinical_tables(t)
    source = events.SOURCES[kind]
    return events.event_branch(source, tables[source.table], cohort.stay_reference(tables["icustays"], tables["admissions"]))


for _key, (_, _, _, _kind, _) in _BRANCH_SQL.items():
    query(_key, with_views(_branch_sql(_key)))(lambda t, kind=_kind: _branch(t, kind))


@query("event_union", with_views(_UNION_SQL))
def event_union(t: Tables) -> DataFrame:
    return exports.timeline(clinical_tables(t, _EVENT_TABLES))


def _flat(arrays: DataFrame) -> DataFrame:
    return events.event_flatten(arrays).withColumn("event_text", F.md5("event_text"))


@query("event_array", with_views(f"""SELECT icu_stay_id, (pos // {events.EVENT_PART_ROWS})::int AS part, min(pos) AS first_pos, count(*) AS events,
  md5(string_agg(coalesce(strftime(event_time::timestamp, '%Y-%m-%d %H:%M:%S'), '-') || ':' || event_type || ':' || coalesce(event_text, '-') || ':' ||
  coalesce(relative_time_to_final_event::varchar, '-'), ',' ORDER BY pos)) AS digest FROM ({_POSITION_SQL}) GROUP BY 1, 2"""))
def event_array(t: Tables) -> DataFrame:
    arrays = exports.event_arrays_of(clinical_tables(t, _EVENT_TABLES))

    def shown(e):
        return F.concat_ws(
            ":", F.coalesce(F.date_format(e["event_time"], "yyyy-MM-dd HH:mm:ss"), F.lit("-")), e["event_type"],
            F.coalesce(F.md5(e["event_text"]), F.lit("-")), F.coalesce(e["relative_time_to_final_event"].cast("string"), F.lit("-")),
        )

    digest = F.md5(F.array_join(F.transform("events", shown), ","))
    return arrays.select("icu_stay_id", "part", "first_pos", F.size("events").cast("long").alias("events"), digest.alias("digest"))


@query("event_flatten", with_views(_POSITION_SQL))
def event_flatten(t: Tables) -> DataFrame:
    return _flat(exports.event_arrays_of(clinical_tables(t, _EVENT_TABLES)))


@query("attach_events", with_views(f"""WITH base AS ({_BASE_SQL}), flat AS ({_POSITION_SQL})
  SELECT b.*, f.pos, f.event_time, f.event_type, f.event_text, f.relative_time_to_final_event FROM base b LEFT JOIN flat f ON f.icu_stay_id = b.icu_stay_id"""))
def attach_events(t: Tables) -> DataFrame:
    export = exports.structured_export(clinical_tables(t, _EVENT_TABLES))
    cohort_columns = ["icu_stay_id", *[c for c in export.columns if c not in ("icu_stay_id", "part", "first_pos", "events")]]
    rows = export.select(*cohort_columns, "first_pos", F.posexplode_outer("events").alias("at", "e"))
    return rows.select(
        *cohort_columns, (F.col("first_pos") + F.col("at")).alias("pos"), "e.event_time", "e.event_type",
        F.md5("e.event_text").alias("event_text"), "e.relative_time_to_final_event",
    )
