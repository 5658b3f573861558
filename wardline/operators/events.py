"""Canonical events: five sources, their union, ordered arrays per stay and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fields
from wardline.functions.scalars import minutes_between
from wardline.functions.text import from_columns
from wardline.operators.cohort import owned
from wardline.operators.ordered import crowded, gather
from wardline.session import placement, stored

EVENT_FIELDS = ["event_time", "event_type", "event_text", "relative_time_to_final_event"]
EVENT_PART_ROWS = 100_000


@dataclass(frozen=True)
class EventSource:
    table: str
    event_type: str
    keys: tuple[str, ...]
    time: Callable[[], Column]
    fields: list[fields.Field]
    separator: str


# Event types, join keys and separators.
SOURCES = {
    "prescription": EventSource(
        "prescriptions", "prescription", ("subject_id", "hadm_id"), lambda: F.col("starttime"),
        fields.PRESCRIPTION_EVENT, " |",
    ),
    "procedure_event": EventSource(
        "procedureevents", "procedure_event", ("subject_id", "stay_id"), lambda: F.col("starttime"),
        fields.PROCEDURE_EVENT, " |",
    ),
    "labevent": EventSource(
        "labevents", "labevent", ("subject_id", "hadm_id"), lambda: F.col("charttime"), fields.LAB_EVENT, "|",
    ),
    "microbiology": EventSource(
        "microbiologyevents", "microbiology", ("subject_id", "hadm_id"),
        lambda: F.coalesce("chartdate", "charttime"), fields.MICROBIOLOGY, "|",
    ),
    "ingredient": EventSource(
        "ingredientevents", "ingredient", ("subject_id", "stay_id"), lambda: F.col("starttime"),
        fields.INGREDIENT, "|",
    ),
}


def canonical_events(
    rows: DataFrame, time: Column, event_type: str, text: Column, stay: str = "stay_id", further: Sequence[Column] = ()
) -> DataFrame:
    """Shape rows that carry ``final_time`` into canonical events; ``text`` has no white space at its ends."""
    return rows.select(
        *further,
        F.col(stay).alias("icu_stay_id"),
        time.alias("event_time"),
        F.lit(event_type).alias("event_type"),
        text.alias("event_text"),
        minutes_between(time, F.col("final_time")).alias("relative_time_to_final_event"),
    )


def event_branch(source: EventSource, rows: DataFrame, stay_ref: DataFrame, by_patient: bool = False) -> DataFrame:
    """Events of one source, repeated for every stay they belong to.

    The join is inner, as an event without a time is dropped anyway. The text is built after the join
    so that its shuffle carries the raw columns. ``by_patient`` places the raw rows by patient, unless they
    already lie so, and adds ``patient_id``; the events then need no shuffle to meet those of other sources.
    """
    timed = rows.where(source.time().isNotNull())
    if by_patient:
        timed = timed.repartition(placement(rows.sparkSession), "subject_id")
    reference = stay_ref.select("stay_id", *[k for k in source.keys if k != "stay_id"], "final_time")
    spare = [c for c in ("stay_id", "hadm_id", "subject_id") if c in timed.columns and c not in source.keys]
    joined = timed.drop(*spare).join(reference, list(source.keys), "inner")
    text = fields.field_text(source.fields, source.separator, from_columns, strip=True)
    further = [F.col("subject_id").alias("patient_id")] if by_patient else []
    return canonical_events(joined, source.time(), source.event_type, text, further=further)


def event_union(tables: dict[str, DataFrame], stay_ref: DataFrame, by_patient: bool = False) -> DataFrame:
    """All sources stacked; duplicates stay."""
    branches = [event_branch(s, tables[s.table], stay_ref, by_patient) for s in SOURCES.values()]
    return reduce(DataFrame.unionByName, branches)


def may_exceed(tables: dict[str, DataFrame], part_rows: int) -> bool:
    """Whether a stay may have more than ``part_rows`` events, judged by the keys of the sources alone."""
    share = part_rows // len(SOURCES)
    return bool(crowded(share, {s.table: (tables[s.table], s.keys) for s in SOURCES.values()}))


def event_order() -> list[Column]:
    """Time order with a tie-break over the remaining fields, so equal order means equal rows."""
    return [F.col(c).asc_nulls_first() for c in EVENT_FIELDS]


def event_array(events: DataFrame, part_rows: int = EVENT_PART_ROWS) -> DataFrame:
    """Ordered event arrays per stay: ``(icu_stay_id, part, first_pos, events)``, keyed by (stay, part).

    A stay has a part for every ``part_rows`` events, as one cell cannot hold any number of events; ``first_pos`` is the
    place of the part's first event in the stay, and the parts in order are the whole array.
    """
    return _arrays(events, part_rows, True)


def _arrays(events: DataFrame, part_rows: int, may_split: bool, patient: Sequence[str] = ()) -> DataFrame:
    layout = [F.col(c) for c in EVENT_FIELDS]
    return gather(events, [*patient, "icu_stay_id"], event_order(), layout, part_rows, "events", may_split=may_split, place=patient)


def event_arrays(tables: dict[str, DataFrame], stay_ref: DataFrame, part_rows: int = EVENT_PART_ROWS) -> DataFrame:
    """Ordered event arrays per stay from the sources.

    One job counts the keys of the sources. Only if a stay may need several parts are the joined events stored, once,
    for the counting and the cutting that follow. Otherwise the raw rows meet by patient, nothing longer is shuffled,
    and the arrays carry ``patient_id`` and lie by it; only where patients share a stay number are events shuffled by stay.
    """
    may_split = may_exceed(tables, part_rows)
    if may_split or not owned(stay_ref):
        events = event_union(tables, stay_ref)
        return _arrays(stored(events, "events") if may_split else events, part_rows, may_split)
    return _arrays(event_union(tables, stay_ref, by_patient=True), part_rows, False, ["patient_id"])


def attach_events(base: DataFrame, arrays: DataFrame, empty_array: bool = False) -> DataFrame:
    """Cohort rows with their events, a row per (stay, part); a stay without events has part 0 with NULL, or an empty array on request.

    Arrays that carry ``patient_id`` are joined by it too: where they lie by patient, only cohort rows move.
    """
    keys = [c for c in ("patient_id", "icu_stay_id") if c in arrays.columns]
    joined = base.join(arrays, keys, "left")
    events = F.coalesce("events", F.array().cast(arrays.schema["events"].dataType)) if empty_array else F.col("events")
    return joined.select(
        *base.columns, F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("first_pos", F.lit(0)).alias("first_pos"), events.alias("events")
    )


def event_flatten(arrays: DataFrame) -> DataFrame:
    """Arrays back to one row per event, with its place ``pos`` in the whole stay."""
    others = [c for c in arrays.columns if c not in ("part", "first_pos", "events")]
    rows = arrays.select(*others, "first_pos", F.posexplode("events").alias("_at", "_event"))
    place = F.col("first_pos") + F.col("_at")
    return rows.select(*others, place.alias("pos"), *[F.col(f"_event.{c}").alias(c) for c in EVENT_FIELDS])
