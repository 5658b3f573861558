"""Labelled fields of every event kind.

A field is (label, text, nullable). The text is a function of a column resolver, so the same field
list describes matched rows and the text of a stay without any match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.scalars import flag_in_stay, flag_nonempty
from wardline.functions.text import Resolver, labelled_text, num_to_text, value_with_unit

FieldText = Callable[[Resolver], Column]
Field = tuple[str, FieldText, bool]


def plain(name: str) -> FieldText:
    return lambda c: c(name)


def stamp(*names: str) -> FieldText:
    return lambda c: F.coalesce(*[c(n).cast("string") for n in names])


def number(name: str) -> FieldText:
    return lambda c: num_to_text(c(name))


def amount(name: str, unit: str, missing: str) -> FieldText:
    return lambda c: value_with_unit(c(name), c(unit), missing)


def lab_value(c: Resolver) -> Column:
    return F.coalesce(c("value"), num_to_text(c("valuenum")))


def lab_flag(c: Resolver) -> Column:
    return flag_nonempty(c("flag"))


def in_stay(c: Resolver) -> Column:
    return flag_in_stay(c("starttime"), c("intime"), c("outtime"))


# Labels, their order and their columns decide the exported text.
MEDICATION_ROLLUP: list[Field] = [
    ("Start Time:", stamp("starttime"), False),
    ("Stop Time:", stamp("stoptime"), False),
    ("Drug Type:", plain("drug_type"), False),
    ("Drug:", plain("drug"), False),
    ("Drug Ontology:", plain("formulary_drug_cd"), False),
    ("Composition Strength of Prescribed Medicine:", plain("prod_strength"), False),
    ("Drug Form:", plain("form_rx"), False),
    ("Prescribed Dose for Patient:", plain("dose_val_rx"), False),
    ("Unit Measurement of Prescribed Dose:", plain("dose_unit_rx"), False),
    ("Amount of Medicine in Single Formulary Dose:", plain("form_val_disp"), False),
    ("Amount of Medicine in Formulary Dose:", plain("form_unit_disp"), False),
    ("Number of Doses per 24 Hours:", number("doses_per_24_hrs"), False),
    ("Route of Administration:", plain("route"), False),
    ("Administered in ICU:", in_stay, False),
]
PROCEDURE_EVENT: list[Field] = [
    ("Start Time:", stamp("starttime"), False),
    ("End Time:", stamp("endtime"), False),
    ("Event Recorded Time in Patient File:", stamp("storetime"), False),
    ("Duration of Procedure:", number("value"), False),
    ("Unit of Measurement of Duration of Procedure:", plain("valueuom"), False),
    ("Location of Procedure on Patient Body:", plain("location"), False),
    ("Location Category of Procedure:", plain("locationcategory"), False),
    ("Patient Weight (in Kilograms):", number("patientweight"), False),
    ("Ultimate Procedure Status:", plain("statusdescription"), False),
]
MICROBIOLOGY: list[Field] = [
    ("Sample Collection Time:", stamp("chartdate", "charttime"), True),
    ("Specimen Type:", plain("spec_type_desc"), False),
    ("Sample Received Time:", stamp("storedate", "storetime"), True),
    ("Microbiology Test Name:", plain("test_name"), False),
    ("Organism Name:", plain("org_name"), False),
    ("Antibiotic Name (Isolated Colony):", plain("ab_name"), False),
    ("Interpretation:", plain("interpretation"), False),
]
LAB_ROLLUP: list[Field] = [
    ("Sample Collection Time:", stamp("charttime"), False),
    ("Sample Received Time:", stamp("storetime"), False),
    ("Value:", lab_value, False),
    ("Unit of Measurement of Value:", plain("valueuom"), False),
    ("Reference Range Lower:", number("ref_range_lower"), False),
    ("Reference Range Upper:", number("ref_range_upper"), False),
    ("Abnormal Flag:", lab_flag, False),
    ("Priority:", plain("priority"), False),
    ("Comments:", plain("comments"), False),
]
INGREDIENT: list[Field] = [
    ("Start Time:", stamp("starttime"), False),
    ("End Time:", stamp("endtime"), False),
    ("Input Ingredient:", amount("amount", "amountuom", ""), False),
    ("Rate:", amount("rate", "rateuom", "N/A"), False),
    ("Status Description:", plain("statusdescription"), False),
]
PRESCRIPTION_EVENT: list[Field] = [
    ("Drug:", plain("drug"), False),
    ("Strength:", plain("prod_strength"), False),
    ("Form:", plain("form_rx"), False),
    ("Ontology:", plain("formulary_drug_cd"), False),
    ("Dose:", plain("dose_val_rx"), False),
]
LAB_EVENT: list[Field] = [
    ("Sample Collection Time:", stamp("charttime"), False),
    ("Sample Received Time:", stamp("storetime"), False),
    ("Lab Result Value:", lab_value, False),
    ("Unit of Measurement:", plain("valueuom"), False),
    ("Reference Range Lower Bound:", number("ref_range_lower"), False),
    ("Reference Range Upper Bound:", number("ref_range_upper"), False),
    ("Abnormal Result Flag:", lab_flag, False),
    ("Result Priority:", plain("priority"), False),
    ("Clinician Comments:", plain("comments"), False),
]


def field_text(fields: list[Field], separator: str, resolve: Resolver, strip: bool = False) -> Column:
    return labelled_text([(label, text(resolve), nullable) for label, text, nullable in fields], separator, strip)
