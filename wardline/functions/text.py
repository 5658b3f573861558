"""Event text: labelled fields, white space, numbers as text, cache keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_white(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def num_to_text(x: Column) -> Column:
    """A number as the warehouse prints it: ``1``, ``0.5``, ``1e+20``; no trailing ``.0``."""
    d = x.cast("double")
    shown, size = d.cast("string"), F.abs(d)
    # Java switches to 1.0E7 below 1e-3 and from 1e7 on; the warehouse below 1e-4 and from 1e15 on
    positional = F.regexp_replace(shown.cast("decimal(38,20)").cast("string"), r"0+$", "")
    exponent = F.replace(F.regexp_replace(F.lower(shown), r"(\.0)?e", "e+"), F.lit("+-"), F.lit("-"))
    scientific = F.replace(F.regexp_replace(exponent, r"([+-])(\d)$", "$10$2"), F.lit("infinity"), F.lit("inf"))
    return (
        F.when((size < 1e15) & (F.floor(d) == d), F.floor(d).cast("string"))
        .when((size >= 1e-3) & (size < 1e7), shown)
        .when((size >= 1e-4) & (size < 1e15), positional)
        .otherwise(scientific)
    )


def value_with_unit(amount: Column, unit: Column, missing: str) -> Column:
    """``'5 mL'``; a missing amount gives ``missing``, a missing unit leaves the blank."""
    shown = F.concat(num_to_text(amount), F.lit(" "), F.coalesce(unit, F.lit("")))
    return F.when(amount.isNotNull(), shown).otherwise(F.lit(missing))


def text_or_empty(text: Column) -> Column:
    """Cleaned text: NULL becomes the empty string, anything else its text form."""
    return F.coalesce(text.cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """Cache key of a text: MD5 of its cleaned UTF-8 form."""
    return F.md5(text_or_empty(text))


def labelled_text(fields: Sequence[tuple[str, Column, bool]], separator: str, strip: bool = False) -> Column:
    """``label value`` pairs in a row.

    Each field is (label, text, nullable): a nullable field makes the whole text NULL when it has no
    value, any other field is shown empty. ``strip`` removes white space at both ends of the text; as
    labels neither begin nor end with it, only the last value has any to lose.
    """
    pieces: list[Column] = []
    for index, (label, value, nullable) in enumerate(fields):
        pieces.append(F.lit(label if index == 0 else separator + label))
        if strip and index == len(fields) - 1:
            value = F.rtrim(value, F.lit(WHITE_SPACE))
        pieces.append(value if nullable else F.coalesce(value, F.lit("")))
    return F.concat(*pieces)


Resolver = Callable[[str], Column]


def from_columns(name: str) -> Column:
    return F.col(name)


def from_nothing(types: dict[str, str]) -> Resolver:
    """Resolve every column to a typed NULL: the text of a row that was never matched."""
    return lambda name: F.lit(None).cast(types[name])
