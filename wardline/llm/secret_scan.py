"""Secret scans with multipart linking, with DataFrame functions only.

Strong spans (``assign``, ``access``, ``hex``) always count. Weak ones (``id``: access identifiers of other forms,
``secret``: bare 40-character tokens with a digit, ``endpoint``: URLs) are reported only where complementary parts lie
in their scope, SCOPE characters to either side: an id beside a secret, a secret beside an id, an endpoint beside both.
That interval join compares each span with the nearest parts before and after it, which running maxima and minima over
the ordered spans give. They are found block by block, so the work grows with the spans (their sorting aside) and no row
moves.

Null or empty text has no span. Each row is judged on its own, so repeated rows, a null doc_id and rows in any order
give the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents_of, free_name

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
_ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
_ID = (
    r"""(?<![A-Za-z0-9])(?:(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}"""
    r"""|(?i:access|client|account)[_-]?(?i:key[_-]?)?(?i:id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{6,})"""
)
_SECRET = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
_ENDPOINT = r"""(?i:https?)://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s"'<>]*"""
SCOPE = 256
_FAR = 1 << 30
_SPANS = "array<struct<start: int, kind: int, end: int>>"


#: Running values are found in blocks of this many, so no array is copied once for each of its elements.
_BLOCK, _LEVELS = 128, 1
#: Texts are cut into parts of this many characters, as a place in a string is only found from its start.
_PART = 1_024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, merge: Callable[[Column, Column], Column], start: int, levels: int = _LEVELS) -> Column:
    """What ``merge`` makes of the whole numbers before each, ``start`` where there are none.

    Blocks are merged first, then what comes before each block is found in the same way, then the places inside.
    """

    def inside(block: Column, first: Column) -> Column:
        return F.aggregate(
            block, F.struct(first.alias("so_far"), F.array().cast("array<int>").alias("out")),
            lambda s, v: F.struct(merge(s["so_far"], v).alias("so_far"), F.concat(s["out"], F.array(s["so_far"])).alias("out")),
            lambda s: s["out"],
        )

    def in_blocks(all_values: Column) -> Column:
        last = ((F.size(all_values) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_values, b * _BLOCK + 1, F.lit(_BLOCK)))

        def joined(cut: Column) -> Column:
            merged = F.transform(cut, lambda block: F.aggregate(block, F.lit(start), lambda x, y: merge(x, y)))
            return F.flatten(F.zip_with(cut, _running(merged, merge, start, levels - 1), inside))

        return _let(blocks, joined)

    if not levels:
        return inside(values, F.lit(start))
    return _let(values, lambda v: F.when(F.size(v) <= _BLOCK, inside(v, F.lit(start))).otherwise(in_blocks(v)))


def _found(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose ``value_group`` has at least ``least`` characters, in order."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    # text between the matches and the matches themselves, in turn, give the places
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("whole"), F.length(v).alias("value")))
    parts = F.zip_with(F.slice(gaps, 1, F.size(whole)), sizes, lambda gap, size: F.struct(
        F.length(gap).alias("gap"), size["whole"].alias("whole"), size["value"].alias("value")
    ))

    def placed(matches: Column) -> Column:
        before = _running(F.transform(matches, lambda m: m["gap"] + m["whole"]), lambda x, y: x + y, 0)
        spans = F.zip_with(matches, before, lambda m, at: F.struct(
            (at + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + m["gap"] + m["whole"]).alias("end"), m["value"].alias("value")
        ))
        return F.transform(F.filter(spans, lambda s: s["value"] >= least), lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")
        ))

    empty = F.array().cast(_SPANS)
    return F.when(F.regexp_like(text, F.lit(pattern)), _let(parts, placed)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The strong spans, ordered by start and kind."""
    return F.array_sort(F.concat(
        _found(text, _ASSIGN, 0, value_group=2, least=8), _found(text, _ACCESS, 1), _found(text, _HEX, 2),
    ))


def _weak_spans(text: Column) -> Column:
    return F.concat(_found(text, _ID, 3), _found(text, _SECRET, 4), _found(text, _ENDPOINT, 5))


def _linked(base: Column, weak: Column) -> Column:
    """All spans in order: the strong ones and the weak ones with their complements in scope."""

    def linked(spans: Column) -> Column:
        is_id = lambda p: p["kind"].isin(1, 3)
        is_secret = lambda p: p["kind"].isin(0, 2, 4)
        ends = lambda kind: F.transform(spans, lambda p: F.when(kind(p), p["end"]).otherwise(-_FAR))
        starts = lambda kind: F.reverse(F.transform(spans, lambda p: F.when(kind(p), p["start"]).otherwise(_FAR)))
        seen = F.arrays_zip(
            spans.alias("span"), _running(ends(is_id), F.greatest, -_FAR).alias("id_before"),
            _running(ends(is_secret), F.greatest, -_FAR).alias("secret_before"),
            _running(ends(lambda p: p["kind"] < 3), F.greatest, -_FAR).alias("covered"),
            F.reverse(_running(starts(is_id), F.least, _FAR)).alias("id_after"),
            F.reverse(_running(starts(is_secret), F.least, _FAR)).alias("secret_after"),
        )

        def reported(row: Column) -> Column:
            start, kind, end = (row["span"][name] for name in ("start", "kind", "end"))
            near_id = (start - row["id_before"] <= SCOPE) | (row["id_after"] - end <= SCOPE)
            near_secret = (start - row["secret_before"] <= SCOPE) | (row["secret_after"] - end <= SCOPE)
            complete = F.when(kind == 3, near_secret).when(kind == 4, near_id).when(kind == 5, near_id & near_secret)
            return (kind < 3) | ((start >= row["covered"]) & complete)

        return F.transform(F.filter(seen, reported), lambda row: row["span"])

    return F.when(F.size(weak) > 0, _let(F.array_sort(F.concat(base, weak)), linked)).otherwise(base)


def _as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _with_spans(rows: DataFrame, text: Column) -> tuple[DataFrame, str, str]:
    """``rows`` with the strong spans and with all spans, each pattern matched once; the names of the two columns."""
    base, weak, reported = (free_name(rows, name) for name in ("base_spans", "weak_spans", "all_spans"))
    rows = rows.withColumn(base, base_spans(text)).withColumn(weak, _weak_spans(text))
    return rows.withColumn(reported, _linked(F.col(base), F.col(weak))).drop(weak), base, reported


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text."""
    found, base, reported = _with_spans(documents_of(docs), F.col("text"))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_as_text(F.col(base)).cast("binary"), 256).alias("base_sha256"),
        _as_text(F.col(reported)).alias("spans"),
    )


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; ``n_chars`` follows the text. Null text stays null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found, _, reported = _with_spans(docs, text)

    def cut(parts: Column, start: Column, end: Column) -> Column:
        """The text from ``start`` to ``end``, put together from its parts."""
        touched = F.sequence((start / _PART).cast("int"), ((end - 1) / _PART).cast("int"))
        pieces = F.transform(touched, lambda k: F.substring(
            F.get(parts, k), F.greatest(start - k * _PART, F.lit(0)) + 1,
            F.least(end - k * _PART, F.lit(_PART)) - F.greatest(start - k * _PART, F.lit(0)),
        ))
        return F.when(end > start, F.array_join(pieces, "")).otherwise("")

    def joined(parts: Column) -> Column:
        ends = F.transform(reported, lambda s: s["end"])
        left = F.zip_with(reported, _running(ends, F.greatest, 0), lambda s, at: F.struct(at.alias("start"), s["start"].alias("end")))
        apart = F.filter(left, lambda s: s["end"] >= s["start"])
        before = F.array_join(F.transform(apart, lambda s: F.concat(cut(parts, s["start"], s["end"]), F.lit(mask))), "")
        return F.concat(before, cut(parts, F.array_max(ends), F.length(text)))

    masked = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), joined)
    found = found.withColumn("text", F.when(F.size(reported) > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(reported) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)
