import hashlib
import string

from wardline.llm import exact_dedup
from wardline.llm.exact_dedup import chunks_of, exact_duplicates
from pyspark.sql import functions as F

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    expected = []
    for doc_id, text in rows:
        norm = (text or "").translate(LOWER)
        ids = [i for i in groups[norm] if i is not None]
        keep = max(ids) if ids else None
        expected.append((doc_id, keep, len(groups[norm]), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(expected, key=str)


def found(df):
    return sorted(map(tuple, exact_duplicates(df).collect()), key=str)


def test_awkward_documents(awkward, awkward_rows, frame):
    assert found(awkward) == brute(awkward_rows)
    assert found(frame([])) == []


def test_long_texts_that_differ_in_one_place(frame, awkward_rows):
    text = awkward_rows[10][1]
    rows = [(1, text), (2, text.upper()), (3, text[:-1] + "!"), (4, "!" + text[1:]), (5, text[:100_000] + text[100_001:]), (6, text.lower()), (7, "É"), (8, "é")]
    assert found(frame(rows)) == brute(rows)


def test_chunks_cover_the_text(frame, awkward_rows):
    for row in frame(awkward_rows).select("text", chunks_of(F.col("text")).alias("chunks")).collect():
        assert "".join(row.chunks or []) == (row.text or "")
        assert all(len(chunk) <= 2049 for chunk in row.chunks or [])


def test_contested_identifiers(frame, monkeypatch):
    """Hashes that collide still give right groups."""
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    rows = [(1, "aaa"), (2, "bbb"), (3, "AAA"), (4, "cc"), (5, "")]
    assert exact_dedup.contested_hashes(frame(rows)).count() == 1
    assert found(frame(rows)) == brute(rows)


def test_plan_has_no_python(awkward):
    plan = exact_duplicates(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
