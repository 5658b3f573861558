import random

import pytest

#: Columns beside doc_id and text whose names the operators use for themselves.
CLASHING = ["n", "key", "row", "part", "a", "b", "score", "kept", "recipe", "base_spans", "Text_sha256", "component", "length", "quality_score"]


@pytest.fixture(scope="session")
def frame(spark):
    """Make a table of (doc_id, text) with further columns of awkward names."""

    def make(rows):
        schema = "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in CLASHING)
        return spark.createDataFrame([(i, t, *["x"] * len(CLASHING)) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def awkward_rows():
    """Null and empty texts, null and repeated ids, repeated rows, ties, a very long text."""
    random.seed(7)
    words = [f"w{i}" for i in range(500)]
    long_text = " ".join(random.choice(words) for _ in range(60_000))
    return [
        (1, None), (2, ""), (3, "   \n "), (None, "Some text here. Another one!"), (None, None), (5, "Some TEXT here. Another one!"),
        (5, "Some TEXT here. Another one!"), (6, "other words under one id"), (6, "x"), (7, "é漢字😀 ſ K"), (8, long_text), (9, long_text + " end"),
        (10, "a" * 30_000), (-4, "Some text here. Another one!"),
    ]


@pytest.fixture(scope="session")
def awkward(frame, awkward_rows):
    return frame(awkward_rows)
