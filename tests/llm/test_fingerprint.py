import hashlib

import numpy as np

from wardline.llm.fingerprint import edited, fingerprint, fingerprint_documents, likeness
from wardline.llm.queries import QUERIES


def shingle_set(text):
    words = text.encode().lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def similarity(left, right):
    a, b = shingle_set(left), shingle_set(right)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_full_sets(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op3_fingerprint"](spark, sf_dir).collect()}
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert len(rows) == len(texts)
    errors = []
    for i, (doc_id, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        row = rows[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == fingerprint(text).hex() and row.edited_fingerprint == fingerprint(changed).hex()
        errors += [row.near_edited - similarity(text, changed), row.near_next - similarity(text, following)]
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.04


def test_awkward_documents(awkward, awkward_rows, frame):
    rows = fingerprint_documents(awkward).collect()
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(rows) == len(awkward_rows)
    assert prints[1] == prints[2] == prints[3] == {""}
    assert prints[5] == {fingerprint("some text here. another one!").hex()}
    assert fingerprint_documents(frame([])).count() == 0
    alone = fingerprint_documents(frame([(3, "one two three")])).first()
    assert alone.near_edited < 1 and alone.near_next == 1.0


def test_likeness_of_half_changed_texts():
    left = " ".join(f"a{i}" for i in range(3_000))
    right = " ".join(f"a{i}" if i < 2_000 else f"b{i}" for i in range(3_000))
    assert abs(likeness(fingerprint(left), fingerprint(right)) - similarity(left, right)) < 0.1
    assert likeness(fingerprint("x"), fingerprint("")) == 0.0 and likeness(b"", b"") == 1.0
    assert likeness(fingerprint("a b c"), fingerprint("A  b\tC")) == 1.0


def test_edited():
    assert edited("abcde", "xyz") == "abcxy" and edited("abcd", "x") == "abx" and edited("", "x") == "" and edited("é😀", "漢") == "é漢"
