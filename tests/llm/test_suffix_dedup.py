import random
import re
from collections import defaultdict

import numpy as np

from wardline.llm.queries import QUERIES
from wardline.llm.suffix_dedup import LEAST_WORDS, REACH, merged, repeated_passages, selected


def repeated(rows):
    """(doc_id, text) of the documents with a run of LEAST_WORDS words that another document has."""
    rows = sorted(set(rows), key=str)
    holders = defaultdict(set)
    for k, (_, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        for i in range(len(words) - LEAST_WORDS + 1):
            holders[tuple(words[i : i + LEAST_WORDS])].add(k)
    return {rows[k][0] for ks in holders.values() if len(ks) > 1 for k in ks}


def test_planted_passages(frame, awkward_rows):
    random.seed(5)
    words = [f"w{i}" for i in range(2_000)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    planted, rows = [some(n) for n in (49, 50, 51, 55, 120)], []
    for i in range(60):
        rows.append((100 + i, " ".join([*some(random.randrange(60)), *planted[i % 5], *some(random.randrange(60))])))
    rows += [(200 + i, " ".join([*planted[4], *planted[4], *some(2)])) for i in range(20)]
    rows += [(300, "the " * 90), (301, "q " + "THE " * 60 + "r"), (302, " ".join(some(300)))] + awkward_rows
    found = repeated_passages(frame(rows)).collect()
    assert {r.doc_id for r in found} == repeated(rows)
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[doc_id].append(text or "")
    for r in found:
        passage = [t[r.start : r.end].lower().split() for t in texts[r.doc_id]]
        assert any(len(p) == r.n_words for p in passage)
    at = {r.doc_id: r for r in found}
    for i in range(60):
        if i % 5 in (1, 2, 3):  # a passage in the midst of other words is found from its first to its last word
            assert re.split(r"\s+", rows[i][1][at[100 + i].start : at[100 + i].end]) == planted[i % 5]
    assert repeated_passages(frame([])).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id for r in QUERIES["op9_suffix_dedup"](spark, sf_dir).collect()} == repeated(rows)


def test_every_window_has_a_place():
    rng = np.random.default_rng(1)
    for hashes in (rng.integers(0, 2**60, 500), rng.integers(0, 3, 500), np.zeros(500, int), np.tile([5, 1, 9], 200), np.arange(400)[::-1]):
        places = selected(hashes.astype(np.uint64))
        assert np.diff(np.concatenate([[-1], places, [len(hashes)]])).max() <= REACH
    assert len(selected(np.zeros(3_500, np.uint64))) <= 110
    assert not len(selected(np.zeros(REACH - 1, np.uint64)))


def test_passages_are_merged():
    assert merged([(0, 60, 9), (40, 130, 4), (140, 180, 1), (150, 200, None)]) == [(0, 130, 4), (140, 200, None)]


def brute_passages(rows):
    """{document: [(from word, to word)]} of the runs of windows that another document has."""
    rows = sorted(set(rows), key=str)
    holders = defaultdict(set)
    split = [(text or "").encode().lower().split() for _, text in rows]
    for k, words in enumerate(split):
        for i in range(len(words) - LEAST_WORDS + 1):
            holders[tuple(words[i : i + LEAST_WORDS])].add(k)
    spans = defaultdict(list)
    for k, words in enumerate(split):
        for i in range(len(words) - LEAST_WORDS + 1):
            if len(holders[tuple(words[i : i + LEAST_WORDS])]) > 1:
                if spans[k] and i < spans[k][-1][1]:
                    spans[k][-1][1] = i + LEAST_WORDS
                else:
                    spans[k].append([i, i + LEAST_WORDS])
    return sorted((rows[k][0], *span) for k, found in spans.items() for span in found)


def spans_of(rows, found):
    """The passages found as (doc_id, from word, to word), for rows with different ids."""
    texts = dict(rows)
    return sorted((r.doc_id, len(texts[r.doc_id][: r.start].split()), len(texts[r.doc_id][: r.end].split())) for r in found)


def test_passages_with_a_line_that_many_documents_share(frame):
    random.seed(11)
    words = [f"w{i}" for i in range(5_000)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    for length in (20, 34, 49):
        line = some(length)
        rows = [(1_000 + i, " ".join([*some(80), *line, *some(80)])) for i in range(200)]
        for i in range(60):  # only the words before the line tell the pair from the others
            lead = some(random.randrange(50 - length, 56 - length))
            rows += [(10 * i + j, " ".join([*some(60), *lead, *line, *some(60)])) for j in range(2)]
        expected = brute_passages(rows)
        assert len({doc_id for doc_id, *_ in expected if doc_id < 1_000}) == 120
        assert spans_of(rows, repeated_passages(frame(rows)).collect()) == expected


def test_every_copy_inside_a_document_is_found(frame):
    random.seed(12)
    words = [f"w{i}" for i in range(5_000)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    rows = []
    for i in range(40):
        passage = some(60)
        many = [word for _ in range(6) for word in [*passage, *some(70)]]
        rows += [(10 * i, " ".join([*some(30), *many])), (10 * i + 1, " ".join([*some(30), *passage, *some(30)]))]
    expected = brute_passages(rows)
    assert len(expected) >= 40 * 7
    assert spans_of(rows, repeated_passages(frame(rows)).collect()) == expected


def test_passages_are_whole_among_many_holders(frame):
    random.seed(13)
    words = [f"w{i}" for i in range(5_000)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    rows = []
    for i in range(20):
        passage = some(400)
        rows += [(100 * i + j, " ".join([*some(20), *passage, *some(20)])) for j in (50, 51)]
        for j in range(12):  # holders of a part of it, which come between the two
            begin = random.randrange(340)
            rows.append((100 * i + j, " ".join([*some(20), *passage[begin : begin + 55], *some(20)])))
    expected = brute_passages(rows)
    found = repeated_passages(frame(rows)).collect()
    assert spans_of(rows, found) == expected
    assert all(r.n_words == 400 for r in found if r.doc_id % 100 >= 50)


def test_frequent_blocks_give_the_same(frame):
    random.seed(14)
    words = [f"w{i}" for i in range(3_000)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    line, rows = some(40), []
    for i in range(30):
        lead, tail = some(6), some(6)
        rows += [(10 * i + j, " ".join([*some(60), *lead, *line, *tail, *some(60)])) for j in range(2)]
        rows += [(10 * i + 2, " ".join([*some(50), *line, *tail, *some(9)])), (10 * i + 3, " ".join([*some(9), *lead, *line, *some(50)]))]
    expected = brute_passages(rows)
    every = [repeated_passages(frame(rows), most).collect() for most in (20_000, 50, 1)]
    for found in every:
        assert spans_of(rows, found) == expected
    assert sorted(every[0]) == sorted(every[1]) == sorted(every[2])


def test_other_documents(frame):
    text = " ".join(f"v{i}" for i in range(70))
    rows = [(7, text), (3, text + " a"), (5, "b " + text), (None, "c " + text)]
    for most in (20_000, 1):
        got = {r.doc_id: r.other_doc_id for r in repeated_passages(frame(rows), most).collect()}
        assert got == {7: 3, 5: 3, 3: 7, None: 3}
        alone = {r.doc_id: r.other_doc_id for r in repeated_passages(frame([rows[0], rows[3]]), most).collect()}
        assert alone == {7: None, None: 7}
