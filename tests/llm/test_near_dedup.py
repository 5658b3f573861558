import random
from collections import defaultdict

import pytest

from wardline.llm import near_dedup
from wardline.llm.graph import components
from wardline.llm.near_dedup import near_duplicates
from wardline.llm.queries import QUERIES


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, width, parts, whole):
    sets = [shingle_set(text, width) for _, text in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, one in enumerate(sets):
        if rows[k][0] is not None:
            common = defaultdict(int)
            for shingle in one:
                for j in holders[shingle]:
                    common[j] += 1
                holders[shingle].append(k)
            for j, n in common.items():
                if whole * n >= parts * (len(one) + len(sets[j]) - n):
                    a, b = find(rows[k][0]), find(rows[j][0])
                    parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i), find(i) == i) if i is not None else (None, len(s), None, True) for (i, _), s in zip(rows, sets)), key=str)


def found(df, *arguments):
    return sorted(map(tuple, near_duplicates(df, *arguments).collect()), key=str)


def planted():
    """Copies around one text, a chain that drifts, many texts with one passage, some of them in pairs."""
    random.seed(11)
    words = [f"w{i}" for i in range(3_000)]
    some = lambda n: [random.choice(words) for _ in range(n)]
    rows, base, passage, chain = [], some(150), some(50), some(90)
    for _ in range(60):
        near = list(base)
        for _ in range(random.randrange(6)):
            near[random.randrange(150)] = random.choice(words)
        rows.append(near)
    for _ in range(80):
        near = passage + some(30)
        rows.append(near)
        if random.random() < 0.3:
            rows.append([*near[:-2], "zz", near[-1]])
    for _ in range(30):
        chain = list(chain)
        chain[random.randrange(90)] = random.choice(words)
        rows.append(chain)
    return [(1_000 + i, " ".join(w)) for i, w in enumerate(rows)]


def test_planted_and_awkward(frame, awkward_rows):
    rows = planted() + awkward_rows + [(20, "a b"), (21, "A  b"), (22, "a\tB "), (23, "a b c")]
    random.Random(3).shuffle(rows)
    assert found(frame(rows), 3, 85, 100) == brute(rows, 3, 85, 100)


def test_exact_join_finds_what_full_windows_leave_out(frame, monkeypatch):
    """With one order and a window of one almost every node is uncertain."""
    monkeypatch.setattr(near_dedup, "TREES", 2)
    monkeypatch.setattr(near_dedup, "_ODD", near_dedup._ODD[:16])
    monkeypatch.setattr(near_dedup, "_SHIFT", near_dedup._SHIFT[:16])
    groups = near_dedup.components
    nodes = frame(planted())
    features = near_dedup._features(nodes, 3)
    ids = features.selectExpr("doc_id", "doc_id as component")
    sets = near_dedup._sets(nodes, ids.select("doc_id"), 3)
    links = near_dedup._confirmed(near_dedup._exact_pairs(ids, sets, 85, 100), sets, 85, 100)
    expected = {(a, c) for a, _, c, _ in brute(planted(), 3, 85, 100)}
    got = dict(map(tuple, groups(links).collect()))
    assert {(a, got.get(a, a)) for a, _ in planted()} == expected


def test_empty_table(frame):
    assert found(frame([])) == []
    assert found(frame([(1, None), (None, "a")])) == [(1, 0, 1, True), (None, 1, None, True)]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op5_near_dedup"](spark, sf_dir).collect()), key=str) == brute(rows, 3, 85, 100)


@pytest.mark.parametrize("links,expected", [
    ([(i, i + 1) for i in range(1, 40)], {i: 1 for i in range(1, 41)}),
    ([(9, i) for i in range(20, 60)], {**{i: 9 for i in range(20, 60)}, 9: 9}),
    ([(5, 3), (7, 5), (8, 8), (-2, 40)], {5: 3, 3: 3, 7: 3, -2: -2, 40: -2}),
    ([], {}),
])
def test_components(spark, links, expected):
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == expected
