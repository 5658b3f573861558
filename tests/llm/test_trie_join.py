import random

import numpy as np
import pytest

from tests.llm.test_near_dedup import brute, planted
from wardline.llm import trie_join
from wardline.llm.queries import QUERIES
from wardline.llm.shingles import shingles, word_hashes
from wardline.llm.trie_join import PrefixTree, bucket_keys, jaccard_join, tree_links


def expected(rows, words, parts, whole):
    return [(i, n, None if i is None else component) for i, n, component, _ in brute(rows, words, parts, whole)]


def found(df, *arguments):
    return sorted(map(tuple, jaccard_join(df, *arguments).collect()), key=str)


SHORT = [(20, "a b"), (21, "A  b"), (22, "a\tB "), (23, "a b c"), (24, "a b c d e f g h i j k l"), (25, "a b c d e f g h i j k l m")]
TIED = [(6, "p q r s t"), (30, "other words under one id"), (2, "x1 x2 x3"), (31, "X1 x2 x3")]


@pytest.mark.parametrize("words,parts", [(3, 90), (5, 80), (1, 60)])
def test_planted_and_awkward(frame, awkward_rows, words, parts):
    rows = planted() + awkward_rows + SHORT + TIED
    random.Random(3).shuffle(rows)
    assert found(frame(rows), words, parts, 100) == expected(rows, words, parts, 100)


@pytest.mark.parametrize("tokens,work", [(2_000, 1 << 33), (1 << 22, 60_000), (300, 3_000)])
def test_large_families(frame, monkeypatch, tokens, work):
    """Families beyond the bounds are joined by buckets, and these in blocks."""
    monkeypatch.setattr(trie_join, "MOST_TOKENS", tokens)
    monkeypatch.setattr(trie_join, "MOST_WORK", work)
    rows = planted()
    assert found(frame(rows), 3, 85, 100) == expected(rows, 3, 85, 100)


def test_buckets_lose_no_link():
    """Any two sets that are linked have a key in common, however their differing n-grams fall."""
    rng = np.random.default_rng(4)
    for trial in range(4_000):
        parts, whole = [(90, 100), (80, 100), (60, 100)][trial % 3]
        n = int(rng.integers(2, 120))
        one = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 4 + 1))
        two = np.concatenate([one[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
        one, two = np.unique(one), np.unique(two)
        if not len(two) or np.array_equal(one, two):
            continue
        shared = len(np.intersect1d(one, two))
        if whole * shared >= parts * (len(one) + len(two) - shared):
            assert np.intersect1d(bucket_keys(one, parts, whole), bucket_keys(two, parts, whole)).size


def random_sets(rng, m):
    base = rng.integers(0, 60, 30)
    made = {}
    for _ in range(m):
        one = np.unique(np.concatenate([base[rng.random(30) < 0.9], rng.integers(0, 80, int(rng.integers(1, 6)))]).astype(np.uint64))
        made[one.tobytes()] = one
    return list(made.values())


@pytest.mark.parametrize("parts", [50, 80, 90])
def test_trees_find_every_link(parts):
    """All links of every set by its run down the tree, and the components that joins make of them."""
    rng = np.random.default_rng(parts)
    for _ in range(30):
        sets = random_sets(rng, int(rng.integers(2, 40)))
        ordered = [s.astype(np.int32) for s in sets]
        tree = PrefixTree(ordered)
        held = np.zeros(100, np.int64)
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, one in enumerate(ordered):
            held[one] = 1
            got = {tree.order[j] for j in tree.linked(one, held, np.zeros(len(tree.depth), bool), parts, 100)}
            held[one] = 0
            common = [len(np.intersect1d(one, other)) for other in ordered]
            links = {j for j, c in enumerate(common) if 100 * c >= parts * (len(one) + len(ordered[j]) - c)}
            assert got == links
            for j in links:
                parent[max(root(i), root(j))] = min(root(i), root(j))
        wanted = [root(i) for i in range(len(sets))]
        everyone = np.ones(len(sets), bool)
        parent[:] = range(len(sets))
        for a, b in tree_links(sets, np.arange(len(sets)), everyone, everyone, parts, 100):
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert [root(i) for i in range(len(sets))] == wanted


def test_empty_table(frame):
    assert found(frame([])) == []
    assert found(frame([(1, None), (None, "a")])) == [(1, 0, 1), (None, 1, None)]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op11_jaccard_join"](spark, sf_dir).collect())) == sorted(expected(rows, 3, 90, 100))


def test_one_word_without_end():
    assert len(bucket_keys(shingles(word_hashes("a " * 50_000), 3), 90, 100)) == 0
