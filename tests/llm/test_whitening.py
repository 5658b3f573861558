import math
import random
from decimal import Decimal

import numpy as np
import pytest

from wardline.llm import whitening
from wardline.llm.queries import QUERIES
from wardline.llm.whitening import largest_roots, null_space, polynomials_modulo, primes_beyond, whiten_embeddings


def usable(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c * 1024) < 2**62 for c in v)]
    lengths = [len(v) for _, v in kept]
    d = max(set(lengths), key=lambda x: (lengths.count(x), x), default=0)
    return [(i, [math.floor(c * 1024) + 100_000 for c in v]) for i, v in kept if len(v) == d and d]


def check_integers(df, rows, components=8):
    """Everything that plain integers tell."""
    got = df.collect()
    kept = usable(rows)
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    centred = np.asarray([[n * a - s for a, s in zip(x, sums)] for _, x in kept], object)
    covariance = (centred.T @ centred / n**3).astype(float)
    values = np.linalg.eigvalsh(covariance)[::-1]
    most = min(components, d)
    assert len(got) == n * most and all(r.n == n for r in got)
    wide = sorted(((i, sum(int(v) ** 2 for v in c)) for (i, _), c in zip(kept, centred)), key=str)
    assert sorted(((r.vec_id, int(r.deviation_wide)) for r in got if r.component == 1), key=str) == wide
    assert all(r.deviation == (int(r.deviation_wide) if r.deviation_wide < 2**63 else None) for r in got)
    return got, n, d, values, covariance, centred, kept


def check(df, rows, components=8):
    """Against integers in plain Python and numpy's eigenvalues."""
    got, n, d, values, covariance, centred, kept = check_integers(df, rows, components)
    most = min(components, d)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    rank = sum(v > 1e-9 * values[0] for v in values[:most]) if values[0] > 0 else 0
    assert sorted(by) == list(range(1, most + 1))
    for k in range(1, most + 1):
        assert all((r.whitened is None) == (k > rank) for r in by[k])
        if values.sum() > 0:
            assert abs(by[k][0].explained - max(values[k - 1], 0) / values.sum()) < 1e-9
    if rank and len({i for i, _ in kept}) == n:
        order = {i: at for at, (i, _) in enumerate(kept)}
        whitened = np.zeros((n, rank))
        for k in range(1, rank + 1):
            for r in by[k]:
                whitened[order[r.vec_id], k - 1] = r.whitened
        error = np.abs(np.cov(whitened.T, bias=True).reshape(rank, rank) - np.eye(rank)).max()
        assert error < 1e-9 and all(abs(r.identity_error - error) < 1e-9 for r in got)
        vectors = np.linalg.lstsq(centred.astype(float) / n, whitened, rcond=None)[0] * np.sqrt(values[:rank])
        assert np.allclose(covariance @ vectors, vectors * values[:rank], rtol=0, atol=1e-7 * values[0])
    if not rank:
        assert all(r.identity_error is None for r in got)


def table(spark, rows):
    clash = ["n", "x", "c", "w", "Component", "deviation", "i", "j"]
    schema = "vec_id long, embedding array<float>, " + ", ".join(f"`{name}` string" for name in clash)
    return spark.createDataFrame([(i, v, *["q"] * len(clash)) for i, v in rows], schema)


def vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(0, 0.2, (d, d)) * np.linspace(2, 0.1, d)[:, None]
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(rng.normal(0, 1, (n, d)) @ mixed)]


def test_awkward_vectors(spark):
    rows = vectors(300, 12) + [
        (900, None), (901, []), (902, [0.0] * 11 + [None]), (903, [0.0] * 11 + [float("nan")]), (904, [float("inf")] + [0.0] * 11),
        (905, [1.0] * 5), (906, [3e38] + [0.0] * 11),
    ]
    check(whiten_embeddings(table(spark, rows)), rows)
    repeated = rows + [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1])]
    check(whiten_embeddings(table(spark, repeated)), repeated)


def test_large_entries(spark):
    """Products beyond 64 bits are summed exactly, deviations that are no long are null."""
    rows = vectors(50, 4) + [(1000, [2.0**40, -(2.0**41), 1.5, 0.25]), (1001, [2.0**20, 2.0**30, -7.0, 1.0])]
    got = check_integers(whiten_embeddings(table(spark, rows)), rows)[0]
    assert all(r.deviation is None for r in got)
    assert all(r.whitened is not None and r.identity_error < 1e-4 for r in got)


@pytest.mark.parametrize("rows", [
    [(1, [0.5, 0.25])],
    [(1, [0.5, 0.25]), (2, [0.5, 0.25])],
    [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)],
    [(i, [float(i % 3)]) for i in range(9)],
])
def test_without_full_rank(spark, rows):
    check(whiten_embeddings(table(spark, rows)), rows)


def test_equal_eigenvalues(spark):
    rows = [(k, v) for k, v in enumerate([[s * (i == j) for j in range(4)] for i in range(4) for s in (1.0, -1.0)])]
    got = whiten_embeddings(table(spark, rows)).collect()
    assert max(r.identity_error for r in got) < 1e-12 and {r.explained for r in got} == {0.25}


def test_empty_table(spark):
    assert whiten_embeddings(table(spark, [])).collect() == []
    assert whiten_embeddings(table(spark, [(1, None), (2, [])])).collect() == []


def test_polynomials_against_fractions():
    """Characteristic polynomials modulo primes against products of (x - root) for matrices with known roots."""
    random.seed(5)
    for d in range(1, 9):
        roots = [random.randrange(0, 9) for _ in range(d)]
        matrix = [[roots[i] if i == j else random.randrange(-5, 5) if j > i else 0 for j in range(d)] for i in range(d)]
        for _ in range(6):  # changes of basis keep the polynomial
            a, b, f = random.randrange(d), random.randrange(d), random.randrange(-3, 4)
            if a != b:
                matrix[a] = [x + f * y for x, y in zip(matrix[a], matrix[b])]
                for row in matrix:
                    row[b] -= f * row[a]
        expected = [1]
        for root in roots:
            expected = [x - root * y for x, y in zip([*expected, 0], [0, *expected])]
        primes = primes_beyond(10**20)
        for prime, row in zip(primes, polynomials_modulo(matrix, primes).tolist()):
            assert row == [c % prime for c in expected]
        wanted = sorted({r for r in roots if r}, reverse=True)
        found = largest_roots(expected, d)
        assert [(r >> whitening.PLACES, m) for r, m in found] == [(r, roots.count(r)) for r in wanted]


def test_null_space_has_all_directions():
    vectors = null_space([[2, 0, 0], [0, 7, 0], [0, 0, 2]], Decimal(2), 2)
    made = np.asarray([[float(v) for v in row] for row in vectors])
    assert np.allclose(made @ made.T, np.eye(2)) and np.allclose(made[:, 1], 0)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, sf_dir), rows)
