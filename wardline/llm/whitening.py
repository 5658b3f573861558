"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

An entry c becomes the integer floor(1024 * c) + 100000. Products of the integers are summed exactly in the tasks, so
n * n times the covariance V is a matrix of integers. Its characteristic polynomial is found modulo one prime after the
other, by reduction to Hessenberg form in Spark tasks, and put together by Chinese remaindering. All its roots are real,
so the changes of sign among the coefficients after a shift count the roots above a point exactly; halving by that count
isolates the largest ones, equal ones included. Components span the null space of the matrix less a root, by inverse
iteration in decimal numbers of DIGITS digits. What passes through the driver depends on the dimension alone.

Vectors that are null or hold a null, NaN, infinite or too large entry (1024 * c beyond 2**62) are left out, as are those
whose length is not the commonest one (of equally common ones the longest). Repeated rows count each; a null vec_id stays
null. Components beyond the rank have no variance: explained 0, whitened null; identity_error is over the others and null
if there are none. ``deviation`` is null where it is no long, ``deviation_wide`` has 38 digits. No usable vector: no row.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import map_batches, stored

SCALE, SHIFT = 1_024, 100_000
COMPONENTS = 8
#: Binary places of a root and decimal digits of a component while it is computed.
PLACES, DIGITS = 120, 120
PRIMES_PER_TASK = 32
_LIMB, _LIMBS = 40, 4


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable vectors, all of one length."""
    entries = F.col(f"`{vector_column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), entries.alias("c"))
    fits = lambda c: c.isNotNull() & (F.abs(c * SCALE) < float(2**62))
    rows = rows.where(F.col("c").isNotNull()).where(F.forall("c", lambda c: F.coalesce(fits(c), F.lit(False))))
    lengths = rows.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = commonest[0]["d"] if commonest else 0
    return rows.where((F.size("c") == d) & (F.size("c") > 0)).select(
        "vec_id", F.transform("c", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x")
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) - SHIFT


def _limbs(y: np.ndarray, bits: int = 20) -> list[np.ndarray]:
    """``y`` as balanced limbs whose products can be summed exactly in doubles."""
    limbs, half = [], 1 << (bits - 1)
    while True:
        low = ((y + half) & ((1 << bits) - 1)) - half
        limbs.append(low.astype(np.float64))
        y = (y - low) >> bits
        if not y.any():
            return limbs


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, sums of products) of the integers less SHIFT, exact."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(0))
            for begin in range(0, len(y), 1 << 13):
                some = y[begin : begin + (1 << 13)]
                n += len(some)
                limbs = _limbs(some)
                for a, left in enumerate(limbs):
                    sums = sums + left.sum(axis=0).astype(np.int64).astype(object) * (1 << (20 * a))
                    for b, right in enumerate(limbs):
                        products = products + (left.T @ right).astype(np.int64).astype(object) * (1 << (20 * (a + b)))
        if not n:
            return
        d = len(sums)
        rows = [(-1, -1, n), *((i, -1, sums[i]) for i in range(d)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
        limbs = [[(int(v) >> (_LIMB * k)) & ((1 << _LIMB) - 1) for _, _, v in rows] for k in range(_LIMBS - 1)]
        limbs.append([int(v) >> (_LIMB * (_LIMBS - 1)) for _, _, v in rows])
        yield pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)],
            names=["i", "j", *(f"limb{k}" for k in range(_LIMBS))],
        )

    layout = "i int, j int, " + ", ".join(f"limb{k} long" for k in range(_LIMBS))
    folded = map_batches(vectors.select("x"), fold, layout)
    total = folded.groupBy("i", "j").agg(*[F.sum(F.col(f"limb{k}").cast("decimal(20,0)")).alias(f"limb{k}") for k in range(_LIMBS)])
    found = {(r["i"], r["j"]): sum(int(r[f"limb{k}"]) << (_LIMB * k) for k in range(_LIMBS)) for r in total.collect()}
    n = found.pop((-1, -1), 0)
    d = sum(j == -1 for _, j in found)
    return n, [found[i, -1] for i in range(d)], [[found[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def _is_prime(n: int) -> bool:
    """Certain below 3,215,031,751."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if n != base and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, from the greatest down, whose product exceeds ``bound``."""
    primes, product, candidate = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(candidate):
            primes.append(candidate)
            product *= candidate
        candidate -= 2
    return primes


def polynomials_modulo(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo each prime, highest power first, all primes side by side."""
    p = np.asarray(primes, np.int64)
    d = len(matrix)
    h = np.asarray([[[v % q for v in row] for row in matrix] for q in primes], np.int64).reshape(len(primes), d, d)
    for m in range(1, d - 1):
        below = h[:, m:, m - 1] != 0
        first = below.argmax(axis=1)
        for k in np.flatnonzero(first):  # another row takes the place of a zero
            rows = [m, m + first[k]]
            h[k, rows] = h[k, rows[::-1]]
            h[k][:, rows] = h[k][:, rows[::-1]]
        inverse = np.asarray([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, m, m - 1], primes)], np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p[:, None]
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m, None, :] % p[:, None, None]) % p[:, None, None]
        added = (h[:, :, m + 1 :] * u[:, None, :] % p[:, None, None]).sum(axis=2)
        h[:, :, m] = (h[:, :, m] + added) % p[:, None]
    found = np.zeros((d + 1, len(primes), d + 1), np.int64)  # found[k]: polynomial of the leading block, lowest power first
    found[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros_like(found[0])
        new[:, 1:] = found[k - 1, :, :-1]
        product = np.ones(len(primes), np.int64)
        new = (new - h[:, k - 1, k - 1, None] * found[k - 1] % p[:, None]) % p[:, None]
        for i in range(k - 1, 0, -1):
            product = product * h[:, i, i - 1] % p
            factor = h[:, i - 1, k - 1] * product % p
            new = (new - factor[:, None] * found[i - 1] % p[:, None]) % p[:, None]
        found[k] = new
    return found[d][:, ::-1]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), highest power first, of a matrix without negative eigenvalue; tasks share the primes.

    The k-th elementary symmetric function of numbers of sum T, none negative, is at most C(d, k) * (T / d)**k.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(bound)
    sent = spark.sparkContext.broadcast((matrix, primes))
    shares = -(-len(primes) // PRIMES_PER_TASK)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, all_primes = sent.value
        for batch in batches:
            for share in batch.column(0).to_pylist():
                some = all_primes[share::shares]
                yield pa.record_batch([
                    pa.array(some, pa.int64()), pa.array(polynomials_modulo(of, some).tolist(), pa.list_(pa.int64())),
                ], names=["prime", "coefficients"])

    rows = map_batches(spark.range(0, shares, 1, shares), solve, "prime long, coefficients array<long>").collect()
    product = math.prod(primes)
    parts = [(product // r["prime"] * pow(product // r["prime"], -1, r["prime"]), r["prime"], r["coefficients"]) for r in rows]
    found = []
    for k in range(d + 1):
        size = sum(part * (c[k] * (-1) ** k % prime) for part, prime, c in parts) % product
        found.append((-1) ** k * size)
    return found


def _roots_above(coefficients: list[int], at: int) -> int:
    """How many roots, all real, are greater than ``at``: the changes of sign after a shift to it."""
    shifted = list(coefficients)
    for end in range(len(shifted) - 1, 0, -1):
        for k in range(1, end + 1):
            shifted[k] += at * shifted[k - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], most: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(root * 2**places, rounded up; multiplicity) of the positive roots, falling, until ``most`` are found."""
    scaled = [c << (places * k) for k, c in enumerate(polynomial)]
    above = -polynomial[1] << places
    found: list[tuple[int, int]] = []
    waiting = [(0, above, _roots_above(scaled, 0), 0)]
    while waiting:
        low, high, from_low, from_high = waiting.pop()
        if from_low == from_high or from_high >= most:
            continue
        if from_low - from_high == 1:
            while high - low > 1:
                middle = (low + high) // 2
                value = 0
                for c in scaled:
                    value = value * middle + c
                odd = value < 0  # an odd number of roots above
                if value == 0 or odd == bool(from_high % 2):
                    high = middle
                else:
                    low = middle
        if high - low == 1:
            found.append((high, from_low - from_high))
            continue
        middle = (low + high) // 2
        count = _roots_above(scaled, middle)
        waiting += [(low, middle, from_low, count), (middle, high, count, from_high)]
    return found


def null_space(matrix: list[list[int]], root: Decimal, dimension: int) -> list[np.ndarray]:
    """Orthonormal vectors that the matrix less ``root`` takes to nothing, by inverse iteration."""
    with decimal.localcontext(decimal.Context(prec=DIGITS, Emax=10**9, Emin=-(10**9))):
        d = len(matrix)
        a = np.asarray([[Decimal(v) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= root
        least = max(abs(v) for v in a.ravel()) * Decimal(10) ** -DIGITS or Decimal(1)
        order = np.arange(d)
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < least:
                a[k, k] = least
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        start = np.random.default_rng(1).integers(-1000, 1000, (dimension, d))
        vectors = [np.asarray([Decimal(int(v)) for v in row], object) for row in start]
        for _ in range(3):
            for at, vector in enumerate(vectors):
                x = vector[order]
                for k in range(1, d):
                    x[k] -= a[k, :k] @ x[:k]
                for k in range(d - 1, -1, -1):
                    x[k] = (x[k] - a[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else x[k]) / a[k, k]
                x /= max(abs(v) for v in x)
                for _ in range(2):
                    for earlier in vectors[:at]:
                        x = x - (earlier @ x) * earlier
                vectors[at] = x / (x @ x).sqrt()
        return vectors


def principal_components(spark: SparkSession, matrix: list[list[int]], most: int) -> list[tuple[Decimal, np.ndarray]]:
    """(eigenvalue, unit eigenvector) of the ``most`` largest positive eigenvalues; each root's null space is a task."""
    if not any(matrix[i][i] for i in range(len(matrix))):
        return []
    roots = largest_roots(characteristic_polynomial(spark, matrix), most)
    sent = spark.sparkContext.broadcast((matrix, roots))

    def root_of(at: int) -> Decimal:
        with decimal.localcontext(decimal.Context(prec=DIGITS)):
            return (Decimal(roots[at][0]) - Decimal("0.5")) / Decimal(2**PLACES)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, all_roots = sent.value
        for batch in batches:
            for at in batch.column(0).to_pylist():
                vectors = null_space(of, root_of(at), all_roots[at][1])
                made = [[float(v) for v in vector] for vector in vectors]
                yield pa.record_batch([
                    pa.array([at] * len(made), pa.int64()), pa.array(range(len(made)), pa.int64()), pa.array(made, pa.list_(pa.float64())),
                ], names=["root", "nth", "vector"])

    rows = map_batches(spark.range(0, len(roots), 1, len(roots)), solve, "root long, nth long, vector array<double>").collect()
    found = []
    for row in sorted(rows, key=lambda r: (r["root"], r["nth"]))[:most]:
        vector = np.asarray(row["vector"])
        found.append((root_of(row["root"]), vector if vector[np.abs(vector).argmax()] > 0 else -vector))
    return found


_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
)


def whiten_embeddings(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector and component: see the module for the columns."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_column, vector_column)
    n, sums, products = scatter(rows)
    if not n:
        return spark.createDataFrame([], _RESULT)
    d = len(sums)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    most = min(components, d)
    found = principal_components(spark, matrix, most)
    trace = sum(matrix[i][i] for i in range(d))
    deviations = [math.sqrt(float(root) / n / n) for root, _ in found]
    explained = [float(root / trace) for root, _ in found] + [0.0] * (most - len(found))
    whole = np.asarray([s // n for s in sums], object)
    rest = np.asarray([s % n for s in sums], object)
    weights = np.asarray([vector / deviation for (_, vector), deviation in zip(found, deviations)]).reshape(len(found), d)
    sent = spark.sparkContext.broadcast((n, whole, rest, weights))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, whole, rest, weights = sent.value
        square = int((rest * rest).sum())
        for batch in batches:
            y = _matrix(batch.column(1))
            far = max(int(np.abs(y).max(initial=0)), max(abs(int(w)) for w in whole)) * 2 + 1
            narrow = max(far, n) * far * d < 2**62
            z = (y - whole.astype(np.int64)) if narrow else y.astype(object) - whole
            own, mixed = (z * z).sum(axis=1), (z * (rest.astype(np.int64) if narrow else rest)).sum(axis=1)
            wide = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(own, mixed)]
            centred = z.astype(np.float64) - rest.astype(np.float64) / n
            whitened = centred @ weights.T
            yield pa.record_batch([
                batch.column(0), pa.array([v if v < 2**63 else None for v in wide], pa.int64()),
                pa.array([Decimal(v) if v < 10**38 else None for v in wide], pa.decimal128(38, 0)),
                pa.array(whitened.tolist(), pa.list_(pa.float64())),
            ], names=["vec_id", "deviation", "deviation_wide", "w"])

    made = stored(map_batches(rows, project, "vec_id long, deviation long, deviation_wide decimal(38,0), w array<double>"), "whitened")
    error = None
    if found:
        pairs = [(i, j) for i in range(len(found)) for j in range(i, len(found))]
        at = lambda i: F.get("w", F.lit(i))
        moments = made.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]  # one row
        error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return made.select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("component")).select(
        "vec_id", F.col("component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("w", F.col("component") - 1).alias("whitened"),
        F.get(F.array(*[F.lit(v) for v in explained]), F.col("component") - 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_wide",
    )
