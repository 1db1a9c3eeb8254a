from __future__ import annotations

import math
from collections import Counter, defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from marquee.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def integers(vectors):
    width = max(map(len, vectors))
    return [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors]


def plain_polynomial(matrix):
    """Faddeev and LeVerrier's recurrence in whole numbers, constant first."""
    d = len(matrix)
    a, m, out = np.array(matrix, object), np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a @ m + out[-1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        out.append(-int((a @ m).trace()) // k)
    return out[::-1]


def check(spark, vectors, most=8, tolerance=1e-8):
    """The operator against numpy on the same integers; returns the rows."""
    x = integers(vectors)
    n, sums = len(x), [sum(column) for column in zip(*x)]
    centred = [[n * v - s for v, s in zip(row, sums)] for row in x]
    covariance = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    values = np.linalg.eigvalsh(covariance)[::-1]
    got = defaultdict(dict)
    for r in whitening.components(frame(spark, vectors), most=most).collect():
        got[r.vec_id][r.component] = r
    count = min(most, int((values > 1e-9 * max(1, values[0])).sum()))
    white = np.array([[got[i][k].whitened for k in range(1, count + 1)] for i in range(n)])
    assert all(len(rows) == count for rows in got.values())
    for i, rows in got.items():
        assert {r.deviation for r in rows.values()} == {Decimal(sum(v * v for v in centred[i]))}
        assert {r.n for r in rows.values()} == {n}
    spread = white - white.mean(0)
    assert np.abs(spread.T @ spread / n - np.eye(count)).max() < tolerance
    some = next(iter(got.values()))
    assert [some[k].explained for k in range(1, count + 1)] == pytest.approx((values[:count] / values.sum()).tolist(), rel=1e-9)
    assert all(0 <= r.identity_error < tolerance for r in some.values())
    # The projection is one of unit vectors: scaled back, it has the variance along each component.
    directions = np.linalg.lstsq(np.array(centred, float) / n, white * np.sqrt(values[:count]), rcond=None)[0]
    assert np.abs(covariance @ directions - directions * values[:count]).max() < 1e-6 * values[0]
    return got


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    check(spark, (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12)).tolist())


def test_equal_eigenvalues(spark):
    axes = [[float(s * (i == j)) for j in range(6)] for i in range(6) for s in (1, -1)]
    got = check(spark, axes)
    assert len({r.explained for r in got[0].values()}) == 1


def test_close_eigenvalues(spark):
    """Two variances that differ by a millionth of a millionth still give their own axes."""
    vectors = [[a * 4096.0, 0.0] for a in (1, -1)] + [[0.0, b] for b in (4096.0 + 1 / 1024, -4096.0 - 1 / 1024)]
    got = check(spark, vectors, tolerance=1e-6)
    assert [abs(round(got[3][k].whitened, 9)) for k in (1, 2)] == [pytest.approx(2**0.5), 0]


def test_few_rows_and_dimensions(spark):
    check(spark, [[0.5, 0.25, 3.0], [0.5, -0.25, 1.0]])
    check(spark, [[1.0], [2.0], [4.0]])
    check(spark, [[1.0, 2.0, 3.0], [2.0], [], [0.1, 0.2]])


def test_without_spread_there_is_no_component(spark):
    for vectors in ([[1.0, 2.0]] * 5, [[1.0]], [[]], []):
        assert whitening.components(frame(spark, vectors)).collect() == []


def test_left_out_rows_and_clashing_columns(spark):
    good = [[0.1, 0.2], [0.3, -0.1], [0.5, 0.9], [0.5, 0.9]]
    bad = [None, [None, 1.0], [float("nan"), 1.0], [1.0, float("inf")]]
    table = frame(spark, good + bad, [0, 1, None, None, 4, 5, 6, 7])
    for name in ("n", "deviation", "component", "whitened", "v", "i", "part"):
        table = table.withColumn(name, table["vec_id"])
    rows = whitening.components(table).collect()
    assert Counter(r.vec_id for r in rows) == {0: 2, 1: 2, None: 4} and {r.n for r in rows} == {4}


def test_huge_entries(spark):
    vectors = [[2.0**40, 1.0], [-(2.0**40), 3.0], [5.0, 2.0**35]]
    check(spark, vectors, tolerance=1e-6)
    rows = whitening.components(frame(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]])).collect()
    assert len(rows) == 6 and all(math.isfinite(r.whitened) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_polynomial_and_roots(spark, seed):
    rng = np.random.default_rng(seed)
    half = rng.integers(-(10**9), 10**9, (6, 9 if seed else 4)).astype(object)
    matrix = (half.T @ half).tolist()
    coefficients = whitening.polynomial(spark.range(1), matrix)
    assert coefficients == plain_polynomial(matrix)
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    roots = whitening.largest_roots(coefficients, 9)
    assert len(roots) == (6 if seed else 4)
    assert [float(r) for r in roots] == pytest.approx(values[: len(roots)].tolist(), rel=1e-6)
    for p in (2147483647, 101, 3):
        found = whitening.polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p)
        assert found == [c % p for c in coefficients]


def test_roots_of_known_polynomials():
    def product(roots):
        c = [1]
        for r in roots:
            c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
        return c

    for roots in ([7, 7, 7, 3, 0, 0], [10**20 + 1, 10**20, 5, 5], [1, 0], [0, 0, 0], [2**70], [4, 3, 2, 1]):
        got = whitening.largest_roots(product(roots), 8)
        assert [round(r) for r in got] == sorted((r for r in roots if r), reverse=True)
        assert all(abs(g - r) <= Decimal(10) ** -39 * max(roots) for g, r in zip(got, roots))


def test_query_over_a_whole_table(spark):
    rows = queries.queries()["op11_whitening"](spark, SF)
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in table.values()], object)
    n, spread = len(x), x * len(x) - x.sum(0)
    values, vectors = np.linalg.eigh((spread.T @ spread).astype(float) / float(n) ** 3)
    got = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.component):
        got[r.vec_id].append(r)
    assert got.keys() == table.keys() and {len(v) for v in got.values()} == {8}
    white = np.array([[r.whitened for r in got[i]] for i in table])
    expected = (spread / n).astype(float) @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    sign = np.sign((white * expected).sum(0))
    assert np.abs(white - expected * sign).max() < 1e-9
    for i, row in zip(table, spread):
        assert got[i][0].deviation == (row * row).sum() and got[i][0].identity_error <= 1e-12
