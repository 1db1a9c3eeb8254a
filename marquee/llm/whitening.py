"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Entries become integers x, so n times the scatter (n² times the covariance) is an integer
matrix, summed exactly over all rows. Its characteristic polynomial is worked out modulo
many primes, each by reduction to Hessenberg form, and put together by Chinese
remainders. All its roots are real and none is negative, so the sign changes of its shifted
coefficients count the roots above any point exactly (Descartes' rule is sharp for real
roots): bisection isolates each root, with its multiplicity, and brings it to ``DIGITS``
digits. A component is the null space of the matrix less its root, by inverse iteration in
decimal numbers of as many digits, orthogonal to the other components of an equal root.

Spark sums the products of entries: each task adds up integer products of its rows, and the
driver gets one total for each pair of dimensions, whatever the number of rows. The primes
are dealt to tasks, each of which gets the matrix; the driver holds numbers by dimension only.

Rows whose vector is null or holds a null or non-finite entry are left out. Vectors shorter than the
longest count as filled up with zeros. Entries beyond 2^52 / 1024 in size count as that size. Repeated
rows and ids are rows of their own, null ids are kept. Without rows, and where all vectors are equal, there is
no component; a component whose eigenvalue is zero is never returned. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrow import record_batch, shipped

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
LIMIT = 2.0**52
COMPONENTS = 8
#: Decimal digits of roots, relative to the largest, and of the inverse iteration beyond them.
DIGITS, SPARE = 40, 40
#: Bits of a limb of an entry; products of two and sums of ROWS of them are exact in doubles.
LIMB, ROWS = 18, 1 << 16
#: Totals travel as limbs of so many bits.
CARRIED = 40
#: Primes of a task.
PRIMES = 8


@dataclass
class Model:
    """n rows, sums of x by dimension, trace of the covariance, eigenvalues and components (a row each)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    polynomial: list[int]


def _entries(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) of each entry, shorter vectors filled up with zeros."""
    offsets = np.asarray(column.offsets)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return np.clip(np.floor(out * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~odd)


def _products(rows: np.ndarray) -> np.ndarray:
    """The exact products of columns with columns, as Python integers."""
    total = np.zeros((rows.shape[1],) * 2, object)
    for start in range(0, len(rows), ROWS):
        rest, limbs = rows[start : start + ROWS], []
        while rest.any():
            low = rest if np.abs(rest).max() < 1 << LIMB else ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def scatter(vectors: DataFrame, vector: str = "embedding") -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of floor(SCALE * c) by dimension and the sums of their products, exactly."""

    def work(batches):
        # Column 0 holds ones, so its products are the sums and the number of rows.
        total = np.zeros((1, 1), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _entries(batch.column(0))
            found = _products(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
            total, found = sorted((total, found), key=len, reverse=True)
            total[: len(found), : len(found)] += found
        rows = [(i, j, part, limb) for i in range(len(total)) for j in range(i + 1) for part, limb in enumerate(_limbs(int(total[i, j])))]
        schema = pa.schema([(name, pa.int64()) for name in ("i", "j", "part", "limb")])
        yield record_batch(schema, *(list(column) for column in zip(*rows))) if rows else record_batch(schema, [], [], [], [])

    column = _usable(vectors, vector).select(F.col(vector).cast("array<double>").alias("v"))
    parts = column.transform(shipped).mapInArrow(work, "i long, j long, part long, limb long")
    totals = parts.groupBy("i", "j", "part").agg(F.sum("limb").alias("limb")).collect()  # by dimension, not by row
    width = 1 + max((r.i for r in totals), default=0)
    whole = [[0] * width for _ in range(width)]
    for r in totals:
        whole[r.i][r.j] += r.limb << CARRIED * r.part
    for i in range(width):
        for j in range(i):
            whole[j][i] = whole[i][j]
    return whole[0][0], whole[0][1:], [row[1:] for row in whole[1:]]


def _limbs(value: int) -> list[int]:
    """The value in parts of CARRIED bits; the last carries the sign."""
    out = []
    while not -(1 << CARRIED) < value < 1 << CARRIED:
        out.append(value & ((1 << CARRIED) - 1))
        value >>= CARRIED
    return [*out, value]


def primes_below(top: int, bits: int) -> list[int]:
    """The largest primes below ``top`` whose product has more than ``bits`` bits."""
    out, found, p = [], 0.0, top
    small = [q for q in range(3, 1000, 2) if all(q % r for r in range(3, math.isqrt(q) + 1, 2))]
    while found <= bits:
        p -= 1 + p % 2
        # These bases let no composite below 3.2e9 pass (Miller and Rabin's test).
        if all(p % q for q in small) and all(_strong(p, base) for base in (2, 3, 5, 7)):
            out.append(p)
            found += math.log2(p)
    return out


def _strong(p: int, base: int) -> bool:
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    x = pow(base, d, p)
    if x in (1, p - 1):
        return True
    return any((x := x * x % p) == p - 1 for _ in range(s - 1))


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """The coefficients of det(t - matrix) modulo p, constant first, by Hessenberg reduction.

    ``p`` is below 2^31, so that products fit.
    """
    h = matrix.copy()
    d = len(h)
    for k in range(d - 2):
        pivots = np.flatnonzero(h[k + 1 :, k])
        if not len(pivots):
            continue
        at = k + 1 + int(pivots[0])
        if at != k + 1:
            h[[at, k + 1]] = h[[k + 1, at]]
            h[:, [at, k + 1]] = h[:, [k + 1, at]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    # Polynomials of the leading blocks, each from those before it.
    blocks = np.zeros((d + 1, d + 1), np.int64)
    blocks[0, 0] = 1
    for k in range(d):
        row = -h[k, k] * blocks[k] % p
        row[1:] = (row[1:] + blocks[k, :-1]) % p
        below = 1
        factors = np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            factors[i] = below * int(h[i, k]) % p
        blocks[k + 1] = (row - (factors[:, None] * blocks[:k] % p).sum(0)) % p
    return blocks[d].tolist()


def polynomial(df: DataFrame, matrix: list[list[int]]) -> list[int]:
    """The coefficients of det(t - matrix), constant first, of a matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # A coefficient is a sum of products of roots, at most that of equal roots.
    bits = max((math.log2(math.comb(d, k)) + k * max(0.0, math.log2(max(trace, 1)) - math.log2(d)) for k in range(1, d + 1)), default=0)
    primes = primes_below(1 << 31, math.ceil(bits) + 2)

    def work(batches):
        for batch in batches:
            moduli = batch.column(0).to_pylist()
            found = [polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p) for p in moduli]
            schema = pa.schema([("p", pa.int64()), ("residues", pa.list_(pa.int64()))])
            yield record_batch(schema, moduli, found)

    table = df.sparkSession.createDataFrame([(p,) for p in primes], "p long").repartition(-(-len(primes) // PRIMES))
    rows = table.transform(shipped).mapInArrow(work, "p long, residues array<long>").collect()
    product = math.prod(r.p for r in rows)
    out = [0] * (d + 1)
    for r in rows:
        share = product // r.p
        share *= pow(share, -1, r.p)
        out = [value + share * residue for value, residue in zip(out, r.residues)]
    return [value - product if (value := v % product) > product // 2 else value for v in out]


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """How many roots, each as often as it occurs, lie above at / 2^bits; all have to be real."""
    d = len(coefficients) - 1
    c = [value << bits * (d - i) for i, value in enumerate(coefficients)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [value > 0 for value in c if value]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], most: int, digits: int = DIGITS) -> list[Decimal]:
    """The largest ``most`` positive roots, falling, each as often as it occurs: to ``digits`` digits of the largest.

    All roots have to be real and none negative.
    """
    d = len(coefficients) - 1
    positive = d - next(i for i, value in enumerate(coefficients) if value)
    most = min(most, positive)
    if not most:
        return []
    top = max(1, -coefficients[d - 1])  # their sum
    bits = max(0, math.ceil(digits * math.log2(10)) + math.ceil(math.log2(max(1, d))) - top.bit_length() + 1)
    known = {0: positive, top << bits: 0}

    def above(at: int) -> int:
        if at not in known:
            known[at] = roots_above(coefficients, at, bits)
        return known[at]

    def sign(at: int) -> bool:
        value = 0
        for i, c in enumerate(reversed(coefficients)):
            value = value * at + (c << bits * i)
        return value > 0

    out = []
    for k in range(1, most + 1):
        # The k-th root is above low and not above high.
        low = max(at for at, n in known.items() if n >= k)
        high = min(at for at, n in known.items() if n < k)
        while high - low > 1:
            middle = (low + high) // 2
            if above(low) - above(high) == 1:
                # Alone in its interval: the sign tells on which side it is.
                odd = above(high) % 2 == 1
                if sign(middle) == odd:
                    low, known[middle] = middle, above(low)
                else:
                    high, known[middle] = middle, above(high)
            elif above(middle) >= k:
                low = middle
            else:
                high = middle
        with localcontext(Context(prec=digits + SPARE + top.bit_length())):
            out.append((Decimal(low) + Decimal(high)) / 2 / Decimal(2) ** bits)
    return out


def null_vectors(matrix: list[list[int]], values: list[Decimal], digits: int = DIGITS) -> np.ndarray:
    """A unit eigenvector for each value, a row each, orthogonal where values are equal."""
    d = len(matrix)
    done: list[np.ndarray] = []
    with localcontext(Context(prec=digits + SPARE)) as context:
        close = Decimal(10) ** (2 - digits) * max(values, default=Decimal(1))
        exact = np.array([[Decimal(v) for v in row] for row in matrix], object)
        before = None
        for number, value in enumerate(values):
            if before is None or value != before[0]:
                a = exact.copy()
                a[np.arange(d), np.arange(d)] -= value
                order = np.arange(d)
                for k in range(d):
                    at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
                    a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
                    if not a[k, k]:
                        a[k, k] = close / 10**SPARE  # exactly singular
                    a[k + 1 :, k] /= a[k, k]
                    a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
                before = value, a, order
            _, a, order = before
            equal = [v for v, other in zip(done, values) if abs(other - value) <= close]
            v = np.array([Decimal((i * 7919 + number * 104729) % 1009 - 504) for i in range(d)], object) + Decimal(1) / 3
            for _ in range(3):
                v = v[order]
                for k in range(d):
                    v[k + 1 :] -= a[k + 1 :, k] * v[k]
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (a[k, k + 1 :] * v[k + 1 :]).sum()) / a[k, k]
                v /= context.sqrt((v * v).sum())
                for _ in range(2):
                    for other in equal:
                        v = v - (v * other).sum() * other
                v = v / context.sqrt((v * v).sum())
            done.append(v)
    return np.array([[float(x) for x in v] for v in done]).reshape(len(done), d)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """Eigenvalues and components of the covariance of x, over all usable rows."""
    n, sums, products = scatter(vectors, vector)
    matrix = [[n * p - a * b for p, b in zip(row, sums)] for row, a in zip(products, sums)]
    shared = math.gcd(*(v for row in matrix for v in row)) or 1
    reduced = [[v // shared for v in row] for row in matrix]
    coefficients = polynomial(vectors, reduced)
    values = largest_roots(coefficients, components)
    found = null_vectors(reduced, values)
    with localcontext(Context(prec=DIGITS + SPARE)):
        scale = Decimal(shared) / max(1, n) ** 2
        exact = np.array([float(value * scale) for value in values])
        trace = float(Decimal(sum(matrix[i][i] for i in range(len(matrix)))) / max(1, n) ** 2)
    return Model(n, [s + n * OFFSET for s in sums], trace, exact, found, coefficients)


def whiten(vectors: DataFrame, model: Model, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, deviation (sum over dimensions of (n x - sum)², exact; null beyond 38 digits) and whitened,
    one entry for each component."""
    n, sums, width = model.n, [s - model.n * OFFSET for s in model.sums], len(model.sums)
    whole, part = (np.array(v) for v in zip(*(divmod(s, n) for s in sums))) if width and n else (np.zeros(0, np.int64),) * 2
    projection = model.components.T / np.sqrt(model.values)

    def work(batches):
        for batch in batches:
            x = _entries(batch.column(1))
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            centred = x - whole  # and less part / n
            largest = (int(np.abs(centred).max(initial=0)) + 1) * n
            spread = centred * n - part if largest < 1 << 62 else centred.astype(object) * n - part.astype(object)
            if largest * largest * max(1, width) >= 1 << 63:
                spread = spread.astype(object)
            # Row by row in one order, so that equal vectors give equal results wherever they lie.
            flat = centred - part / max(1, n)
            white = np.zeros((len(x), projection.shape[1]))
            for j in range(width):
                white += flat[:, j, None] * projection[j]
            schema = pa.schema([batch.schema.field(key), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
            yield record_batch(
                schema,
                batch.column(0),
                pa.array([Decimal(v) if (v := int(s)) < 10**38 else None for s in (spread * spread).sum(1)], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], white.ravel()),
            )

    kind = vectors.schema[key].dataType.simpleString()
    rows = _usable(vectors, vector).select(key, F.col(vector).cast("array<double>").alias("__vector"))
    return rows.transform(shipped).mapInArrow(work, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")


def components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each
    usable row and component."""
    model = fit(vectors, vector, most)
    whitened = whiten(vectors, model, key, vector)
    error = identity_error(whitened, len(model.values))
    shares = F.array(*(F.lit(float(value / model.trace)) for value in model.values)).cast("array<double>")
    return whitened.select(key, "deviation", F.posexplode("whitened").alias("place", "white")).select(
        key,
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("white").alias("whitened"),
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` less the identity.

    Each task centres by the means of its rows; the tasks' sums are merged by the means' gaps.
    """

    def work(batches):
        n, mean, spread = 0, np.zeros(components), np.zeros((components,) * 2)
        for batch in batches:
            if batch.num_rows:
                w = batch.column(0).flatten().to_numpy().reshape(-1, components)
                m, size = w.mean(0), len(w)
                gap = m - mean
                spread += (w - m).T @ (w - m) + np.outer(gap, gap) * (n * size / (n + size))
                mean += gap * (size / (n + size))
                n += size
        schema = pa.schema([("k", pa.int64()), ("value", pa.float64())])
        values = [n, *(n * mean), *(spread + n * np.outer(mean, mean)).ravel()]
        yield record_batch(schema, np.arange(len(values)), values)

    if not components:
        return None
    parts = whitened.select("whitened").transform(shipped).mapInArrow(work, "k long, value double")
    sums = {r.k: r.value for r in parts.groupBy("k").agg(F.sum("value").alias("value")).collect()}
    n = sums[0]
    mean = np.array([sums[1 + i] for i in range(components)]) / n
    square = np.array([sums[1 + components + i] for i in range(components**2)]).reshape(components, components) / n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(components)).max())
