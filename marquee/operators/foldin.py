"""Factors of new users and movies against a model's fixed factors.

A model knows the ids it was fitted on; pairs with another id get no prediction. A new user's
factors are those the fit's last step would give: the ridge regression of the user's scores on the
factors of the rated movies, with the penalty times the number of ratings. Its normal equations
need only sums over the user's ratings, so they are added up in parts: a user with more than
``CHUNK`` rated movies is split by a digest over that many tasks, each of which sums its part, and
only the sums of parts meet. Every other user is solved by the task that gets the ratings.

Ratings of movies without factors, and ratings without a score or with an id of null, do not
count; a user without any other rating gets no factors. Ratings that occur twice count twice, as
in the fit; repeats are added up before the ratings are dealt, so they never make a part large. Factors with null or non-finite elements are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import als

# The solver travels with its tasks: workers need numpy, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rated movies of one user, or users of one movie, summed in one task.
CHUNK = 1 << 16
#: Ratings worked on at once.
_SLICE = 4096

_SUMS = "id long, n long, square array<double>, linear array<double>"


def fold_in(
    factors: DataFrame,
    ratings: DataFrame,
    reg: float = als.REG,
    *,
    new: str = "uid",
    known: str = "mid",
    chunk: int = CHUNK,
) -> DataFrame:
    """``(id, features)`` for every ``new`` id of ``ratings`` (new, known, score) that meets ``factors`` (id, features).

    With ``new="mid", known="uid"`` and user factors, movies are folded in.
    """
    kind = ratings.schema[new].dataType.simpleString()
    odd = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Single precision stays as it is until a task has it: the shuffle carries a vector for each pair.
    single = factors.schema["features"].dataType.elementType.typeName() == "float"
    features = F.col("features") if single else F.col("features").cast("array<double>")
    usable = factors.where(F.col("features").isNotNull() & ~odd).select(F.col("id").alias("known"), features.alias("features"))
    scored = ratings.select(
        F.col(new).cast("long").alias("id"), F.col(known).alias("known"), F.col("score").cast("double").alias("score")
    ).dropna()
    pairs = scored.groupBy("id", "known").agg(F.count("score").alias("times"), F.sum("score").alias("score"))
    # Only ids with more than a chunk are listed, so the list is small whatever the ratings.
    large = pairs.groupBy("id").count().where(F.col("count") > chunk)
    parts = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
    dealt = pairs.join(large, "id", "left").select("id", "known", "times", "score", parts.alias("parts"))
    met = dealt.join(usable, "known").select(
        "id", F.pmod(F.xxhash64("known"), F.col("parts")).cast("int").alias("part"), "parts", "times", "score", "features"
    )
    met = met.repartition("id", "part").sortWithinPartitions("id", "part")
    first = met.mapInArrow(_sum_up(reg), f"{_SUMS}, features array<double>")
    alone = first.where("features IS NOT NULL").select("id", "features")
    split = first.where("features IS NULL").select("id", "n", "square", "linear")
    merged = split.repartition("id").sortWithinPartitions("id").mapInArrow(_merge(reg), "id long, features array<double>")
    return alone.unionByName(merged).select(F.col("id").cast(kind).alias("id"), "features")


def predict(users: DataFrame, movies: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (uid, mid, ...) with a ``prediction``; pairs with an id on neither side drop out."""
    product = F.aggregate(F.zip_with("of_user", "of_movie", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    with_users = pairs.join(users.select(F.col("id").alias("uid"), F.col("features").alias("of_user")), "uid")
    both = with_users.join(movies.select(F.col("id").alias("mid"), F.col("features").alias("of_movie")), "mid")
    return both.select(*pairs.columns, product.alias("prediction"))


def solve(square: np.ndarray, linear: np.ndarray, n: int, reg: float) -> np.ndarray:
    """The ridge solution by Cholesky's factors; the shortest one where the sums are singular."""
    ridge = square + reg * n * np.eye(len(linear))
    try:
        lower = np.linalg.cholesky(ridge)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(ridge, linear, rcond=None)[0]
    return np.linalg.solve(lower.T, np.linalg.solve(lower, linear))


def _runs(batches, keys: tuple[int, ...]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of batches with equal keys, and whether the key is new."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            at = tuple(c[start] for c in columns)
            for begin in range(start, end, _SLICE):
                yield at != last, batch.slice(begin, min(_SLICE, end - begin))
                last = at


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_DOUBLES = pa.list_(pa.float64())
_FIELDS = [("id", pa.int64()), ("n", pa.int64()), ("square", _DOUBLES), ("linear", _DOUBLES), ("features", _DOUBLES)]


def _sum_up(reg: float):
    """Per (id, part): the factors if it is the only part, the sums otherwise."""

    def work(batches):
        schema = pa.schema(_FIELDS)
        out, state = [], None

        def close():
            i, parts, n, square, linear = state
            if parts == 1:
                out.append((i, n, None, None, solve(square, linear, n, reg)))
            else:
                out.append((i, n, square.ravel(), linear, None))

        for new, run in _runs(batches, (0, 1)):
            times, scores, vectors = run.column(3).to_numpy(), run.column(4).to_numpy(), _matrix(run.column(5)).astype(float)
            if new:
                if state:
                    close()
                width = vectors.shape[1]
                state = [run.column(0)[0].as_py(), run.column(2)[0].as_py(), 0, np.zeros((width, width)), np.zeros(width)]
            state[2] += int(times.sum())
            state[3] += (vectors * times[:, None]).T @ vectors
            state[4] += vectors.T @ scores
            if len(out) >= 256:
                yield _batch(schema, out)
                out.clear()
        if state:
            close()
        yield _batch(schema, out)

    return work


def _merge(reg: float):
    """Per id: the factors from the sums of its parts."""

    def work(batches):
        schema = pa.schema([_FIELDS[0], _FIELDS[4]])
        out, state = [], None
        for new, run in _runs(batches, (0,)):
            n, square, linear = (np.asarray(_matrix(run.column(k)).sum(0) if k > 1 else run.column(k).to_numpy().sum()) for k in (1, 2, 3))
            if new and state:
                out.append((state[0], solve(state[2].reshape(len(state[3]), -1), state[3], state[1], reg)))
                state = None
            if state is None:
                state = [run.column(0)[0].as_py(), int(n), square, linear]
            else:
                state[1], state[2], state[3] = state[1] + int(n), state[2] + square, state[3] + linear
            if len(out) >= 256:
                yield _batch(schema, out)
                out.clear()
        if state:
            out.append((state[0], solve(state[2].reshape(len(state[3]), -1), state[3], state[1], reg)))
        yield _batch(schema, out)

    return work
