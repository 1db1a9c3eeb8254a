"""All tags of a movie in one string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tags_by_movie(tags: DataFrame, sep: str = "|") -> DataFrame:
    """``(mid, tags)``: each movie's distinct tags, in order, joined by ``sep``.

    Repeats go first, in a shuffle on (movie, tag). Only the distinct tags of a
    movie then meet in one task, however often the movie was tagged.
    """
    distinct = tags.select("mid", "tag").distinct()
    return distinct.groupBy("mid").agg(
        F.concat_ws(sep, F.array_sort(F.collect_list("tag"))).alias("tags")
    )


def movies_with_tags(movies: DataFrame, tags: DataFrame, sep: str = "|") -> DataFrame:
    """``movies`` with a ``tags`` column, NULL for a movie nobody tagged."""
    return movies.join(tags_by_movie(tags, sep), "mid", "left")
