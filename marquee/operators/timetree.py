"""Popularity of a genre in any range of days, from a handful of stored sums.

Days are the leaves of a binary tree: node n of level l stands for the days from n 2^l up to, not
including, (n + 1) 2^l. ``build`` adds up the ratings of each genre once per node; a range of days
is the union of at most two nodes a level, so a lookup reads some 2 log2(days) rows of the
tree, however many ratings they sum up, and never the ratings. Sums of distinct days are disjoint,
so counts and scores of nodes add up; the tree of several tables is the sum of their trees.

Ratings are summed per movie and day before genres are matched, and per genre and day before days
are dealt to levels, so neither step multiplies ratings. A movie counts in each of its genres.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.calendar import SECONDS_PER_DAY
from marquee.operators.genres import match_genres

#: Levels of the tree: the topmost node spans some 45 years.
LEVELS = 15
_SUMS = ("count", "scored", "total")


def daily_by_genre(ratings: DataFrame, movies: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(genre, day, count, scored, total)``; days since 1970 in UTC. Ratings without a time are left out."""
    day = F.floor(F.col("timestamp") / SECONDS_PER_DAY).cast("int")
    days = (
        ratings.where("timestamp IS NOT NULL")
        .groupBy("mid", day.alias("day"))
        .agg(F.count("mid").alias("count"), F.count("score").alias("scored"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"))
    )
    matched = match_genres(movies.select("mid", "genres"), names).select("genre", "mid")
    return days.join(matched, "mid").groupBy("genre", "day").agg(*(F.sum(name).alias(name) for name in _SUMS))


def build(days: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(level, node, genre, count, scored, total)`` from ``daily_by_genre``: every node with ratings."""
    nodes = F.explode(
        F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright("day", level).alias("node")) for level in range(levels)))
    )
    rows = days.select("genre", *_SUMS, nodes.alias("at")).select("at.level", "at.node", "genre", *_SUMS)
    return rows.groupBy("level", "node", "genre").agg(*(F.sum(name).alias(name) for name in _SUMS))


def cover(first: Column, end: Column, levels: int = LEVELS) -> Column:
    """The nodes (level, node) whose days are those from ``first`` up to, not including, ``end``.

    Going up, a range that does not begin or end at a node of the next level gives up the node there;
    the topmost level takes all that is left.
    """
    found = []
    for level in range(levels):
        size = 1 << level
        low, high = F.ceil(first / size).cast("int"), F.floor(end / size).cast("int")
        left = F.when((low < high) & (low.bitwiseAND(F.lit(1)) == 1), F.array(low))
        right = F.when((low < high) & (high.bitwiseAND(F.lit(1)) == 1), F.array(high - 1))
        rest = F.when(low < high, F.sequence(low, high - 1))
        none = F.array().cast("array<int>")
        nodes = F.coalesce(rest, none) if level == levels - 1 else F.concat(F.coalesce(left, none), F.coalesce(right, none))
        found.append(_at_level(nodes, level))
    return F.concat(*found)


def _at_level(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda node: F.struct(F.lit(level).alias("level"), node.alias("node")))


def lookup(tree: DataFrame, ranges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(genre, first, end, count, total, avg)`` for each row ``(genre, first, end)`` of ``ranges`` with ratings.

    Repeated ranges are answered once; a range without a day has no row.
    """
    wanted = ranges.select("genre", "first", "end").distinct()
    nodes = wanted.select("genre", "first", "end", F.inline(cover(F.col("first"), F.col("end"), levels)))
    sums = nodes.join(tree, ["level", "node", "genre"]).groupBy("genre", "first", "end").agg(
        *(F.sum(name).alias(name) for name in _SUMS)
    )
    return sums.select("genre", "first", "end", "count", "total", F.try_divide("total", "scored").alias("avg"))
