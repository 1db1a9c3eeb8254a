"""URL filters by dated lists: every capture against the entries active when it was fetched.

A list is a log of dated entries: a pattern is added with an action, or removed. Each entry
holds from its time until the pattern's next one, which makes validity intervals. A pattern
is a host (it covers the hosts below it) or a host and the first segments of a path. A
capture has a key for each pattern that could cover it; keys meet intervals of the same
pattern and period, and the as-of condition picks the interval active at the fetch. Of
several active patterns the one with the longest path decides, then the longest host; equal
ones can't be, as a pattern has one active entry.

Periods keep the join an equi-join: an interval is dealt to the periods in which captures were
fetched, and a capture meets only the intervals of its own period. Next entries are found
within a pattern and period first, then across the periods, so a pattern with very many
entries is no single task. Of entries of one pattern at one time the last by action counts,
removal first (blocking over allowing over removal). Only DataFrame functions are used.

Times are whole numbers (days, seconds). Captures with a null address or time match nothing,
nor do entries with a null field; schemes, ports, queries and fragments play no part, host
letters no case. Repeated captures are judged one by one; entries may repeat. Columns other
than the named ones are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.components import stored

ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)"
BLOCK, ALLOW, REMOVE = "block", "allow", "remove"


def host_of(url: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, ADDRESS, 1)), r"\.+$", "")


def segments_of(url: str) -> Column:
    return F.filter(F.split(F.regexp_extract(url, ADDRESS, 2), "/"), lambda s: s != "")


def intervals(entries: DataFrame, period: int) -> DataFrame:
    """pattern, action, since, until (null: open) of entries (pattern, action, at); until is excluded."""
    strength = F.when(F.col("action") == BLOCK, 2).when(F.col("action") == ALLOW, 1).otherwise(0)
    usable = entries.where(F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("at").isNotNull())
    log = (
        usable.groupBy("pattern", "at")
        .agg(F.max_by("action", strength).alias("action"))
        .withColumn("period", F.floor(F.col("at") / period).cast("long"))
    )
    firsts = log.groupBy("pattern", "period").agg(F.min("at").alias("first"))
    later = Window.partitionBy("pattern").orderBy("period")
    firsts = firsts.withColumn("following", F.lead("first").over(later)).drop("first")
    inside = Window.partitionBy("pattern", "period").orderBy("at")
    return (
        log.withColumn("next", F.lead("at").over(inside))
        .join(firsts, ["pattern", "period"])
        .where(F.col("action") != REMOVE)
        .select("pattern", "action", F.col("at").alias("since"), F.coalesce("next", "following").alias("until"))
    )


def judge(
    captures: DataFrame,
    entries: DataFrame,
    key: str = "page_id",
    url: str = "url",
    at: str = "fetched",
    period: int = 30,
) -> DataFrame:
    """key, url, at, verdict (an action or none), pattern that decides, n_active patterns."""
    # Written, as it is used twice: the log is read once.
    active = stored(intervals(entries, period), "intervals")
    known = captures.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(at).cast("long").alias("at"),
        host_of(url).alias("host"), segments_of(url).alias("path"),
    )
    depth = F.size(F.filter(F.split("pattern", "/"), lambda s: s != "")) - 1
    reach = captures.agg(F.min(at).cast("long"), F.max(at).cast("long")).first()
    deepest = active.agg(F.max(depth)).first()[0]
    if deepest is None or reach[0] is None:
        active, deepest, reach = active.limit(0), 0, (0, 0)
    labels = F.split("host", r"\.")
    below = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)),
    )
    count = F.least(F.size("path"), F.lit(deepest))
    deeper = F.when(count > 0, F.transform(
        F.sequence(F.lit(1), count), lambda i: F.concat_ws("/", F.col("host"), F.slice("path", 1, i)),
    )).otherwise(F.array().cast("array<string>"))
    asked = (
        known.where((F.col("host") != "") & F.col("at").isNotNull())
        # Equal captures ask once, and their answer is joined to all of them.
        .select("url", "at", "host", "path")
        .distinct()
        .withColumn("pattern", F.explode(F.array_distinct(F.concat(below, deeper))))
        .withColumn("period", F.floor(F.col("at") / period).cast("long"))
    )
    first = F.greatest(F.floor(F.col("since") / period), F.lit(reach[0] // period))
    last = F.least(F.floor((F.coalesce("until", F.lit(reach[1] + 1)) - 1) / period), F.lit(reach[1] // period))
    dealt = active.withColumn("first", first.cast("long")).withColumn("last", last.cast("long"))
    dealt = dealt.where("first <= last").withColumn("period", F.explode(F.sequence("first", "last")))
    met = asked.join(dealt, ["pattern", "period"]).where(
        (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    )
    size = F.struct(depth.alias("depth"), F.length("pattern").alias("length"), F.col("pattern").alias("pattern"))
    verdicts = met.groupBy("url", "at").agg(
        F.max_by(F.struct("action", "pattern"), size).alias("best"), F.count(F.lit(1)).alias("n_active")
    )
    return known.join(verdicts, ["url", "at"], "left").select(
        F.col("key").alias(key),
        F.col("url").alias(url),
        F.col("at").alias(at),
        F.coalesce("best.action", F.lit("none")).alias("verdict"),
        F.col("best.pattern").alias("pattern"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
    )
