"""Movies near a set of nodes in the graph of ratings: personalised PageRank.

A walker starts at a seed, follows an edge by its weight, and with probability 1 - ``damping``, or where
no edge leads on, starts anew. One round sends every node's rank along its edges: a join with the
edges, whose shares are worked out once and stored, and sums that are combined in each task, so a
node that a third of all edges lead to costs a row per task. Only nodes that the walker has reached
have a row. A round's tables are written to the shared folder, and those of the round before removed.

Edges with a null end or a weight that is not above zero are left out, repeated ones add up; so do
repeated seeds. Without seeds there are no ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import remove, scratch_path

DAMPING = 0.85
ROUNDS = 50
TOLERANCE = 1e-9


def rating_graph(ratings: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: edges both ways between users (``u7``) and movies (``m12``) they rated, by score."""
    user, movie = F.concat(F.lit("u"), F.col("uid").cast("string")), F.concat(F.lit("m"), F.col("mid").cast("string"))
    ways = F.array(*(F.struct(a.alias("src"), b.alias("dst")) for a, b in ((user, movie), (movie, user))))
    return ratings.select(F.inline(ways), F.col("score").alias("weight"))


def pagerank(
    edges: DataFrame,
    seeds: DataFrame,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(node, rank)`` of edges (src, dst, weight) and seeds (node, weight); ranks add up to 1.

    Stops after ``rounds`` rounds, or once ranks changed by less than ``tolerance`` in all.
    """
    spark = edges.sparkSession
    written: list[str] = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        written.append(scratch_path(spark, name))
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    usable = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0")
    summed = usable.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = summed.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = stored(summed.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")), "shares")
    starts = seeds.where("node IS NOT NULL AND weight > 0").groupBy("node").agg(F.sum("weight").cast("double").alias("weight"))
    whole = starts.agg(F.sum("weight")).scalar()
    starts = stored(starts.select("node", (F.col("weight") / whole).alias("start")), "starts")
    edge_table, start_table = written
    ranks = stored(starts.select("node", F.col("start").alias("rank")), "ranks")
    for _ in range(rounds):
        sent = ranks.join(shares, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(
            F.sum(F.col("rank") * F.col("share")).alias("got")
        )
        sent = stored(sent, "sent")
        # What did not arrive stood on nodes without an edge.
        lost = 1 - (sent.agg(F.sum("got")).first()[0] or 0.0)
        back = F.lit(1 - damping + damping * lost) * F.coalesce("start", F.lit(0.0))
        fresh = sent.join(starts, "node", "full").select("node", (back + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        before, ranks = ranks, stored(fresh, "ranks")
        moved = F.abs(F.coalesce(before["rank"], F.lit(0.0)) - F.coalesce(ranks["rank"], F.lit(0.0)))
        change = before.join(ranks, before["node"] == ranks["node"], "full").agg(F.sum(moved)).first()[0] or 0.0
        for path in written[2:-1]:
            remove(spark, path)
        del written[2:-1]
        if change < tolerance:
            break
    for path in (edge_table, start_table):
        remove(spark, path)
    return ranks
