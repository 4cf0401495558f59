"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, sized

#: Links that one task of a round may hold; smaller link tables get fewer tasks.
LINKS_PER_TASK = 100_000
#: Links up to which Spark may send one side of a round's joins to all tasks; more are joined by shuffle.
MAX_SENT = 200_000


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    around = edges.select(F.inline(F.array(
        F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")),
    )))
    least = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return around.filter("b > a").join(sized(least, few), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these. Edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return edges.join(sized(least, few), "a").select(F.inline(ends)).filter("a <> b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of a link table (a, b); root is the least node reachable.

    Each round works on links only: a minimum per node, combined before its shuffle, a join
    back and a distinct, until every node hangs on one root. Rounds grow with the logarithm
    of the longest chain, tasks with the number of links. Every round is written to the
    shared folder, so a lost executor costs one round at most. Nulls and links of a node to
    itself are ignored; an empty table gives an empty result.
    """
    clean = edges.filter("a is not null and b is not null and a <> b")
    now = materialise(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    least_tasks = edges.sparkSession.sparkContext.defaultParallelism
    state = None
    while True:
        found = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"),
        ).first()
        if found["n"] == 0 or (found["n"], found["h"]) == state:
            break
        state = (found["n"], found["h"])
        tasks = max(least_tasks, found["n"] // LINKS_PER_TASK)
        few = found["n"] <= MAX_SENT
        large = materialise(_large_star(now, few).coalesce(tasks), name)  # read twice by the next step
        now = materialise(_small_star(large, few).distinct().coalesce(tasks), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
