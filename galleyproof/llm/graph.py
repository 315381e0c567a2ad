"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyproof.llm.common import drop_scratch, join_salted, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return join_salted(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = join_salted(down, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionAll(rest).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v); the component is its smallest node.

    Alternates large-star and small-star steps. Each step works on sums per node and
    joins with the edges of a hub dealt out, so no component meets in one task, and each
    round is written to the shared folder. Loops, repeated edges and an empty list are fine.
    """
    now = materialise(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        after = materialise(_small_star(_large_star(now)), "edges")
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        drop_scratch(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
