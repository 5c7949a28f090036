"""Connected components of a graph in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickflow.llm.common import stored


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component) for every id of ``edges`` (u, v: bigint); the component is its smallest id.

    Both steps keep what is connected connected and shrink the distance to the smallest id, so the rounds grow with the
    logarithm of the longest path. What is joined is written first, so that a join on a hot id can be split. Only counts
    reach the driver. ``rows``: the most rows of ``edges``, if known.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", rows)
    while True:
        n = now.count()
        both = now.unionAll(now.select("v", "u"))
        # every id tells its larger neighbours the smallest id it sees
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars", 2 * n)
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved")), "edges", n)
        # every id tells its smaller neighbours, and keeps, the smallest of these
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars", n)
        moved = large.agg(F.max("moved")).first()[0] or (least.agg(F.max("n")).first()[0] or 1) > 1
        if not moved:  # every id has one edge, to the smallest id of its component, which has none
            break
        small = large.select("u", "v").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", 2 * n)
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
