"""Pages of a result."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickflow.functions.running import same_keys
from pickflow.session import cut_lineage

#: Rows up to the end of a page that a task may hold for a group; deeper pages are found by counting.
SHALLOW = 10_000


def rowset_page(df: DataFrame, order: list[Column], page: int, limit: int, keys: list[str] | None = None) -> DataFrame:
    """Page ``page`` (from 1) of ``limit`` rows in ``order``; with ``keys`` the page of every group.

    ``order`` should be total within a group: rows that tie come in any order, and a tie at the border of two pages may then
    show a row on both or none. A page that ends within ``SHALLOW`` rows is a top-n with offset, with keys by a bound on the
    row number that Spark applies before the shuffle. A deeper page is counted to: the rows are range-partitioned by keys and
    order and written once; of all partitions only the number of rows per group is summed, and only the partitions that hold
    rows of the page are sorted. The rows before the page never meet in one task.
    """
    first, last = (page - 1) * limit + 1, page * limit
    if last > SHALLOW:
        return _counted(df, order, first, last, keys or [])
    if not keys:
        return df.orderBy(*order).offset(first - 1).limit(limit)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= last).filter(F.col("_rn") >= first).drop("_rn")


def _counted(df: DataFrame, order: list[Column], first: int, last: int, keys: list[str]) -> DataFrame:
    """Rows ``first`` to ``last`` of every group, found by the counts of range partitions."""
    ranges = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order)
    parts = cut_lineage(ranges.withColumn("_part", F.spark_partition_id()))
    block = ["_part", *keys]
    counts = parts.groupBy(*block).agg(F.count("*").alias("_rows"))
    if keys:
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    else:  # one row for each partition: the driver adds them up
        sizes = sorted((r["_part"], r["_rows"]) for r in counts.collect())
        before = itertools.accumulate((n for _, n in sizes), initial=0)
        counts = df.sparkSession.createDataFrame([(p, n, b) for (p, n), b in zip(sizes, before)], "_part int, _rows bigint, _before bigint")
    wanted = counts.filter((F.col("_before") < last) & (F.col("_before") + F.col("_rows") >= first)).drop("_rows")
    hit = parts.alias("l").join(wanted.alias("o"), same_keys("l", "o", block)).select(*[F.col(f"l.{c}") for c in parts.columns], F.col("o._before"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy(*order)) + F.col("_before")
    return hit.withColumn("_rn", place).filter(F.col("_rn").between(first, last)).select(*df.columns)
