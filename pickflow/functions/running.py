"""Running totals and row numbers that also hold when one group is a large share of all rows.

The rows are range-partitioned by (keys, order), so a large group lies in many consecutive partitions; each partition makes
its local totals. Only a group at the edge of a partition can go on in another one; such groups, at most two a partition, add the
totals of the partitions before. There is one way for groups of any size.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickflow.session import cut_lineage

def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` between two aliased frames."""
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def running_totals(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column | int]) -> DataFrame:
    """Add, per name in ``totals``, the sum over the rows of the group up to and including this one.

    ``order`` must be a total order within a group. A row number is the running total of ``1``. The rows are written once,
    to the checkpoint folder.
    """
    values = {name: F.lit(v) if isinstance(v, int) else v for name, v in totals.items()}
    # The partition number must be the same for both uses below, hence the checkpoint.
    parts = cut_lineage(
        df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    block = ["_part", *keys]
    upto = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # The partitions are ranges, so only their first and last group can have rows in another one.
    group = F.struct(F.lit(0).alias("_all"), *keys)
    edges = parts.groupBy("_part").agg(F.array(F.min(group), F.max(group)).alias("_edges")).select("_part", F.explode("_edges").alias("_group"))
    shared = edges.groupBy("_group").agg(F.count_distinct("_part").alias("_parts")).filter("_parts > 1").select("_group.*")
    cut = parts.alias("l").join(F.broadcast(shared).alias("o"), same_keys("l", "o", keys), "left_semi") if keys else parts
    blocks = cut.groupBy(*block).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    offsets = blocks.select(*block, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values])
    local = parts.withColumns({n: F.sum(v).over(upto) for n, v in values.items()})
    joined = local.alias("l").join(F.broadcast(offsets).alias("o"), same_keys("l", "o", block), "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns if c not in values],
        *[(F.col(f"l.{n}") + F.coalesce(F.col(f"o._before_{n}"), F.lit(0))).cast("bigint").alias(n) for n in values],
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Number the rows of every group from 1 in ``order``."""
    return running_totals(df, keys, order, {name: 1})


def block_totals(df: DataFrame, keys: list[str], position: str, totals: dict[str, Column], *, width: int) -> DataFrame:
    """``running_totals`` for rows that already have a number ``position`` in their order.

    The rows of a group are cut into blocks of ``width`` positions, so no task holds more than ``width`` rows of
    a group; a block adds the totals of the blocks before it. ``position`` must be unique within a group.
    """
    numbered = df.withColumn("_block", F.floor(F.col(position) / width))
    block = [*keys, "_block"]
    upto = Window.partitionBy(*block).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy(*block).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    offsets = blocks.select(*block, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals])
    local = numbered.withColumns({n: F.sum(v).over(upto) for n, v in totals.items()})
    joined = local.alias("l").join(offsets.alias("o"), same_keys("l", "o", block))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns if c not in totals],
        *[(F.col(f"l.{n}") + F.col(f"o._before_{n}")).cast("bigint").alias(n) for n in totals],
    )
