"""Neighbours in a global order without one large sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_successor_rows(docs: DataFrame, key: str = "doc_id", tie: str = "_tie") -> DataFrame:
    """``docs`` cut into ranges of ``key``, each followed by the first row of the next range (the last by the first of all).

    Adds ``_range`` and ``_tail``; rows come partitioned by ``_range`` and sorted by (_range, _tail, key, tie), so one pass
    over a partition sees each row next to its successor. The ranges, as many as shuffle partitions, are all the driver
    holds. Repeated keys stay in one range; then more than one ``_tail`` row may follow, of which the first counts. Null
    keys come first.
    """
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [i / ranges for i in range(1, ranges)]
    splits = docs.select(F.percentile_approx(key, [float(p) for p in at], ranges * 20).alias("s")).first()["s"] or []
    splits = sorted(set(splits))
    bounds = F.array(*[F.lit(s) for s in splits]).cast("array<bigint>")
    number = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(key)))) if splits else F.when(F.col(key).isNull(), -1).otherwise(0)
    firsts = [tuple(r) for r in docs.select(number.alias("r"), F.col(key).alias("k")).groupBy("r").agg(F.min("k")).orderBy("r").collect()]
    if not firsts:
        return docs.select("*", F.lit(0).alias("_range"), F.lit(0).alias("_tail"))
    follows = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]  # the first of all follows the last range
    sends = spark.createDataFrame(follows, "_key bigint, _before int")
    rows = docs.select("*", number.cast("int").alias("_range"))
    copies = F.when(
        F.col("_before").isNotNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("t")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("t")))
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("t"))))
    return (
        rows.join(F.broadcast(sends), F.col(key).eqNullSafe(F.col("_key")), "left")
        .select(*docs.columns, F.explode(copies).alias("_c"))
        .select(*docs.columns, F.col("_c.r").alias("_range"), F.col("_c.t").alias("_tail"))
        .repartitionByRange("_range")
        .sortWithinPartitions("_range", "_tail", key, tie)
    )
