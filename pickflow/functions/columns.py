"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, **equals) -> DataFrame:
    """Filter by the given values; None leaves a filter out, a list or tuple means membership."""
    terms = [
        F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value
        for name, value in equals.items()
        if value is not None
    ]
    return df.filter(reduce(and_, terms)) if terms else df


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as the side of a merge join. For tables that grow with the SKUs or the stock: Spark's estimate for what is derived
    from them (exploded, summed, read from compressed files) can be far too low, and a broadcast then fills the driver."""
    return df.hint("merge")


def per_batch(df: DataFrame) -> DataFrame:
    """``df`` as the side that is broadcast. For tables with a row per batch or rack: Spark's estimate for what is derived from the
    lines is that of the lines, and all lines would be shuffled by batch to meet a few rows."""
    return F.broadcast(df)


def long_sum(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is unknown)."""
    return F.when(condition, 1).otherwise(0)


def ratio(part: str, whole: str, scale: float = 1.0) -> Column:
    """``part / whole * scale`` as double, 0 where ``whole`` is 0 or unknown."""
    known = F.coalesce(F.col(whole), F.lit(0)) != 0
    return F.when(known, F.col(part).cast("double") / F.col(whole).cast("double") * scale).otherwise(F.lit(0.0))


def natural_id(*parts: Column | str) -> Column:
    """A repeatable id from the natural key, in place of a random one."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def box_type_of(box_id: Column | str, split: Column | str = "0,1") -> Column:
    """Box type as the part of the box id between the two configured positions "from,to" (0-based, end excluded)."""
    box = F.col(box_id) if isinstance(box_id, str) else box_id
    given = F.lit(split) if isinstance(split, str) else split
    rule = F.when(F.length(given) >= 3, given).otherwise(F.lit("0,1"))
    start = F.split_part(rule, F.lit(","), F.lit(1)).cast("int")
    end = F.split_part(rule, F.lit(","), F.lit(2)).cast("int")
    return F.substring(box, start + 1, end - start)


def box_color(bucket_color: Column | str, default: Column | str) -> Column:
    """Colour of the bucket, else the default of the batch; an empty text counts as none."""
    bucket = F.col(bucket_color) if isinstance(bucket_color, str) else bucket_color
    return F.coalesce(F.when(bucket != "", bucket), default if isinstance(default, Column) else F.lit(default))
