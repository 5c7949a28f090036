"""Join of half-open intervals within a key, without comparing every pair of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiles are powers of two with an exponent that is a multiple of this: 1, 4, 16, ...
STEP = 2


def _level(start: Column, end: Column) -> Column:
    """The exponent of the smallest tile that is as long as the interval."""
    bits = F.when(end - start <= 1, 0).otherwise(F.length(F.bin(end - start - 1)))
    return (F.ceil(bits / STEP) * STEP).cast("int")


def _tiles(df: DataFrame, own: int, others: Column) -> DataFrame:
    """The tiles of every interval: those of its own level, and of the levels ``others``.

    ``_owner`` tells whose level it is, 0 for that of the left side and 1 for that of the right. An interval lies in at most
    two tiles of a level that is not below its own.
    """
    mine = F.array(F.struct(F.lit(own).alias("o"), F.col("_level").alias("l")))
    placed = F.concat(mine, F.transform(others, lambda x: F.struct(F.lit(1 - own).alias("o"), x.alias("l"))))
    at = df.withColumn("_at", F.explode(placed)).withColumns({"_owner": F.col("_at.o"), "_size": F.col("_at.l")})
    return at.withColumn("_tile", F.explode(F.expr("sequence(shiftright(start, _size), shiftright(end - 1, _size))"))).drop("_at", "_levels", "_level")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` and ``right`` whose ``[start, end)`` overlap, with the length as ``overlap``; empty intervals have none.

    A pair meets in the tiles of the longer one's level: there the longer interval covers a good part of its one or two
    tiles, and the shorter one lies in one or two as well. So an interval of any length makes at most two rows for each
    level that its key has on the other side, and a short one meets few that it does not overlap. The levels of a key are
    gathered first; there are at most 32.
    """
    sides = []
    for df in (left, right):
        long = df.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")}).filter("start < end")
        sides.append(long.withColumn("_level", _level(F.col("start"), F.col("end"))))
    levels = [s.groupBy(*keys).agg(F.collect_set("_level").alias("_levels")) for s in sides]
    tiled_left = _tiles(sides[0].join(levels[1], keys), 0, F.filter("_levels", lambda x: x > F.col("_level")))
    tiled_right = _tiles(sides[1].join(levels[0], keys), 1, F.filter("_levels", lambda x: x >= F.col("_level")))
    renamed = tiled_right.withColumnsRenamed({"start": "_r_start", "end": "_r_end"})
    first, last = F.greatest("start", "_r_start"), F.least("end", "_r_end")
    # The tile that holds the first common point counts the pair, so it appears once.
    return (
        tiled_left.join(renamed, [*keys, "_owner", "_size", "_tile"])
        .withColumns({"_first": first, "overlap": last - first})
        .filter("overlap > 0 AND shiftright(_first, _size) = _tile")
        .drop("_owner", "_size", "_tile", "_r_start", "_r_end", "_first")
    )
