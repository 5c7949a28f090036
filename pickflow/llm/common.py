"""What several operators share: scratch tables, word rules, size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pickflow.session import use_checkpoint_dir

#: A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows of a file of a small table whose size is known; its writers are that few.
FILE_ROWS = 50_000
#: Bytes of whole texts that an executor and a Python worker exchange at a time.
TEXT_BATCH = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as a table to the shared folder and read again, so that lost executors cost no recomputation.

    With ``rows``, the most that it has, it is written in files of about ``FILE_ROWS`` and read by as few tasks: rounds over small
    tables would else leave a file for every partition of every shuffle, and the next shuffle another for each of these.
    """
    path = scratch(df.sparkSession, name)
    df = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; as it is, for a shuffled join, otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_batches(spark: SparkSession, most: int | None = TEXT_BATCH) -> None:
    """From now on Arrow batches of the session end at ``most`` bytes (none: as Spark has it), not only at so many rows.

    Ten thousand texts at once are some tens of MB, several times over in the executor and in its workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if most is None:
        spark.conf.unset(key)
    else:
        spark.conf.set(key, str(most))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
