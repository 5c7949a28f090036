"""Table sources: one lazy DataFrame per warehouse table."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pickflow.schemas import KEY, SCHEMAS
from pickflow.sources.versions import is_versioned, read_version


class Tables:
    """Named DataFrames. A value may be a function of the holder; it is called on first use."""

    def __init__(self, **frames: DataFrame | Callable[[Tables], DataFrame]):
        self._frames = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name not in frames:
            raise AttributeError(f"no table {name!r}")
        if not isinstance(frames[name], DataFrame):
            frames[name] = frames[name](self)
        return frames[name]

    def replace(self, **frames: DataFrame) -> Tables:
        return Tables(**{**self._frames, **frames})

    def names(self) -> list[str]:
        return list(self._frames)


def check_schema(name: str, df: DataFrame, *, untyped: Collection[str] = ()) -> DataFrame:
    """Fail on load, not in the middle of a job, when a declared column is missing or has another type.

    Columns in ``untyped`` only have to be there: the type of a partition column is guessed from folder names.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    for field in T.StructType.fromDDL(SCHEMAS[name]).fields:
        if field.name not in found:
            raise ValueError(f"table {name}: column {field.name} is missing")
        if field.name in untyped:
            continue
        if found[field.name] != field.dataType:
            raise ValueError(
                f"table {name}: column {field.name} is {found[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    return df


def load_tables(spark: SparkSession, path: str, *, fmt: str = "parquet") -> Tables:
    """All tables under ``path/<table>``; only the tables and columns a query uses are read.

    Tables written with ``sinks.write_table`` are partitioned by tenant and batch, so a filter on
    ``domain_id`` / ``batch_id``, or a join with a list of batches, reads only those folders. Of tables that change by
    versions (``versions``) the version that is the last when the table is first used is read.
    """

    def reader(name: str) -> Callable[[Tables], DataFrame]:
        def read(_: Tables) -> DataFrame:
            if is_versioned(spark, f"{path}/{name}"):
                return read_version(spark, f"{path}/{name}", SCHEMAS[name])
            # The schema that is stored is checked; what is asked for then also gives the partition columns their types.
            check_schema(name, spark.read.format(fmt).load(f"{path}/{name}"), untyped=KEY)
            return spark.read.format(fmt).schema(SCHEMAS[name]).load(f"{path}/{name}")

        return read

    return Tables(**{name: reader(name) for name in SCHEMAS})
