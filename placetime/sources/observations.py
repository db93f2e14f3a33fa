"""Stored observations: a folder per day, nodes side by side in its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.functions.timeparts import ts_lit
from placetime.operators.observations import select_observations

DAY = "obs_date"
ROWS_PER_FILE = 5_000_000


def write_observations(obs: DataFrame, path: str, mode: str = "append", ts: str = "datetime") -> None:
    """Stores observations below `path`; with mode "overwrite" only the days that `obs` holds are replaced.

    The rebalance hint gathers each day's rows into few files and lets adaptive execution split a day
    that holds much of the data. Rows without an instant lie in a folder of their own.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    dated = obs.withColumn(DAY, F.to_date(ts)).hint("rebalance", DAY).sortWithinPartitions(DAY, "node_id", ts)
    writer = dated.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.partitionBy(DAY).parquet(path)


def read_observations(
    spark: SparkSession, path: str, start=None, end=None, nodes: Sequence[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Stored observations in [start, end) of some nodes (any case); folders of other days are not opened.

    With the `schema` of the observations nothing is read to find it.
    """
    if schema is not None:
        schema = T.StructType([*[f for f in schema.fields if f.name != DAY], T.StructField(DAY, T.DateType())])
    stored = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    if start is not None:
        stored = stored.filter(F.col(DAY) >= F.to_date(ts_lit(start)))
    if end is not None:
        stored = stored.filter(F.col(DAY) <= F.to_date(ts_lit(end)))
    return select_observations(stored, start, end, nodes=nodes).drop(DAY)
