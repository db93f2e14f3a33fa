"""Counts per time bucket, with empty buckets kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetime.functions.timeparts import DATE_UNITS, bucket, bucket_count, spine, step, ts_lit
from placetime.operators.dense import dense_runs
from placetime.operators.points import select_points

# Rows of (dataset, bucket, count); far below any broadcast limit.
SPINE_ROWS = 1_000_000


def _require(unit: str) -> None:
    if unit not in DATE_UNITS:
        raise ValueError(f"unit must be one of {', '.join(DATE_UNITS)}")


def timeseries(points: DataFrame, unit: str, start, end, ts: str = "point_date", **filters) -> DataFrame:
    """(time_bucket, count) for every bucket from the one holding `start` to the one holding `end`.

    Rows are counted before the join, so the only shuffle carries one row per bucket and task.
    The counts have no more rows than the spine, whose length follows from the arguments; that
    bound decides about the broadcast.
    """
    _require(unit)
    kept = select_points(points, start, end, ts=ts, **filters)
    counts = kept.groupBy(bucket(F.col(ts), unit).alias("time_bucket")).agg(F.count(F.lit(1)).alias("n"))
    if bucket_count(unit, start, end) <= SPINE_ROWS:
        counts = F.broadcast(counts)
    dense = spine(points.sparkSession, unit, start, end).join(counts, "time_bucket", "left")
    return dense.select("time_bucket", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def timeseries_panel(
    datasets: Mapping[str, DataFrame],
    unit: str,
    start,
    end,
    geom=None,
    trees: Mapping[str, Mapping] | None = None,
    keep_empty: bool = False,
    ts: str = "point_date",
) -> DataFrame:
    """(dataset_name, time_bucket, count, total) over several datasets.

    Each dataset keeps its own filters, is cut down to its bucket and tagged; all are counted
    in one aggregation, so one shuffle serves the panel. Datasets without a single matching
    row are left out unless `keep_empty`.
    """
    _require(unit)
    if not datasets:
        raise ValueError("no datasets given")
    trees = trees or {}
    tagged = [
        select_points(df, start, end, geom, trees.get(name), ts=ts).select(
            F.lit(name).alias("dataset_name"), bucket(F.col(ts), unit).alias("time_bucket")
        )
        for name, df in datasets.items()
    ]
    counts = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("dataset_name", "time_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if len(datasets) * bucket_count(unit, start, end) <= SPINE_ROWS:
        counts = F.broadcast(counts)
    spark = next(iter(datasets.values())).sparkSession
    names = F.array(*[F.lit(name) for name in datasets])
    grid = spine(spark, unit, start, end).withColumn("dataset_name", F.explode(names))
    dense = grid.join(counts, ["dataset_name", "time_bucket"], "left").select(
        "dataset_name", "time_bucket", F.coalesce("n", F.lit(0)).cast("long").alias("count")
    )
    panel = dense.withColumn("total", F.sum("count").over(Window.partitionBy("dataset_name")))
    return panel if keep_empty else panel.filter(F.col("total") > 0)


def stacked_panel(points: DataFrame, unit: str, start, end, by: str = "dataset_name", ts: str = "point_date", **filters) -> DataFrame:
    """The panel of datasets kept in one table, told apart by a column: one scan for any number of
    them. Datasets without a matching row do not appear."""
    _require(unit)
    kept = select_points(points, start, end, ts=ts, **filters)
    counts = kept.groupBy(by, bucket(F.col(ts), unit).alias("time_bucket")).agg(F.count(F.lit(1)).alias("n"))
    first, last = bucket(ts_lit(start), unit), bucket(ts_lit(end), unit)
    dense = dense_runs(counts, by, unit, first, last + step(unit))
    panel = dense.select(
        F.col(by).alias("dataset_name"),
        F.col("_bucket").alias("time_bucket"),
        F.when(F.col("_real"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("count"),
    )
    return panel.withColumn("total", F.sum("count").over(Window.partitionBy("dataset_name")))


def pivot_panel(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per dataset, one row per bucket, as in the CSV form of a panel."""
    return (
        panel.groupBy(F.to_date("time_bucket").alias("temporal_group"))
        .pivot("dataset_name", list(names))
        .agg(F.first("count"))
    )


def daily_counts(points: DataFrame, unit: str, start, end, **filters) -> DataFrame:
    """The series of one dataset as (count, datetime), the bucket as a date."""
    series = timeseries(points, unit, start, end, **filters)
    return series.select("count", F.to_date("time_bucket").alias("datetime"))


def series_of_several(datasets: Mapping[str, DataFrame], unit: str, start, end, trees=None, **filters) -> DataFrame:
    """Series of several filtered datasets appended (count, datetime)."""
    trees = trees or {}
    parts = [daily_counts(df, unit, start, end, tree=trees.get(name), **filters) for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, parts)


def series_total(series: DataFrame) -> DataFrame:
    """What a response envelope reports: number of rows and sum of counts."""
    return series.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
