"""Writers. Every export is a distributed write; one file per task."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.functions.timeparts import CSV_OPTIONS, JSON_OPTIONS, month_bounds, ts_lit
from placetime.operators.points import features
from placetime.operators.shapes import shape_features

ROWS_PER_FILE = 5_000_000


def export_points_csv(points: DataFrame, path: str) -> None:
    """All columns but the derived hash and place."""
    points.drop("hash", "lon", "lat").write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def export_points_geojson(points: DataFrame, path: str) -> None:
    """One feature per line."""
    features(points).write.mode("overwrite").text(path)


def export_shapes(shapes: DataFrame, path: str) -> None:
    shape_features(shapes).write.mode("overwrite").text(path)


def export_observations(by_feature: Mapping[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """Several features' observations: a CSV folder each, or one JSON-lines set over all."""
    if fmt == "csv":
        for feature, df in by_feature.items():
            df.write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path.rstrip('/')}/feature={feature}")
    elif fmt == "json":
        tagged = [df.withColumn("feature", F.lit(name)) for name, df in by_feature.items()]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        whole.write.mode("overwrite").options(**JSON_OPTIONS).json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def archive_month(by_feature: Mapping[str, DataFrame], month, path: str, ts: str = "datetime") -> None:
    """The observations of one month as gzipped CSV, in feature=/month=/node= folders.

    The rebalance hint gathers each node's rows into few files, and lets adaptive execution
    split a node that holds much of the data over several tasks.
    """
    start, end = month_bounds(month)
    for feature, df in by_feature.items():
        kept = df.filter((F.col(ts) >= ts_lit(start)) & (F.col(ts) < ts_lit(end))).withColumn("node", F.col("node_id"))
        target = f"{path.rstrip('/')}/feature={feature}/month={start:%Y-%m}"
        writer = kept.hint("rebalance", "node").write.mode("overwrite").partitionBy("node")
        writer.options(**CSV_OPTIONS, maxRecordsPerFile=ROWS_PER_FILE).csv(target, compression="gzip")
