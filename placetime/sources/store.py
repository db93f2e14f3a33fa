"""Stored point datasets: one parquet folder each, found through the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.operators.catalog import catalog_search
from placetime.operators.timeseries import stacked_panel

#: What every point dataset holds besides its own columns.
SHARED = "hash string, point_date timestamp_ntz, lon double, lat double"
NAME = "dataset_name"


def dataset_path(root: str, name: str) -> str:
    """A dataset's folder; its name is told as a partition, so that all folders of a root are one table."""
    return f"{root.rstrip('/')}/{NAME}={name}"


def found_names(catalog: DataFrame, approved_only: bool = True, **search) -> DataFrame:
    found = catalog_search(catalog, **search)
    return (found.filter("approved_status") if approved_only else found).select(NAME)


def open_datasets(catalog: DataFrame, root: str, approved_only: bool = True, **search) -> dict[str, DataFrame]:
    """The datasets a catalog search finds, by name, each with its own columns; all approved ones without arguments.

    Only names come to the driver. Datasets whose dates or box cannot match are never read. For
    many datasets at once use `stored_points`.
    """
    names = [row[NAME] for row in found_names(catalog, approved_only, **search).orderBy(NAME).collect()]
    return {name: catalog.sparkSession.read.parquet(dataset_path(root, name)) for name in names}


def stored_points(
    catalog: DataFrame, root: str, approved_only: bool = True, columns: str = SHARED, **search
) -> DataFrame:
    """The points of all datasets that a catalog search finds, with `dataset_name` and the shared columns.

    One scan for any number of datasets. The names found prune its folders while it runs, so folders of other datasets
    are not read, and no name comes to the driver.
    """
    schema = T.StructType.fromDDL(f"{columns}, {NAME} string")
    stored = catalog.sparkSession.read.schema(schema).option("basePath", root).parquet(root)
    return stored.join(found_names(catalog, approved_only, **search), NAME, "left_semi")


def catalog_panel(
    catalog: DataFrame, root: str, unit: str, start, end, geom=None, names: Sequence[str] | None = None, approved_only: bool = True
) -> DataFrame:
    """(dataset_name, time_bucket, count, total) over the datasets of a catalog whose dates and box fit; the plan
    doesn't grow with their number. Datasets without a matching point do not appear."""
    points = stored_points(catalog, root, approved_only, start=start, end=end, geom=geom, names=names)
    return stacked_panel(points, unit, start, end, geom=geom)
