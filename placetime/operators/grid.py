"""Counts on a map lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.functions.geometry import box_polygon, degrees_east, degrees_north, snap
from placetime.functions.timeparts import JSON_OPTIONS
from placetime.operators.catalog import dataset_extent
from placetime.operators.points import select_points


def grid_count(points: DataFrame, resolution: float = 500, extent: DataFrame | None = None, **filters) -> DataFrame:
    """Points per lattice cell of `resolution` metres, with the cell's corners.

    The lattice is sized at the middle latitude of the whole dataset. Give `extent` (one row
    with ymin and ymax, as the catalog keeps it) to save the pass that measures it; it enters
    as a scalar subquery. Points without a place share one cell without corners.
    """
    extent = dataset_extent(points) if extent is None else extent
    middle = extent.select(((F.col("ymin") + F.col("ymax")) / 2).alias("middle")).scalar()
    sized = select_points(points, **filters).select(
        "lon", "lat", degrees_east(resolution, middle).alias("size_x"), degrees_north(resolution).alias("size_y")
    )
    # Adding zero turns -0.0 into 0.0, so that both sides of the axis share a cell.
    cells = sized.groupBy(
        (snap(F.col("lon"), F.col("size_x")) + 0.0).alias("x"),
        (snap(F.col("lat"), F.col("size_y")) + 0.0).alias("y"),
        "size_x",
        "size_y",
    ).agg(F.count(F.lit(1)).alias("count"))
    half_x, half_y = F.col("size_x") / 2, F.col("size_y") / 2
    return cells.select(
        "count",
        (F.col("x") - half_x).alias("xmin"),
        (F.col("y") - half_y).alias("ymin"),
        (F.col("x") + half_x).alias("xmax"),
        (F.col("y") + half_y).alias("ymax"),
    )


def grid_features(cells: DataFrame) -> DataFrame:
    """Grid cells as GeoJSON features, one per row; the cell without a place has no geometry."""
    square = F.when(F.col("xmin").isNotNull(), box_polygon(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        square.alias("geometry"),
        F.struct(F.col("count")).alias("properties"),
    )
    return cells.select(F.to_json(feature, JSON_OPTIONS).alias("value"))
