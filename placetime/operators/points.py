"""Detail queries on point datasets and how their rows are presented."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.functions.geometry import point_geojson, point_in
from placetime.functions.timeparts import JSON_OPTIONS, ts_lit
from placetime.operators.filters import compile_tree, time_of_day
from placetime.operators.paging import newest

DERIVED = ("point_date", "hash", "lon", "lat")


def select_points(
    points: DataFrame,
    start=None,
    end=None,
    geom=None,
    tree: Mapping | str | None = None,
    hours: tuple[int, int] | None = None,
    ts: str = "point_date",
) -> DataFrame:
    """The filters all point queries share. Dates are inclusive at both ends; of a feature collection
    given as `geom` the first feature counts."""
    if start is not None:
        points = points.filter(F.col(ts) >= ts_lit(start))
    if end is not None:
        points = points.filter(F.col(ts) <= ts_lit(end))
    if hours is not None:
        points = points.filter(time_of_day(F.col(ts), *hours))
    if tree is not None:
        points = points.filter(compile_tree(points.schema, tree))
    if geom is not None:
        points = points.filter(point_in(F.col("lon"), F.col("lat"), geom))
    return points


def detail(
    points: DataFrame, limit: int = 1000, offset: int = 0, tie: Sequence[str] = ("hash",), max_limit: int | None = None, **filters
) -> DataFrame:
    """The newest matching rows; a service may set the greatest limit it allows."""
    if limit < 0 or (max_limit is not None and limit > max_limit):
        raise ValueError(f"limit must not be negative, nor above {max_limit}")
    return newest(select_points(points, **filters), filters.get("ts", "point_date"), tie, limit, offset)


def present(points: DataFrame, fmt: str = "json") -> DataFrame:
    """Rows as handed out: derived columns dropped, or one GeoJSON feature per row."""
    if fmt in ("json", "csv"):
        return points.drop(*DERIVED)
    if fmt == "geojson":
        return features(points, hidden=("point_date", "hash"))
    raise ValueError(f"unknown format {fmt!r}")


def features(points: DataFrame, hidden: Sequence[str] = ("hash",)) -> DataFrame:
    """One GeoJSON feature per row as `value`; rows without a place are left out."""
    properties = [c for c in points.columns if c not in {*hidden, "lon", "lat"}]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        point_geojson(F.col("lon"), F.col("lat")).alias("geometry"),
        F.struct(*[F.col(f"`{c}`") for c in properties]).alias("properties"),
    )
    placed = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return placed.select(F.to_json(feature, JSON_OPTIONS).alias("value"))
