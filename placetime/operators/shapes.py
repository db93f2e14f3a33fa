"""Filters, counts and exports on shape datasets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.functions.geometry import AREA_KINDS, Geometry, geometries_intersect, rings_coordinates, rings_of
from placetime.functions.timeparts import JSON_OPTIONS
from placetime.operators.filters import compile_tree

INTERNAL = ("geom", "hash", "ogc_fid")


def shapes_filter(
    shapes: DataFrame,
    geom: str | dict | Geometry | None = None,
    tree: Mapping | str | None = None,
) -> DataFrame:
    """Shapes that meet a geometry and a condition tree; of a feature collection the first feature counts."""
    if tree is not None:
        shapes = shapes.filter(compile_tree(shapes.schema, tree))
    if geom is not None:
        shapes = shapes.filter(geometries_intersect(F.col("geom"), geom))
    return shapes


def shapes_intersecting(datasets: Mapping[str, DataFrame], geom: str | dict | Geometry) -> DataFrame:
    """(dataset_name, num_shapes) for the shape datasets that meet a geometry; others are left out."""
    tagged = [shapes_filter(df.select("geom"), geom).select(F.lit(name).alias("dataset_name")) for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("num_shapes"))


def shape_features(shapes: DataFrame) -> DataFrame:
    """One GeoJSON feature per shape as `value`; rows without a geometry are left out."""
    properties = [F.col(f"`{c}`") for c in shapes.columns if c not in INTERNAL]

    def feature(kind: str, coordinates: Column) -> Column:
        geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
        whole = F.struct(
            F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")
        )
        return F.to_json(whole, JSON_OPTIONS)

    areas = feature("MultiPolygon", F.transform("geom.parts", rings_coordinates))
    lines = feature("MultiLineString", rings_coordinates(rings_of(F.col("geom"))))
    value = F.when(F.col("geom.kind").isin(*AREA_KINDS), areas).otherwise(lines)
    return shapes.filter(F.col("geom").isNotNull()).select(value.alias("value"))
