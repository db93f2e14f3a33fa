"""GeoJSON shape files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placetime.functions.geometry import geometry_struct
from placetime.functions.text import slugs

_POSITION = "array<double>"
_DEPTH = {"LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def _coordinates(text: Column, depth: int) -> Column:
    return F.from_json(text, "array<" * depth + _POSITION + ">" * depth)


def _line(positions: Column) -> Column:
    return F.transform(positions, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _lines(rings: Column) -> Column:
    return F.transform(rings, _line)


def geometry_from_json(kind: Column, coordinates: Column) -> Column:
    """A geometry column from a GeoJSON type and the text of its coordinates.

    Single polygons and lines become multi-part ones.
    """

    def read(name: str) -> Column:
        return _coordinates(coordinates, _DEPTH[name])

    area = geometry_struct(
        F.lit("MultiPolygon"),
        F.when(kind == "Polygon", F.array(_lines(read("Polygon")))).otherwise(
            F.transform(read("MultiPolygon"), _lines)
        ),
    )
    line = geometry_struct(
        F.lit("MultiLineString"),
        F.when(kind == "LineString", F.array(F.array(_line(read("LineString"))))).otherwise(
            F.transform(read("MultiLineString"), lambda one: F.array(_line(one)))
        ),
    )
    return F.when(kind.isin("Polygon", "MultiPolygon"), area).when(kind.isin("LineString", "MultiLineString"), line)


def _feature_type(properties: str) -> str:
    return f"struct<type:string, geometry:struct<type:string, coordinates:string>, properties:struct<{properties}>>"


def _columns(features: DataFrame) -> DataFrame:
    """The struct column `f` opened into slugged attributes and `geom`."""
    names = features.schema["f"].dataType["properties"].dataType.names
    return features.select(
        *[F.col("f.properties")[old].alias(new) for old, new in zip(names, slugs(names))],
        geometry_from_json(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geom"),
    )


def parse_features(lines: DataFrame, properties: str, column: str = "value") -> DataFrame:
    """Features, one JSON text per row, as columns of `properties` (name:type, ...) plus `geom`."""
    return _columns(lines.select(F.from_json(column, _feature_type(properties)).alias("f")))


def read_shapes(
    spark: SparkSession, path: str | Sequence[str], properties: str | None = None, layout: str = "document"
) -> DataFrame:
    """Shapes from GeoJSON. `layout` says what the files hold: one feature collection each
    ("document"), one collection per line ("collections") or one feature per line ("features").

    A document is one task's work, so large data should come by line. `properties` gives the
    attributes as `name:type, ...`; without it Spark looks through the data for them.
    """
    if layout not in ("document", "collections", "features"):
        raise ValueError(f"unknown layout {layout!r}")
    multi_line = layout == "document"
    if properties is None:
        seen = spark.read.json(path, multiLine=multi_line).schema
        feature = seen if layout == "features" else seen["features"].dataType.elementType
        properties = ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in feature["properties"].dataType.fields)
    if layout == "features":
        return parse_features(spark.read.text(path), properties)
    documents = spark.read.schema(f"features array<{_feature_type(properties)}>").json(path, multiLine=multi_line)
    return _columns(documents.select(F.explode("features").alias("f")))


def with_row_number(shapes: DataFrame, name: str = "ogc_fid") -> DataFrame:
    """A unique id per shape; not dense, as numbering rows densely would pass them through one task."""
    return shapes.withColumn(name, F.monotonically_increasing_id())
