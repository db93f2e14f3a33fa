"""From raw rows to a point or shape dataset, and keeping it up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.functions.text import location_lat, location_lon, row_hash, strict_double
from placetime.operators.catalog import dataset_extent, largest_per_key, shape_extent
from placetime.operators.layout import along_curve
from placetime.sources.points import PointRoles, parse_instant

DERIVED = ("hash", "point_date", "lon", "lat", "geom")


def dedup_hash(df: DataFrame) -> DataFrame:
    """Distinct rows with an md5 over all columns as `hash`.

    Rows are dealt by their hash into tasks of even size first, whatever the tasks that bring them, so what a task merges
    is bounded. Equal rows are merged in every task before they meet, and a crowded hash is cut up, so many copies of one row stay cheap.
    """
    bucket = "_bucket"
    while bucket in (c.lower() for c in df.columns):
        bucket = f"_{bucket}"
    dealt = df.withColumn(bucket, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).hint("rebalance", bucket)
    return dealt.drop(bucket).distinct().withColumn("hash", row_hash(df.columns))


def _instant(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    return parse_instant(column) if isinstance(df.schema[name].dataType, T.StringType) else column.cast("timestamp_ntz")


def _coordinate(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    return strict_double(column) if isinstance(df.schema[name].dataType, T.StringType) else column.cast("double")


def derive_point(df: DataFrame, roles: PointRoles) -> DataFrame:
    """Adds `point_date`, `lon`, `lat`; a place needs both coordinates, and (0, 0) is no place."""
    if roles.lat and roles.lon:
        lon, lat = _coordinate(df, roles.lon), _coordinate(df, roles.lat)
    else:
        text = F.col(f"`{roles.location}`")
        lon, lat = location_lon(text), location_lat(text)
    known = lon.isNotNull() & lat.isNotNull() & ~((lon == 0) & (lat == 0))
    when = _instant(df, roles.date) if roles.date else F.lit(None).cast("timestamp_ntz")
    return df.select(
        "*", when.alias("point_date"), F.when(known, lon).alias("lon"), F.when(known, lat).alias("lat")
    )


def ingest_points(df: DataFrame, roles: PointRoles, path: str | None = None) -> DataFrame:
    """A point dataset from typed rows: deduplicated, hashed, placed in time and space.

    With a `path` the result replaces what is stored there, as a refresh rebuilds a dataset, laid
    out along a curve through date and place (see `layout`), which lets filters skip files.
    """
    # The user's own coordinate columns may already be called lon and lat.
    taken = {"lon", "lat", "point_date"} & set(df.columns)
    raw = df.select(*[F.col(f"`{c}`").alias(f"source_{c}" if c in taken else c) for c in df.columns])

    def moved(name):
        return f"source_{name}" if name in taken else name

    roles = PointRoles(
        date=roles.date and moved(roles.date),
        lat=roles.lat and moved(roles.lat),
        lon=roles.lon and moved(roles.lon),
        location=roles.location and moved(roles.location),
    )
    points = derive_point(dedup_hash(raw), roles)
    if path is None:
        return points
    along_curve(points).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def ingest_shapes(shapes: DataFrame, path: str | None = None) -> DataFrame:
    """A shape dataset: distinct rows with a hash, stored if a `path` is given."""
    hashed = dedup_hash(shapes)
    if path is None:
        return hashed
    hashed.write.mode("overwrite").parquet(path)
    return shapes.sparkSession.read.parquet(path)


def ingest_new_rows(staging: DataFrame, existing: DataFrame, keys: Sequence[str] = ("hash",)) -> DataFrame:
    """Staging rows whose key is not stored yet, the largest row per key."""
    return largest_per_key(staging, keys).join(existing.select(*keys), list(keys), "left_anti")


def append_new_rows(staging: DataFrame, existing: DataFrame, keys: Sequence[str] = ("hash",)) -> DataFrame:
    """The stored rows and the new ones."""
    return existing.unionByName(ingest_new_rows(staging, existing, keys), allowMissingColumns=True)


def sync_snapshot(existing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Stored rows that are still in the newest snapshot."""
    return existing.join(snapshot.select("hash"), "hash", "left_semi")


def point_catalog_row(points: DataFrame, dataset_name: str) -> DataFrame:
    """What an ingest writes into the catalog: extent and the columns with their types."""
    fields = [(f.name, f.dataType.simpleString()) for f in points.schema.fields if f.name not in DERIVED]
    names = F.create_map(*[F.lit(part) for pair in fields for part in pair])
    return dataset_extent(points).select(F.lit(dataset_name).alias("dataset_name"), "*", names.alias("column_names"))


def shape_catalog_row(shapes: DataFrame, dataset_name: str) -> DataFrame:
    return shape_extent(shapes).select(F.lit(dataset_name).alias("dataset_name"), "*")
