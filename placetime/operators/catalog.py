"""Dataset catalogs: extents, search, ingest status, metadata on rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.functions.geometry import Geometry, box_polygon, geometries_intersect, geometry, geometry_struct
from placetime.functions.timeparts import ts_lit
from placetime.plans.sizing import settled

# The catalog columns a search hands out.
PUBLIC_COLUMNS = (
    "human_name", "dataset_name", "source_url", "view_url", "date_added", "last_update",
    "update_freq", "attribution", "description", "obs_from", "obs_to", "observed_date",
    "latitude", "longitude", "location",
)


def dataset_extent(points: DataFrame, ts: str = "point_date") -> DataFrame:
    """First and last date, box and number of rows of a point dataset, in one pass."""
    return points.agg(
        F.min(ts).alias("obs_from"),
        F.max(ts).alias("obs_to"),
        F.min("lon").alias("xmin"),
        F.min("lat").alias("ymin"),
        F.max("lon").alias("xmax"),
        F.max("lat").alias("ymax"),
        F.count(F.lit(1)).alias("num_rows"),
    )


def shape_extent(shapes: DataFrame) -> DataFrame:
    """Box and number of shapes; rows without a geometry do not count."""
    return shapes.agg(
        F.min("geom.xmin").alias("xmin"),
        F.min("geom.ymin").alias("ymin"),
        F.max("geom.xmax").alias("xmax"),
        F.max("geom.ymax").alias("ymax"),
        F.count("geom").alias("num_shapes"),
    )


def box_geometry() -> Column:
    """The catalog's box columns as a geometry column, so that lines and concave areas match exactly."""
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners])
    return F.when(F.col("xmin").isNotNull(), geometry_struct(F.lit("Polygon"), F.array(F.array(ring))))


def catalog_search(
    catalog: DataFrame,
    name: str | None = None,
    start=None,
    end=None,
    geom: str | dict | Geometry | None = None,
    names: Sequence[str] | None = None,
    ingested: Column | None = None,
) -> DataFrame:
    """Datasets whose box meets `geom` and whose dates overlap (start, end), both strictly.

    Of a feature collection given as `geom` the first feature counts. A name asks for that one dataset and switches the other filters off; dates count only if
    both are given; datasets never ingested are left out.
    """
    found = catalog.filter(F.col("date_added").isNotNull() if ingested is None else ingested)
    if name is not None:
        return found.filter(F.col("dataset_name") == name)
    if names is not None:
        found = found.filter(F.col("dataset_name").isin(*names))
    if start is not None and end is not None:
        found = found.filter((F.col("obs_from") < ts_lit(end)) & (F.col("obs_to") > ts_lit(start)))
    if geom is not None:
        shape = geometry(geom)
        if shape.is_rectangle:
            x0, y0, x1, y1 = shape.box
            meets = (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)
            found = found.filter(meets)
        else:
            columns = found.columns
            found = found.withColumn("_box", box_geometry())
            found = found.filter(geometries_intersect(F.col("_box"), shape)).select(*columns)
    return found


def approved_names(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("approved_status")).select("dataset_name")


def public_view(catalog: DataFrame) -> DataFrame:
    """Public columns, the box as GeoJSON, and `column_names` as a list of name and type."""
    kept = [c for c in PUBLIC_COLUMNS if c in catalog.columns]
    box = F.when(
        F.col("xmin").isNotNull(), F.to_json(box_polygon(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    )
    fields = F.transform(
        F.map_entries("column_names"),
        lambda e: F.struct(e["key"].alias("field_name"), e["value"].alias("field_type")),
    )
    return catalog.select(*kept, box.alias("bbox"), fields.alias("columns"))


def latest_status(catalog: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every dataset with its most recent task; a task without an end date counts as newest.

    `result_ids` lists a dataset's tasks. The latest one is picked by an aggregate that keeps
    one row per dataset and task partition, so a dataset with very many tasks stays small.
    """
    unfinished = F.col("date_done").isNull().alias("unfinished")
    wanted = catalog.select("dataset_name", F.explode("result_ids").alias("task_id"))
    latest = (
        wanted.join(tasks.select("task_id", "date_done", "status"), "task_id")
        .groupBy("dataset_name")
        .agg(F.max(F.struct(unfinished, "date_done", "task_id", "status")).alias("latest"))
        .select("dataset_name", "latest.task_id", "latest.status", "latest.date_done")
    )
    return catalog.drop("result_ids").join(latest, "dataset_name", "left")


def attach_metadata(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog columns on every row, matched by `dataset_name`.

    The catalog is written, so Spark knows its size and broadcasts it while it is small; rows
    of a large dataset are not shuffled to one place then.
    """
    return rows.join(settled(catalog, "catalog"), "dataset_name", "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in `order`, by a row number within the key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def largest_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One whole row per key, the largest by the other columns in their order; maxima combine map side.

    Columns that have no order of their own, as maps, are compared as JSON.
    """
    others = [f for f in df.schema.fields if f.name not in keys]
    if not others:
        return df.distinct()
    row = F.struct(*[F.col(f"`{f.name}`") for f in others])
    if all(_orderable(f.dataType) for f in others):
        best = F.max(row)
    else:
        best = F.max_by(row, F.struct(*[
            F.col(f"`{f.name}`") if _orderable(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) for f in others
        ]))
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best.alias("_row"))
    return found.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`") for c in df.columns])
