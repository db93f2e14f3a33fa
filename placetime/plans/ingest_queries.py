"""Queries on loading: deduplication, new rows, snapshots, type inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetime.operators import ingest
from placetime.plans.derived import derive, duck
from placetime.plans.registry import query
from placetime.plans.sizing import spread
from placetime.session import scratch_path
from placetime.sources.points import PointRoles, infer_schema

# The separator and null mark of a row hash, for the SQL side.
_ROW = "concat_ws(chr(31), COALESCE(CAST({a} AS VARCHAR), '\\N'), COALESCE({b}, '\\N'), COALESCE({c}, '\\N'))"


@query(
    "dedup_hash",
    "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, md5("
    + _ROW.format(a="l_orderkey", b="l_returnflag", c="l_linestatus")
    + ") AS hash FROM lineitem",
)
def dedup_hash(spark, sf):
    return ingest.dedup_hash(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus"))


@query(
    "ingest_points",
    duck("located_text")
    + "SELECT o.o_orderkey, o.o_orderpriority, o.o_orderdate AS point_date, TRY_CAST(regexp_extract(t.location, '-87[.][0-9]+') AS DOUBLE) AS lon,"
    " TRY_CAST(regexp_extract(t.location, '41[.][0-9]+') AS DOUBLE) AS lat, 32 AS hash_length"
    " FROM orders o JOIN located_text t USING (o_orderkey)",
)
def ingest_points(spark, sf):
    """Every row twice, its date as text in two layouts, its place as text."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    layout = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    raw = orders.join(derive(spark, sf, "located_text"), "o_orderkey").select(
        "o_orderkey", "o_orderpriority", layout.alias("date"), "location"
    )
    roles = PointRoles(date="date", location="location")
    stored = ingest.ingest_points(raw.unionByName(raw), roles, scratch_path(spark, "points"))
    return stored.select("o_orderkey", "o_orderpriority", "point_date", "lon", "lat", F.length("hash").alias("hash_length"))


@query(
    "ingest_points_coordinates",
    duck("order_points")
    + "SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN lon END AS lon, CASE WHEN o_custkey % 10 > 0 THEN lat END AS lat FROM order_points",
)
def ingest_points_coordinates(spark, sf):
    """Coordinates in columns; a place of (0, 0) is unknown."""
    known = F.col("o_custkey") % 10 > 0
    raw = derive(spark, sf, "order_points").select(
        "o_orderkey", F.when(known, F.col("lon")).otherwise(0.0).alias("x"), F.when(known, F.col("lat")).otherwise(0.0).alias("y")
    )
    return ingest.ingest_points(raw, PointRoles(lon="x", lat="y")).select("o_orderkey", "lon", "lat")


def _staging(spark, sf):
    return derive(spark, sf, "order_points").select("hash", "o_orderkey", "o_orderstatus", "point_date")


@query(
    "ingest_new_rows",
    duck("order_points") + "SELECT hash, o_orderkey, o_orderstatus, point_date FROM order_points WHERE o_orderstatus <> 'O'",
)
def ingest_new_rows(spark, sf):
    staging = _staging(spark, sf)
    return ingest.ingest_new_rows(staging, staging.filter(F.col("o_orderstatus") == "O"))


@query("append_new_rows", duck("order_points") + "SELECT hash, o_orderkey, o_orderstatus, point_date FROM order_points")
def append_new_rows(spark, sf):
    staging = _staging(spark, sf)
    return ingest.append_new_rows(staging.unionByName(staging), staging.filter(F.col("o_orderstatus") == "O"))


@query(
    "sync_snapshot",
    duck("order_points") + "SELECT hash, o_orderkey, o_orderstatus, point_date FROM order_points WHERE o_orderstatus IN ('F', 'P')",
)
def sync_snapshot(spark, sf):
    existing = _staging(spark, sf)
    return ingest.sync_snapshot(existing, existing.filter(F.col("o_orderstatus") != "O"))


@query(
    "point_catalog_row",
    duck("order_points")
    + "SELECT 'orders' AS dataset_name, min(point_date) AS obs_from, max(point_date) AS obs_to, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax,"
    " max(lat) AS ymax, count(*) AS num_rows, 'o_orderkey bigint, o_orderstatus string' AS columns FROM order_points",
)
def point_catalog_row(spark, sf):
    points = derive(spark, sf, "order_points").select("hash", "o_orderkey", "o_orderstatus", "point_date", "lon", "lat")
    row = ingest.point_catalog_row(points, "orders")
    shown = F.array_join(F.transform(F.map_entries("column_names"), lambda e: F.concat_ws(" ", e["key"], e["value"])), ", ")
    return row.withColumn("columns", shown).drop("column_names")


@query(
    "infer_schema",
    "SELECT * FROM (VALUES (1, 'order_key', 'int', false), (2, 'flag', 'boolean', false), (3, 'price', 'double', true), (4, 'big', 'bigint', false),"
    " (5, 'code', 'string', false), (6, 'day', 'date', true), (7, 'instant', 'timestamp_ntz', false), (8, 'clock', 'time', false),"
    " (9, 'status', 'string', true), (10, 'mixed', 'timestamp_ntz', false)) t(position, field_name, field_type, has_nulls)",
)
def types_of_text(spark, sf):
    """Types and nulls of text columns written in various ways."""
    lines = spread(spark.read.parquet(f"{sf}/lineitem.parquet"))
    key, date = F.col("l_orderkey"), F.col("l_shipdate")
    us_date = F.date_format(date, "MM/dd/yyyy")
    raw = lines.select(
        F.col("l_partkey").cast("string").alias("order_key"),
        F.when(key % 2 == 0, "Yes").otherwise("f").alias("flag"),
        F.when(key % 5 == 0, "n/a").otherwise(F.format_number("l_extendedprice", 2)).alias("price"),
        (F.lit(3_000_000_000) + key).cast("string").alias("big"),
        F.concat(F.lit("0"), (key + 100).cast("string")).alias("code"),
        F.when(key % 7 == 0, "").otherwise(us_date).alias("day"),
        F.concat(us_date, F.lit(" 01:30 pm")).alias("instant"),
        F.lpad((key % 24).cast("string"), 2, "0").alias("hour"),
        F.when(key % 3 == 0, "NA").otherwise(F.col("l_linestatus")).alias("status"),
        F.when(key % 2 == 0, us_date).otherwise(F.date_format(date, "yyyy-MM-dd HH:mm:ss")).alias("mixed"),
    )
    raw = raw.withColumn("hour", F.concat("hour", F.lit(":15"))).withColumnRenamed("hour", "clock")
    return infer_schema(raw)
