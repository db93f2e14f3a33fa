"""Queries on point datasets: filters, detail, series, grids, catalogs, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetime.functions.geometry import geometry, metres_to_degrees
from placetime.functions.text import location_lat, location_lon
from placetime.operators import catalog as cat
from placetime.operators import points as pts
from placetime.operators import timeseries as ts
from placetime.operators.filters import compile_arguments, time_of_day
from placetime.operators.grid import grid_count
from placetime.plans.derived import derive, duck
from placetime.plans.registry import query
from placetime.session import scratch_path
from placetime.sources import exports, store
from placetime.sources.points import read_points

EVENT_START, EVENT_END = "2024-01-05 06:30:00", "2024-01-24 18:00:00"
ORDER_START, ORDER_END = "1995-03-15", "2001-02-10"

# A concave area with a hole, a line and a rectangle inside the box the derived points fill.
AREA = {
    "type": "Feature",
    "geometry": {
        "type": "Polygon",
        "coordinates": [
            [[-87.85, 41.65], [-87.55, 41.68], [-87.6, 41.95], [-87.7, 41.8], [-87.83, 41.93], [-87.85, 41.65]],
            [[-87.72, 41.7], [-87.66, 41.7], [-87.66, 41.75], [-87.72, 41.75], [-87.72, 41.7]],
        ],
    },
}
LINE = {"type": "LineString", "coordinates": [[-87.85, 41.65], [-87.7, 41.8], [-87.7, 41.9], [-87.55, 41.62]]}
RECTANGLE = {
    "type": "Polygon",
    "coordinates": [[[-87.8, 41.7], [-87.6, 41.7], [-87.6, 41.9], [-87.8, 41.9], [-87.8, 41.7]]],
}

TREE = {
    "op": "or",
    "val": [
        {"op": "and", "val": [{"op": "eq", "col": "event_type", "val": "purchase"}, {"op": "gt", "col": "value", "val": "50"}]},
        {"op": "and", "val": [
            {"op": "ne", "col": "event_type", "val": "click"},
            {"op": "or", "val": [
                {"op": "lt", "col": "value", "val": 5},
                {"op": "ge", "col": "point_date", "val": "2024-01-28"},
                {"op": "le", "col": "user_id", "val": 3},
            ]},
        ]},
    ],
}
TREE_SQL = (
    "((event_type = 'purchase' AND value > 50) OR (event_type <> 'click' AND"
    " (value < 5 OR point_date >= TIMESTAMP '2024-01-28' OR user_id <= 3)))"
)

EVENT_COLUMNS = "event_id, user_id, event_type, value, point_date, lon, lat"


def lit(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def edges_sql(shape) -> str:
    rows = [f"({', '.join(lit(v) for v in edge)})" for edge in geometry(shape).edges]
    return "border(x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


def _events(spark, sf):
    return derive(spark, sf, "event_points")


def _orders(spark, sf):
    return derive(spark, sf, "order_points")


def _event_columns(df):
    return df.select(*EVENT_COLUMNS.split(", "))


# -- filters --------------------------------------------------------------------------------


@query("filter_tree", duck("event_points") + f"SELECT {EVENT_COLUMNS} FROM event_points WHERE {TREE_SQL}")
def filter_tree(spark, sf):
    return _event_columns(pts.select_points(_events(spark, sf), tree=TREE))


@query(
    "filter_like",
    duck("event_points")
    + "SELECT event_id, event_type, props FROM event_points WHERE event_type LIKE '%i%' OR event_type ILIKE 'CLI%' OR props LIKE '%: 7_}'",
)
def filter_like(spark, sf):
    tree = {
        "op": "or",
        "val": [
            {"op": "like", "col": "event_type", "val": "%i%"},
            {"op": "ilike", "col": "event_type", "val": "CLI%"},
            {"op": "like", "col": "props", "val": "%: 7_}"},
        ],
    }
    return pts.select_points(_events(spark, sf), tree=tree).select("event_id", "event_type", "props")


@query(
    "filter_null",
    duck("order_points")
    + "SELECT o_orderkey, o_orderstatus FROM order_points WHERE point_date IS NULL OR (lon IS NULL AND o_orderstatus IS NOT DISTINCT FROM 'F')",
)
def filter_null(spark, sf):
    tree = {
        "op": "or",
        "val": [
            {"op": "is", "col": "point_date", "val": None},
            {"op": "and", "val": [
                {"op": "is", "col": "lon", "val": "null"},
                {"op": "is", "col": "o_orderstatus", "val": "F"},
            ]},
        ],
    }
    return pts.select_points(_orders(spark, sf), tree=tree).select("o_orderkey", "o_orderstatus")


@query(
    "filter_in",
    duck("event_points")
    + "SELECT event_id, event_type, user_id FROM event_points WHERE event_type IN ('click', 'error') AND user_id IN (1, 2, 3, 5, 8, 13)",
)
def filter_in(spark, sf):
    tree = {
        "op": "and",
        "val": [
            {"op": "in", "col": "event_type", "val": "click,error"},
            {"op": "in", "col": "user_id", "val": "1,2,3,5,8,13"},
        ],
    }
    return pts.select_points(_events(spark, sf), tree=tree).select("event_id", "event_type", "user_id")


@query(
    "filter_flat",
    duck("event_points")
    + "SELECT event_id, event_type, value, point_date FROM event_points WHERE event_type = 'view' AND value >= 20"
    " AND point_date >= TIMESTAMP '2024-01-10' AND point_date <= TIMESTAMP '2024-01-25'"
    " AND hour(point_date) >= 6 AND hour(point_date) <= 20",
)
def filter_flat(spark, sf):
    points = _events(spark, sf)
    arguments = {
        "event_type": "view", "value__ge": "20", "obs_date__ge": "2024-01-10", "obs_date__le": "2024-01-25",
        "date__time_of_day_ge": 6, "date__time_of_day_le": 20, "limit": 1000, "nonsense__eq": "1",
    }
    wanted, _ = compile_arguments(points.schema, arguments)
    return points.filter(wanted).select("event_id", "event_type", "value", "point_date")


@query("time_of_day", duck("event_points") + "SELECT event_id, point_date FROM event_points WHERE hour(point_date) BETWEEN 5 AND 17")
def hour_range(spark, sf):
    points = _events(spark, sf)
    return points.filter(time_of_day(F.col("point_date"), 5, 17)).select("event_id", "point_date")


@query(
    "within_polygon",
    duck("event_points")
    + f", {edges_sql(AREA)}, pairs AS (SELECT hash, lon, lat, x1, y1, x2, y2 FROM event_points, border WHERE lon IS NOT NULL),"
    " inside AS (SELECT hash FROM pairs GROUP BY hash HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat)"
    " AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"
    " SELECT event_id, lon, lat FROM event_points WHERE hash IN (SELECT hash FROM inside)",
)
def within_polygon(spark, sf):
    return pts.select_points(_events(spark, sf), geom=AREA).select("event_id", "lon", "lat")


@query(
    "within_rectangle",
    duck("ship_points")
    + "SELECT l_orderkey, l_linenumber, lon, lat FROM ship_points"
    f" WHERE lon > {lit(-87.8)} AND lon < {lit(-87.6)} AND lat > {lit(41.7)} AND lat < {lit(41.9)}",
)
def within_rectangle(spark, sf):
    points = pts.select_points(derive(spark, sf, "ship_points"), geom=RECTANGLE)
    return points.select("l_orderkey", "l_linenumber", "lon", "lat")


_REACH = metres_to_degrees(100, 0)[1]


@query(
    "within_line_buffer",
    duck("ship_points")
    + f", {edges_sql(LINE)}, along AS (SELECT p.*, p.rowid_ AS r, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1))"
    " / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS raw, x1, y1, x2, y2"
    " FROM (SELECT *, row_number() OVER () AS rowid_ FROM ship_points) p, border),"
    " near AS (SELECT *, x1 + greatest(0e0, least(1e0, raw)) * (x2 - x1) AS nx, y1 + greatest(0e0, least(1e0, raw)) * (y2 - y1) AS ny FROM along)"
    " SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, any_value(l_quantity) AS l_quantity,"
    " any_value(lon) AS lon, any_value(lat) AS lat FROM near"
    f" WHERE (lon - nx) * (lon - nx) + (lat - ny) * (lat - ny) <= {lit(_REACH * _REACH)} GROUP BY r",
)
def within_line_buffer(spark, sf):
    points = pts.select_points(derive(spark, sf, "ship_points"), geom=LINE)
    return points.select("l_orderkey", "l_linenumber", "l_quantity", "lon", "lat")


# -- detail ---------------------------------------------------------------------------------


@query(
    "detail",
    duck("event_points")
    + f"SELECT {EVENT_COLUMNS} FROM event_points WHERE point_date >= TIMESTAMP '{EVENT_START}' AND point_date <= TIMESTAMP '{EVENT_END}'"
    " AND event_type <> 'view' ORDER BY point_date DESC NULLS FIRST, hash LIMIT 1000 OFFSET 20",
)
def detail(spark, sf):
    tree = {"op": "ne", "col": "event_type", "val": "view"}
    page = pts.detail(_events(spark, sf), 1000, 20, start=EVENT_START, end=EVENT_END, tree=tree)
    return _event_columns(page)


@query(
    "detail_undated_first",
    duck("order_points") + "SELECT o_orderkey, point_date, lon, lat FROM order_points ORDER BY point_date DESC NULLS FIRST, hash LIMIT 500",
)
def detail_undated_first(spark, sf):
    return pts.detail(_orders(spark, sf), 500).select("o_orderkey", "point_date", "lon", "lat")


@query(
    "detail_geojson",
    duck("event_points")
    + "SELECT 'Feature' AS kind, lon AS x, lat AS y, event_id, event_type, value FROM event_points"
    " WHERE lon IS NOT NULL AND event_type IN ('signup', 'error')",
)
def detail_geojson(spark, sf):
    tree = {"op": "in", "col": "event_type", "val": "signup,error"}
    rows = pts.present(pts.select_points(_events(spark, sf), tree=tree), "geojson")
    return _read_features(rows, "event_id long, event_type string, value double")


def _read_features(lines, properties: str):
    layout = f"type string, geometry struct<type:string, coordinates:array<double>>, properties struct<{properties.replace(' ', ':')}>"
    layout = layout.replace(",:", ", ")
    f = lines.select(F.from_json("value", layout).alias("f"))
    return f.select(
        F.col("f.type").alias("kind"),
        F.col("f.geometry.coordinates")[0].alias("x"),
        F.col("f.geometry.coordinates")[1].alias("y"),
        "f.properties.*",
    )


# -- series ---------------------------------------------------------------------------------


def series_sql(table: str, unit: str, start: str, end: str, where: str = "TRUE") -> str:
    """A dense series as a select, for use behind a WITH clause."""
    step = "3 MONTH" if unit == "quarter" else f"1 {unit.upper()}"
    return (
        f"SELECT t.time_bucket, COALESCE(c.n, 0) AS count FROM"
        f" (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{start}'), date_trunc('{unit}', TIMESTAMP '{end}'),"
        f" INTERVAL {step})) AS time_bucket) t LEFT JOIN"
        f" (SELECT CAST(date_trunc('{unit}', point_date) AS TIMESTAMP) AS time_bucket, count(*) AS n FROM {table}"
        f" WHERE point_date >= TIMESTAMP '{start}' AND point_date <= TIMESTAMP '{end}' AND {where} GROUP BY 1) c"
        f" ON t.time_bucket = c.time_bucket"
    )


@query("timeseries", duck("event_points") + series_sql("event_points", "day", "2023-12-28", "2024-02-03", TREE_SQL))
def timeseries(spark, sf):
    return ts.timeseries(_events(spark, sf), "day", "2023-12-28", "2024-02-03", tree=TREE)


def _unit_query(unit: str) -> None:
    sql = duck("ship_points") + series_sql("ship_points", unit, ORDER_START, ORDER_END)

    @query(f"timeseries_{unit}", sql)
    def run(spark, sf):
        return ts.timeseries(derive(spark, sf, "ship_points"), unit, ORDER_START, ORDER_END)


for _unit in ("week", "month", "quarter", "year"):
    _unit_query(_unit)

_RECT_SQL = f"lon > {lit(-87.8)} AND lon < {lit(-87.6)} AND lat > {lit(41.7)} AND lat < {lit(41.9)}"


@query("timeseries_within", duck("ship_points") + series_sql("ship_points", "month", ORDER_START, ORDER_END, _RECT_SQL))
def timeseries_within(spark, sf):
    return ts.timeseries(derive(spark, sf, "ship_points"), "month", ORDER_START, ORDER_END, geom=RECTANGLE)


PANEL_START, PANEL_END = "1995-01-15", "2024-06-01"


def panel_sql() -> str:
    parts = {
        "events": series_sql("event_points", "quarter", PANEL_START, PANEL_END, "event_type <> 'view'"),
        "orders": series_sql("order_points", "quarter", PANEL_START, PANEL_END),
        "shipments": series_sql("ship_points", "quarter", PANEL_START, PANEL_END),
        "none": series_sql("order_points", "quarter", PANEL_START, PANEL_END, "FALSE"),
    }
    union = " UNION ALL ".join(f"SELECT '{n}' AS dataset_name, s.time_bucket, s.count FROM ({q}) s" for n, q in parts.items())
    return (
        duck("event_points", "order_points", "ship_points")
        + f", panel AS ({union}), totals AS (SELECT dataset_name, sum(count) AS total FROM panel GROUP BY 1)"
        " SELECT dataset_name, time_bucket, count, CAST(total AS BIGINT) AS total FROM panel JOIN totals USING (dataset_name) WHERE total > 0"
    )


def _panel(spark, sf, unit="quarter"):
    orders = _orders(spark, sf)
    datasets = {
        "events": _events(spark, sf), "orders": orders, "shipments": derive(spark, sf, "ship_points"), "none": orders,
    }
    trees = {
        "events": {"op": "ne", "col": "event_type", "val": "view"},
        "none": {"op": "eq", "col": "o_orderstatus", "val": "no such status"},
    }
    return ts.timeseries_panel(datasets, unit, PANEL_START, PANEL_END, trees=trees)


@query("timeseries_panel", panel_sql())
def timeseries_panel(spark, sf):
    return _panel(spark, sf)


@query(
    "timeseries_stacked",
    duck("order_points")
    + ", kept AS (SELECT o_orderpriority AS dataset_name, CAST(date_trunc('month', point_date) AS TIMESTAMP) AS time_bucket FROM order_points"
    f" WHERE point_date >= TIMESTAMP '{ORDER_START}' AND point_date <= TIMESTAMP '{ORDER_END}' AND o_totalprice > 300000),"
    " counts AS (SELECT dataset_name, time_bucket, count(*) AS n FROM kept GROUP BY ALL),"
    " totals AS (SELECT dataset_name, count(*) AS total FROM kept GROUP BY ALL),"
    f" series AS (SELECT unnest(generate_series(date_trunc('month', TIMESTAMP '{ORDER_START}'), date_trunc('month', TIMESTAMP '{ORDER_END}'),"
    " INTERVAL 1 MONTH)) AS time_bucket)"
    " SELECT t.dataset_name, s.time_bucket, COALESCE(n, 0) AS count, total FROM totals t CROSS JOIN series s"
    " LEFT JOIN counts c ON c.dataset_name = t.dataset_name AND c.time_bucket = s.time_bucket",
)
def timeseries_stacked(spark, sf):
    tree = {"op": "gt", "col": "o_totalprice", "val": 300000}
    return ts.stacked_panel(_orders(spark, sf), "month", ORDER_START, ORDER_END, by="o_orderpriority", tree=tree)


_CATALOG_NAMES = "'ds' || CAST(o_custkey % 40 AS {t})"
_MONTHS = (
    "kept AS (SELECT dataset_name, CAST(date_trunc('month', point_date) AS TIMESTAMP) AS time_bucket FROM named JOIN found USING (dataset_name)"
    f" WHERE point_date >= TIMESTAMP '{ORDER_START}' AND point_date <= TIMESTAMP '{ORDER_END}' AND {_RECT_SQL}),"
    " counts AS (SELECT dataset_name, time_bucket, count(*) AS n FROM kept GROUP BY ALL),"
    " totals AS (SELECT dataset_name, count(*) AS total FROM kept GROUP BY ALL),"
    f" series AS (SELECT unnest(generate_series(date_trunc('month', TIMESTAMP '{ORDER_START}'), date_trunc('month', TIMESTAMP '{ORDER_END}'),"
    " INTERVAL 1 MONTH)) AS time_bucket)"
)


@query(
    "timeseries_catalog",
    duck("order_points")
    + f", named AS (SELECT *, {_CATALOG_NAMES.format(t='VARCHAR')} AS dataset_name FROM order_points),"
    f" found AS (SELECT DISTINCT dataset_name FROM named WHERE o_custkey % 40 % 3 > 0), {_MONTHS}"
    " SELECT t.dataset_name, s.time_bucket, COALESCE(n, 0) AS count, total FROM totals t CROSS JOIN series s"
    " LEFT JOIN counts c ON c.dataset_name = t.dataset_name AND c.time_bucket = s.time_bucket",
)
def timeseries_catalog(spark, sf):
    """Forty stored datasets, found through their catalog and counted in one scan; a third of them isn't approved."""
    root = scratch_path(spark, "datasets")
    named = _orders(spark, sf).withColumn("dataset_name", F.expr(_CATALOG_NAMES.format(t="STRING")))
    named.select("hash", "point_date", "lon", "lat", "dataset_name").write.partitionBy("dataset_name").parquet(root)
    extents = named.groupBy("dataset_name", (F.col("o_custkey") % 40 % 3 > 0).alias("approved_status")).agg(
        F.min("point_date").alias("obs_from"), F.max("point_date").alias("obs_to"), F.min("lon").alias("xmin"),
        F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"),
    )
    catalog = extents.withColumn("date_added", F.col("obs_from"))
    return store.catalog_panel(catalog, root, "month", ORDER_START, ORDER_END, RECTANGLE)


@query(
    "timeseries_pivot",
    "WITH long AS (" + panel_sql() + ") SELECT CAST(time_bucket AS DATE) AS temporal_group,"
    " max(CASE WHEN dataset_name = 'events' THEN count END) AS events,"
    " max(CASE WHEN dataset_name = 'orders' THEN count END) AS orders,"
    " max(CASE WHEN dataset_name = 'shipments' THEN count END) AS shipments FROM long GROUP BY 1",
)
def timeseries_pivot(spark, sf):
    return ts.pivot_panel(_panel(spark, sf), ["events", "orders", "shipments"])


def _two_series_sql() -> str:
    parts = (
        series_sql("event_points", "month", PANEL_START, PANEL_END, "event_type = 'click'"),
        series_sql("order_points", "month", PANEL_START, PANEL_END),
    )
    return duck("event_points", "order_points") + " UNION ALL ".join(
        f"SELECT s.count, CAST(s.time_bucket AS DATE) AS datetime FROM ({q}) s" for q in parts
    )


def _two_series(spark, sf):
    datasets = {"events": _events(spark, sf), "orders": _orders(spark, sf)}
    trees = {"events": {"op": "eq", "col": "event_type", "val": "click"}}
    return ts.series_of_several(datasets, "month", PANEL_START, PANEL_END, trees)


@query("detail_aggregate", _two_series_sql())
def detail_aggregate(spark, sf):
    return _two_series(spark, sf)


@query(
    "detail_aggregate_total",
    "WITH s AS (" + _two_series_sql() + ") SELECT count(*) AS total, CAST(sum(count) AS BIGINT) AS count FROM s",
)
def detail_aggregate_total(spark, sf):
    return ts.series_total(_two_series(spark, sf))


# -- grid and extent --------------------------------------------------------------------------

_PER_DEGREE = "(360e0 / 40041000e0)"
_CORNERS = ("xmin", "ymin", "xmax", "ymax")


@query(
    "grid_count",
    duck("ship_points", "order_points")
    + ", whole AS (SELECT (min(lat) + max(lat)) / 2 AS middle FROM order_points),"
    f" sized AS (SELECT lon, lat, 500 * {_PER_DEGREE} * (1e0 / cos(middle * (pi() / 180e0))) AS sx, 500 * {_PER_DEGREE} AS sy"
    " FROM order_points, whole WHERE o_orderstatus <> 'P'),"
    " cells AS (SELECT round_even(lon / sx, 0) * sx AS x, round_even(lat / sy, 0) * sy AS y, sx, sy, count(*) AS count FROM sized GROUP BY ALL)"
    " SELECT count, round(x - sx / 2, 6) AS xmin, round(y - sy / 2, 6) AS ymin, round(x + sx / 2, 6) AS xmax, round(y + sy / 2, 6) AS ymax FROM cells",
)
def grid(spark, sf):
    cells = grid_count(_orders(spark, sf), 500, tree={"op": "ne", "col": "o_orderstatus", "val": "P"})
    return cells.select("count", *[F.round(c, 6).alias(c) for c in _CORNERS])


@query(
    "dataset_extent",
    duck("order_points")
    + "SELECT min(point_date) AS obs_from, max(point_date) AS obs_to, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax,"
    " max(lat) AS ymax, count(*) AS num_rows FROM order_points",
)
def extent(spark, sf):
    return cat.dataset_extent(_orders(spark, sf))


# -- catalog ----------------------------------------------------------------------------------


def _catalog(spark, sf):
    """One dataset per customer: the extent of the customer's orders."""
    extents = (
        _orders(spark, sf)
        .groupBy("o_custkey")
        .agg(
            F.min("point_date").alias("obs_from"), F.max("point_date").alias("obs_to"),
            F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"),
        )
    )
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    return customers.join(extents, customers.c_custkey == extents.o_custkey).select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("dataset_name"),
        F.col("c_name").alias("human_name"),
        F.when(F.col("c_acctbal") >= 0, F.col("obs_to")).alias("date_added"),
        (F.col("c_mktsegment") != "MACHINERY").alias("approved_status"),
        "obs_from", "obs_to", "xmin", "ymin", "xmax", "ymax",
        F.create_map(F.lit("o_orderkey"), F.lit("bigint"), F.lit("segment"), F.col("c_mktsegment")).alias("column_names"),
        F.array(*[(F.col("c_custkey") * 10 + i).cast("string") for i in (0, 3, 7, 9)]).alias("result_ids"),
    )


_CATALOG_SQL = duck("order_points") + (
    ", extents AS (SELECT o_custkey, min(point_date) AS obs_from, max(point_date) AS obs_to, min(lon) AS xmin, min(lat) AS ymin,"
    " max(lon) AS xmax, max(lat) AS ymax FROM order_points GROUP BY 1),"
    " catalog AS (SELECT 'd' || CAST(c_custkey AS VARCHAR) AS dataset_name, c_custkey, c_name AS human_name, c_acctbal >= 0 AS ingested,"
    " c_mktsegment, c_mktsegment <> 'MACHINERY' AS approved_status, obs_from, obs_to, xmin, ymin, xmax, ymax"
    " FROM customer JOIN extents ON c_custkey = o_custkey) "
)


@query(
    "catalog_search",
    _CATALOG_SQL + f"SELECT dataset_name, human_name, obs_from, obs_to, '[o_orderkey:bigint][segment:' || c_mktsegment || ']' AS columns"
    " FROM catalog WHERE ingested AND obs_from < TIMESTAMP '1998-06-01' AND obs_to > TIMESTAMP '1998-01-01'"
    f" AND xmin <= {lit(-87.88)} AND xmax >= {lit(-87.9)} AND ymin <= {lit(41.9)} AND ymax >= {lit(41.6)}",
)
def catalog_search(spark, sf):
    west = {"type": "Polygon", "coordinates": [[[-87.9, 41.6], [-87.88, 41.6], [-87.88, 41.9], [-87.9, 41.9], [-87.9, 41.6]]]}
    found = cat.public_view(cat.catalog_search(_catalog(spark, sf), start="1998-01-01", end="1998-06-01", geom=west))
    fields = F.transform("columns", lambda c: F.concat(F.lit("["), c["field_name"], F.lit(":"), c["field_type"], F.lit("]")))
    return found.select("dataset_name", "human_name", "obs_from", "obs_to", F.array_join(fields, "").alias("columns"))


@query("approved_names", _CATALOG_SQL + "SELECT dataset_name FROM catalog WHERE approved_status")
def approved_names(spark, sf):
    return cat.approved_names(_catalog(spark, sf))


@query(
    "latest_status",
    _CATALOG_SQL
    + ", ids AS (SELECT c_custkey, unnest([0, 3, 7, 9]) AS i FROM customer),"
    " ranked AS (SELECT 'd' || CAST(c_custkey AS VARCHAR) AS dataset_name, CAST(o_orderkey AS VARCHAR) AS task_id, o_orderstatus AS status,"
    " o_orderdate AS date_done, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) AS r"
    " FROM ids JOIN orders ON o_orderkey = c_custkey * 10 + i)"
    " SELECT c.dataset_name, human_name, task_id, status, date_done FROM catalog c LEFT JOIN ranked r ON c.dataset_name = r.dataset_name AND r.r = 1",
)
def latest_status(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    tasks = orders.select(
        F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderdate").alias("date_done"), F.col("o_orderstatus").alias("status")
    )
    status = cat.latest_status(_catalog(spark, sf), tasks)
    return status.select("dataset_name", "human_name", "task_id", "status", "date_done")


@query(
    "attach_metadata",
    _CATALOG_SQL
    + "SELECT o.o_orderkey, 'd' || CAST(o.o_custkey AS VARCHAR) AS dataset_name, human_name, obs_from, obs_to FROM orders o"
    " LEFT JOIN catalog c ON 'd' || CAST(o.o_custkey AS VARCHAR) = c.dataset_name",
)
def attach_metadata(spark, sf):
    rows = _orders(spark, sf).select("o_orderkey", F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("dataset_name"))
    known = _catalog(spark, sf).select("dataset_name", "human_name", "obs_from", "obs_to")
    return cat.attach_metadata(rows, known)


# -- text and exports -------------------------------------------------------------------------


@query(
    "point_from_location",
    duck("located_text")
    + "SELECT o_orderkey, TRY_CAST(regexp_extract(location, '41[.][0-9]+') AS DOUBLE) AS lat,"
    " TRY_CAST(regexp_extract(location, '-87[.][0-9]+') AS DOUBLE) AS lon FROM located_text",
)
def point_from_location(spark, sf):
    rows = derive(spark, sf, "located_text")
    return rows.select("o_orderkey", location_lat(F.col("location")).alias("lat"), location_lon(F.col("location")).alias("lon"))


_EXPORTED = "event_id, user_id, event_type, value, props, point_date"


@query("export_points_csv", duck("event_points") + f"SELECT {_EXPORTED} FROM event_points")
def export_points_csv(spark, sf):
    path = scratch_path(spark, "points-csv")
    exports.export_points_csv(_events(spark, sf), path)
    types = "event_id long, user_id long, event_type string, value double, props string, point_date timestamp_ntz"
    return spark.read.csv(path, header=True, schema=types, mode="FAILFAST", quote='"', escape='"')


@query(
    "export_points_geojson",
    duck("event_points") + "SELECT 'Feature' AS kind, lon AS x, lat AS y, event_id, user_id, value FROM event_points WHERE lon IS NOT NULL",
)
def export_points_geojson(spark, sf):
    path = scratch_path(spark, "points-geojson")
    exports.export_points_geojson(_events(spark, sf), path)
    return _read_features(spark.read.text(path), "event_id long, user_id long, value double")


@query(
    "scan_points",
    duck("order_points")
    + "SELECT o_orderkey AS order_key, o_custkey AS customer_no, o_orderstatus AS status, o_totalprice AS total_price, point_date AS a_date,"
    " lon AS longitude, lat AS latitude FROM order_points",
)
def scan_points(spark, sf):
    """A CSV with an untidy header, scanned with inferred types."""
    header = {
        "Order-Key": "o_orderkey", "Customer No.": "o_custkey", "STATUS": "o_orderstatus", "Total  Price": "o_totalprice",
        "a date": "point_date", "Longitude": "lon", "Latitude": "lat",
    }
    path = scratch_path(spark, "raw-points")
    _orders(spark, sf).select(*[F.col(c).alias(h) for h, c in header.items()]).write.csv(path, header=True, quote='"', escape='"')
    scanned = read_points(spark, path)
    # Integers get the narrowest type that holds them all.
    return scanned.withColumns({c: F.col(c).cast("long") for c in ("order_key", "customer_no")}).withColumn(
        "a_date", F.col("a_date").cast("timestamp_ntz")
    )
