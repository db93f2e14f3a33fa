"""Queries on sensor networks and their observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from placetime.operators import nearest
from placetime.operators import network as net
from placetime.operators import observations as ob
from placetime.operators import paging
from placetime.plans.derived import derive, duck, lat, lon, text
from placetime.plans.point_queries import RECTANGLE, lit
from placetime.plans.registry import query
from placetime.session import scratch_path
from placetime.sources import exports
from placetime.sources import observations as store

SHIP_START, SHIP_END = "1996-02-10 12:00:00", "2000-11-03 08:30:00"
EVENT_START, EVENT_END = "2024-01-03 10:15:00", "2024-01-27 05:40:00"


def _ship(spark, sf):
    return derive(spark, sf, "ship_obs")


def _events(spark, sf):
    return derive(spark, sf, "event_obs")


# -- raw observations -------------------------------------------------------------------------


@query(
    "obs_query",
    duck("event_obs")
    + "SELECT * FROM event_obs WHERE datetime >= TIMESTAMP '2024-01-03 10:15:00' AND datetime < TIMESTAMP '2024-01-27 05:40:00'"
    " AND lower(sensor) IN ('click', 'error') AND value IS NOT NULL AND level > 10 ORDER BY datetime DESC LIMIT 1000 OFFSET 5",
)
def obs_query(spark, sf):
    tree = {"op": "gt", "col": "level", "val": 10}
    return ob.observations(
        _events(spark, sf), 1000, 5, start=EVENT_START, end=EVENT_END, sensors=["Click", "ERROR"], prop="value", tree=tree
    )


@query(
    "obs_store",
    duck("event_obs")
    + "SELECT * FROM event_obs WHERE datetime >= TIMESTAMP '2024-01-03 10:15:00' AND datetime < TIMESTAMP '2024-01-27 05:40:00'"
    " AND node_id IN ('n3', 'n4', 'n15')",
)
def obs_store(spark, sf):
    """Observations written by day in two parts, the second one twice, and some of them read back."""
    path = scratch_path(spark, "observations")
    events = _events(spark, sf)
    early = F.col("datetime") < F.lit("2024-01-12").cast("timestamp_ntz")
    store.write_observations(events.filter(early), path)
    for _ in range(2):
        store.write_observations(events.filter(~early), path, "overwrite")
    return store.read_observations(spark, path, EVENT_START, EVENT_END, ["N3", "n4", "n15"], events.schema)


_DEEP = "SELECT * FROM event_obs ORDER BY datetime DESC, meta_id LIMIT {limit} OFFSET {offset}"


@query("obs_page_deep", duck("event_obs") + _DEEP.format(limit="(SELECT count(*) // 3 FROM events)", offset="(SELECT count(*) // 2 FROM events)"))
def obs_page_deep(spark, sf):
    """A third of all rows from the middle on, cut from ranges."""
    events = _events(spark, sf)
    n = events.count()
    return paging.cut(events, paging.newest_order("datetime", ["meta_id"]), n // 2, n // 3)


@query(
    "obs_page_after",
    duck("event_obs") + ", numbered AS (SELECT *, row_number() OVER (ORDER BY datetime DESC, meta_id) AS place FROM event_obs)"
    " SELECT * EXCLUDE (place) FROM numbered WHERE place > 1000 AND place <= 2000",
)
def obs_page_after(spark, sf):
    """The second page of 1000, found from the first one's last row."""
    events = _events(spark, sf)
    first = paging.newest(events, "datetime", ["meta_id"], 1000).select("datetime", "meta_id")
    last = first.agg(F.max_by(F.struct("datetime", "meta_id"), F.struct(-F.unix_micros(F.col("datetime").cast("timestamp")), "meta_id")).alias("last")).first()["last"]
    return paging.newest_after(events, "datetime", ["meta_id"], last.asDict(), 1000)


@query(
    "obs_query_results",
    duck("event_obs")
    + "SELECT node_id AS node, meta_id, datetime, sensor, 'event' AS feature, value AS result_value, level AS result_level FROM event_obs",
)
def obs_query_results(spark, sf):
    rows = ob.with_results(_events(spark, sf), "event")
    return rows.select(
        "node", "meta_id", "datetime", "sensor", "feature", F.col("results.value").alias("result_value"), F.col("results.level").alias("result_level")
    )


@query(
    "obs_merge",
    duck("event_obs", "ship_obs")
    + "SELECT 'event' AS feature, node_id, datetime, sensor, value, NULL::DOUBLE AS quantity FROM event_obs"
    " UNION ALL SELECT 'ship', node_id, datetime, sensor, NULL, quantity FROM ship_obs",
)
def obs_merge(spark, sf):
    """Two features together, unlimited."""
    whole = ob.merge_features({"event": _events(spark, sf), "ship": _ship(spark, sf)}, limit=None)
    return whole.select("feature", "node_id", "datetime", "sensor", "value", "quantity")


@query(
    "threshold_trigger",
    duck("event_obs", "ship_obs")
    + "SELECT node_id, datetime, 'event.value' AS property, value FROM event_obs WHERE value >= 150"
    " AND datetime >= TIMESTAMP '2024-01-03 10:15:00' AND datetime < TIMESTAMP '2024-01-27 05:40:00'"
    " ORDER BY datetime DESC, node_id, property, value LIMIT 50",
)
def threshold_trigger(spark, sf):
    return ob.threshold_trigger({"event": _events(spark, sf)}, "value", "ge", "150", EVENT_START, EVENT_END)


@query(
    "threshold_trigger_two",
    duck("event_obs", "ship_obs")
    + "SELECT node_id, datetime, 'event.value' AS property, value FROM event_obs WHERE value >= 150"
    f" UNION ALL SELECT node_id, datetime, 'ship.value', price FROM ship_obs WHERE price >= 150"
    " ORDER BY datetime DESC, node_id, property, value LIMIT 50",
)
def threshold_trigger_two(spark, sf):
    """Two features' readings in one list, the newest 50."""
    ships = _ship(spark, sf).withColumnRenamed("price", "value").drop("quantity", "mark")
    return ob.threshold_trigger({"event": _events(spark, sf).drop("level"), "ship": ships}, "value", "ge", "150")


@query(
    "obs_merge_newest",
    duck("event_obs", "ship_obs")
    + "SELECT 'event' AS feature, node_id, datetime, sensor, meta_id, value, NULL::DOUBLE AS quantity FROM event_obs"
    " UNION ALL SELECT 'ship', node_id, datetime + INTERVAL '336' MONTH, sensor, meta_id, NULL, quantity FROM ship_obs"
    " ORDER BY datetime DESC, feature, node_id, sensor, meta_id LIMIT 1000",
)
def obs_merge_newest(spark, sf):
    """The newest 1000 of two features together."""
    ships = _ship(spark, sf).withColumn("datetime", F.expr("datetime + INTERVAL '336' MONTH"))
    whole = ob.merge_features({"event": _events(spark, sf), "ship": ships}, 1000, tie=("feature", "node_id", "sensor", "meta_id"))
    return whole.select("feature", "node_id", "datetime", "sensor", "meta_id", "value", "quantity")


# -- aggregates ---------------------------------------------------------------------------------

_FUNCTIONS = {
    "avg": "round(avg({c}), {d})",
    "std": "round(stddev_samp({c}), {d})",
    "var": "round(var_samp({c}), {d})",
    "max": "max({c})",
    "min": "min({c})",
    "med": "median({c})",
}
# Digits that survive summing in any order.
_DIGITS = {"avg": {"quantity": 6, "price": 6}, "std": {"quantity": 6, "price": 4}, "var": {"quantity": 6, "price": -2}}


def _aggregate_sql(fn: str, unit: str, start: str | None = None, end: str | None = None) -> str:
    digits = _DIGITS.get(fn, {})
    columns = ", ".join(
        f"{_FUNCTIONS[fn].format(c=c, d=digits.get(c))} AS {c}, count({c}) AS {c}_count" for c in ("quantity", "price")
    )
    where = f"WHERE datetime >= TIMESTAMP '{start}' AND datetime < TIMESTAMP '{end}'" if start else ""
    return (
        f"SELECT node_id, CAST(date_trunc('{unit}', datetime) AS TIMESTAMP) AS time_bucket, {columns} FROM ship_obs {where} GROUP BY 1, 2"
    )


def _rounded(df, fn: str):
    return df.withColumns({c: F.round(c, d) for c, d in _DIGITS.get(fn, {}).items()})


def _aggregate_query(fn: str) -> None:
    unit = {"avg": "month", "std": "month", "var": "month", "max": "week", "min": "day", "med": "month"}[fn]

    @query(f"node_agg_{fn}", duck("ship_obs") + _aggregate_sql(fn, unit, SHIP_START, SHIP_END))
    def run(spark, sf):
        return _rounded(ob.node_aggregate(_ship(spark, sf), unit, fn, SHIP_START, SHIP_END), fn)


for _fn in _FUNCTIONS:
    _aggregate_query(_fn)


@query("node_agg_med_split", duck("ship_obs") + _aggregate_sql("med", "year"))
def node_agg_med_split(spark, sf):
    """Medians with a low limit, so that the way of crowded groups is taken."""
    return ob.node_aggregate(_ship(spark, sf), "year", "med", hot_rows=75)


@query(
    "node_agg_hourly",
    duck("event_obs")
    + "SELECT node_id, CAST(date_trunc('hour', datetime) AS TIMESTAMP) AS time_bucket, round(avg(value), 6) AS value, count(value) AS value_count"
    " FROM event_obs WHERE lower(sensor) IN ('view', 'click') GROUP BY 1, 2",
)
def node_agg_hourly(spark, sf):
    df = ob.node_aggregate(_events(spark, sf), "hour", "avg", sensors=["view", "click"], properties=["value"])
    return df.withColumn("value", F.round("value", 6))


def _filled_sql(unit: str, start: str, end: str) -> str:
    return (
        duck("ship_obs")
        + f", found AS ({_aggregate_sql('max', unit, start, end)}),"
        f" series AS (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{start}'), TIMESTAMP '{end}', INTERVAL 1 {unit.upper()})) AS time_bucket),"
        f" dense AS (SELECT node_id, time_bucket FROM (SELECT DISTINCT node_id FROM found), series WHERE time_bucket < TIMESTAMP '{end}')"
        " SELECT node_id, time_bucket, quantity, COALESCE(quantity_count, 0) AS quantity_count, price, COALESCE(price_count, 0) AS price_count"
        " FROM dense LEFT JOIN found USING (node_id, time_bucket)"
    )


@query("node_agg_filled", _filled_sql("week", SHIP_START, SHIP_END))
def node_agg_filled(spark, sf):
    found = ob.node_aggregate(_ship(spark, sf), "week", "max", SHIP_START, SHIP_END)
    return ob.fill_gaps(found, "week", SHIP_START, SHIP_END)


# -- topology -----------------------------------------------------------------------------------


def _bridge(spark, sf):
    nodes = derive(spark, sf, "nodes").select("network", "node")
    return derive(spark, sf, "mountings").join(nodes, "node").select("network", "node", "sensor")


def _sensors(spark, sf):
    return derive(spark, sf, "sensors")


_TOPOLOGY = (
    duck("nodes", "mountings", "sensors", "features", "networks")
    + ", bridge AS (SELECT DISTINCT network, node, sensor FROM mountings JOIN nodes USING (node)),"
    " opened AS (SELECT sensor, unnest(map_entries(observed_properties)) AS e FROM sensors),"
    " props AS (SELECT sensor, e.key AS alias, split_part(e.value, '.', 1) AS feature, split_part(e.value, '.', 2) AS property,"
    " e.value AS target FROM opened) "
)


@query(
    "network_tree",
    _TOPOLOGY + "SELECT network, node, sensor, alias, target FROM bridge JOIN props USING (sensor)",
)
def network_tree(spark, sf):
    rows = net.network_tree(_bridge(spark, sf), _sensors(spark, sf))
    return rows.select("network", "node", "sensor", F.explode("observed_properties").alias("alias", "target"))


@query(
    "network_tree_nested",
    _TOPOLOGY
    + "SELECT network, node, string_agg(sensor || ':' || observed_properties['a'] || ',' || observed_properties['b'], ';' ORDER BY sensor) AS tree"
    " FROM bridge JOIN sensors USING (sensor) GROUP BY 1, 2",
)
def network_tree_nested(spark, sf):
    tree = net.nested_tree(_bridge(spark, sf), _sensors(spark, sf))
    entry = F.transform(
        F.map_entries("tree"),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"]["a"], F.lit(","), e["value"]["b"]),
    )
    return tree.select("network", "node", F.array_join(entry, ";").alias("tree"))


@query("node_properties", _TOPOLOGY + "SELECT DISTINCT network, node, feature, lower(property) AS property FROM bridge JOIN props USING (sensor)")
def node_properties(spark, sf):
    return net.node_properties(_bridge(spark, sf), _sensors(spark, sf))


@query(
    "network_metadata",
    _TOPOLOGY
    + ", members AS (SELECT DISTINCT network, 'node' AS kind, node AS name FROM bridge UNION SELECT DISTINCT network, 'sensor', sensor FROM bridge"
    " UNION SELECT DISTINCT network, 'feature', feature FROM bridge JOIN props USING (sensor))"
    " SELECT n.network, n.info, kind, name FROM networks n LEFT JOIN members m ON n.network = m.network",
)
def network_metadata(spark, sf):
    return net.network_metadata(derive(spark, sf, "networks"), _bridge(spark, sf), _sensors(spark, sf))


@query(
    "node_metadata",
    _TOPOLOGY
    + "SELECT 'Feature' AS type, lon AS x, lat AS y, node AS id, network, info, address, string_agg(sensor, ',' ORDER BY sensor) AS sensors"
    " FROM nodes LEFT JOIN bridge USING (network, node) GROUP BY ALL",
)
def node_metadata(spark, sf):
    rows = net.node_metadata(derive(spark, sf, "nodes"), _bridge(spark, sf))
    coordinates, p = F.col("geometry.coordinates"), "properties"
    return rows.select(
        "type", coordinates[0].alias("x"), coordinates[1].alias("y"), f"{p}.id", f"{p}.network", f"{p}.info", f"{p}.address",
        F.array_join(f"{p}.sensors", ",").alias("sensors"),
    )


@query(
    "sensor_metadata",
    duck("sensors") + "SELECT sensor AS name, least(observed_properties['a'], observed_properties['b']) || ' ' ||"
    " greatest(observed_properties['a'], observed_properties['b']) AS properties, info FROM sensors",
)
def sensor_metadata(spark, sf):
    return net.sensor_metadata(_sensors(spark, sf)).withColumn("properties", F.array_join("properties", " "))


@query(
    "feature_metadata",
    duck("features") + "SELECT feature AS name, unnest(observed_properties).name AS property, unnest(observed_properties).type AS type FROM features",
)
def feature_metadata(spark, sf):
    rows = net.feature_metadata(derive(spark, sf, "features")).select("name", F.explode("properties").alias("p"))
    return rows.select("name", F.col("p.name").alias("property"), F.col("p.type").alias("type"))


@query("feature_sensors", _TOPOLOGY + "SELECT DISTINCT network, feature, sensor FROM bridge JOIN props USING (sensor)")
def feature_sensors(spark, sf):
    return net.feature_sensors(_bridge(spark, sf), _sensors(spark, sf))


@query(
    "feature_properties",
    duck("features")
    + "SELECT feature, p.name AS property, p.type AS type, feature || '.' || p.name AS full_name"
    " FROM (SELECT feature, unnest(observed_properties) AS p FROM features)",
)
def feature_properties(spark, sf):
    return net.feature_properties(derive(spark, sf, "features"))


_INSIDE = f"lon > {lit(-87.8)} AND lon < {lit(-87.6)} AND lat > {lit(41.7)} AND lat < {lit(41.9)}"


@query("nodes_within", duck("nodes") + f"SELECT network, node, lon, lat FROM nodes WHERE {_INSIDE}")
def nodes_within(spark, sf):
    return net.nodes_within(derive(spark, sf, "nodes"), RECTANGLE).select("network", "node", "lon", "lat")


@query(
    "sensors_within",
    _TOPOLOGY
    + f"SELECT DISTINCT network, sensor, feature FROM bridge JOIN props USING (sensor) WHERE node IN (SELECT node FROM nodes WHERE {_INSIDE})",
)
def sensors_within(spark, sf):
    return net.sensors_within(derive(spark, sf, "nodes"), _bridge(spark, sf), _sensors(spark, sf), RECTANGLE)


@query(
    "validate_sensors",
    _TOPOLOGY
    + ", checked AS (SELECT sensor, alias, target, CASE WHEN target NOT LIKE '%.%' THEN 'feature without property'"
    " WHEN feature NOT IN (SELECT feature FROM features) THEN 'unknown feature'"
    " WHEN property NOT IN ('mean', 'peak') THEN 'unknown property' END AS problem FROM props)"
    " SELECT * FROM checked WHERE problem IS NOT NULL",
)
def validate_sensors(spark, sf):
    return net.validate_sensors(_sensors(spark, sf), derive(spark, sf, "features"))


# -- nearest ------------------------------------------------------------------------------------

_QUERY_LON, _QUERY_LAT = lon("c_custkey * 3 + 1", "5e-1"), lat("c_custkey * 5 + 2", "5e-1")
_QUERIES_SQL = f"queries AS (SELECT c_custkey AS query_id, {_QUERY_LON} AS lon, {_QUERY_LAT} AS lat FROM customer)"


def _queries(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS query_id", f"{_QUERY_LON} AS lon", f"{_QUERY_LAT} AS lat"
    )


@query(
    "knn_nodes",
    _TOPOLOGY
    + f", {_QUERIES_SQL}, able AS (SELECT DISTINCT node FROM bridge JOIN props USING (sensor) WHERE feature IN ('f3', 'f7', 'f41')),"
    " pairs AS (SELECT query_id, network, node, sqrt((q.lon - n.lon) * (q.lon - n.lon) + (q.lat - n.lat) * (q.lat - n.lat)) AS distance"
    " FROM queries q, nodes n WHERE node IN (SELECT node FROM able)),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, network, node) AS place,"
    " rank() OVER (PARTITION BY query_id ORDER BY distance) AS rank FROM pairs)"
    " SELECT query_id, network, node, distance, rank FROM ranked WHERE place <= 10",
)
def knn_nodes(spark, sf):
    able = nearest.reporting_nodes(derive(spark, sf, "nodes"), _bridge(spark, sf), _sensors(spark, sf), ["f3", "f7", "f41"])
    return nearest.knn_nodes(_queries(spark, sf), able).withColumn("rank", F.col("rank").cast("long"))


_INSTANT = "TIMESTAMP '{base}' + INTERVAL '1' MINUTE * (c_custkey * 7919 % 43200)"
_SPARK_INSTANT = _INSTANT.replace("TIMESTAMP", "TIMESTAMP_NTZ").format(base="2024-01-01 00:00:00")
_IN_TIME_SQL = (
    "pairs AS (SELECT q.query_id, q.node_id, o.datetime, o.sensor, o.value, abs(epoch_us(o.datetime) - epoch_us(q.instant)) AS gap,"
    " o.datetime <= q.instant AS before, o.meta_id FROM asked q JOIN event_obs o ON o.node_id = q.node_id"
    " AND o.datetime >= q.instant - INTERVAL 12 HOUR AND o.datetime <= q.instant + INTERVAL 12 HOUR),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY gap, datetime,"
    " CASE WHEN before THEN meta_id END DESC NULLS LAST, CASE WHEN NOT before THEN meta_id END ASC NULLS LAST) AS place FROM pairs)"
)


def _asked(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey AS query_id", "'n' || CAST(c_custkey % 20 AS STRING) AS node_id", f"{_SPARK_INSTANT} AS instant"
    )


_ASKED_SQL = (
    duck("event_obs")
    + f", asked AS (SELECT c_custkey AS query_id, 'n' || {text('c_custkey % 20')} AS node_id,"
    f" {_INSTANT.format(base='2024-01-01 00:00:00')} AS instant FROM customer), {_IN_TIME_SQL}"
    " SELECT query_id, node_id, datetime, sensor, value, gap, place FROM ranked WHERE place <= 3"
)


def _in_time(spark, sf, **options):
    found = nearest.nearest_in_time(_asked(spark, sf), _events(spark, sf), tie=["meta_id"], **options)
    return found.select("query_id", "node_id", "datetime", "sensor", "value", "gap", F.col("place").cast("long").alias("place"))


@query("nearest_in_time", _ASKED_SQL)
def nearest_in_time(spark, sf):
    return _in_time(spark, sf)


@query("nearest_in_time_split", _ASKED_SQL)
def nearest_in_time_split(spark, sf):
    """The same with slots cut into pieces, as crowded ones are."""
    return _in_time(spark, sf, hot_rows=3)


@query(
    "nearest_observation",
    duck("event_obs")
    + f", near AS (SELECT c_custkey AS query_id, 'n' || {text('s_suppkey')} AS node_id, {_INSTANT.format(base='2024-01-01 00:00:00')} AS instant,"
    f" sqrt(({_QUERY_LON} - ({lon('s_suppkey')})) * ({_QUERY_LON} - ({lon('s_suppkey')}))"
    f" + ({_QUERY_LAT} - ({lat('s_suppkey')})) * ({_QUERY_LAT} - ({lat('s_suppkey')}))) AS distance FROM customer, supplier),"
    " asked AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) <= 10),"
    f" {_IN_TIME_SQL}, best AS (SELECT query_id, arg_min(node_id, distance) AS node_id FROM asked SEMI JOIN ranked USING (query_id, node_id) GROUP BY 1)"
    " SELECT query_id, node_id, datetime, sensor, value, gap, place FROM ranked SEMI JOIN best USING (query_id, node_id) WHERE place <= 3",
)
def nearest_observation(spark, sf):
    asked = _queries(spark, sf).join(_asked(spark, sf).select("query_id", "instant"), "query_id")
    found = nearest.nearest_observations(asked, derive(spark, sf, "nodes"), _events(spark, sf), tie=["meta_id"])
    return found.select("query_id", "node_id", "datetime", "sensor", "value", "gap", F.col("place").cast("long").alias("place"))


# -- exports ------------------------------------------------------------------------------------


@query(
    "obs_download",
    duck("event_obs", "ship_obs")
    + "SELECT 'event' AS feature, node_id, datetime, value AS reading FROM event_obs UNION ALL SELECT 'ship', node_id, datetime, price FROM ship_obs",
)
def obs_download(spark, sf):
    path = scratch_path(spark, "obs-json")
    exports.export_observations({"event": _events(spark, sf), "ship": _ship(spark, sf)}, path, "json")
    layout = "feature string, node_id string, datetime timestamp_ntz, value double, price double"
    return spark.read.schema(layout).json(path).select("feature", "node_id", "datetime", F.coalesce("value", "price").alias("reading"))


@query(
    "obs_download_csv",
    duck("event_obs") + "SELECT 'event' AS feature, node_id, datetime, meta_id, sensor, value, level FROM event_obs",
)
def obs_download_csv(spark, sf):
    path = scratch_path(spark, "obs-csv")
    exports.export_observations({"event": _events(spark, sf)}, path)
    layout = "node_id string, datetime timestamp_ntz, meta_id double, sensor string, value double, level double, feature string"
    return spark.read.csv(path, header=True, schema=layout, quote='"', escape='"')


@query(
    "archive_month",
    duck("event_obs")
    + "SELECT 'event' AS feature, '2024-01' AS month, node_id, node_id AS node, datetime, value FROM event_obs"
    " WHERE datetime >= TIMESTAMP '2024-01-01' AND datetime < TIMESTAMP '2024-02-01'",
)
def archive_month(spark, sf):
    path = scratch_path(spark, "archive")
    exports.archive_month({"event": _events(spark, sf)}, "2024-01-17 10:00:00", path)
    layout = (
        "node_id string, datetime timestamp_ntz, meta_id double, sensor string, value double, level double,"
        " feature string, month string, node string"
    )
    rows = spark.read.csv(path, header=True, schema=layout, quote='"', escape='"')
    return rows.select("feature", "month", "node_id", "node", "datetime", "value")
