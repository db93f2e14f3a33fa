"""Sensor networks as relations: what is mounted where and reports what.

nodes      (node, network, lon, lat, address, info)
bridge     (network, node, sensor)
sensors    (sensor, observed_properties map<alias, "feature.property">, info)
features   (feature, observed_properties array<struct<name, type>>)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.functions.geometry import point_geojson, point_in
from placetime.plans.sizing import settled


def _mountings(bridge: DataFrame) -> DataFrame:
    return bridge.select("network", "node", "sensor").distinct()


def network_tree(bridge: DataFrame, sensors: DataFrame) -> DataFrame:
    """(network, node, sensor, observed_properties): the network's tree as rows, each mounting once.

    The innermost level, {alias: feature.property}, is the sensor's own map.
    """
    known = sensors.select("sensor", "observed_properties")
    return _mountings(bridge).join(settled(known, "known"), "sensor").select("network", "node", "sensor", "observed_properties")


def nested_tree(bridge: DataFrame, sensors: DataFrame) -> DataFrame:
    """(network, node, tree): sensor -> {alias: feature.property} in one map per node.

    A presentation of `network_tree`: a node's map holds each kind of sensor mounted on it once.
    """
    by_name = F.array_sort(F.collect_list(F.struct("sensor", F.map_entries("observed_properties").alias("p"))))
    as_map = F.map_from_entries(F.transform(by_name, lambda e: F.struct(e["sensor"], F.map_from_entries(e["p"]))))
    return network_tree(bridge, sensors).groupBy("network", "node").agg(as_map.alias("tree"))


def reported(links: DataFrame, sensors: DataFrame) -> DataFrame:
    """Links with (alias, feature, property) of everything their sensor reports.

    The map is opened on the sensor table, which is small, before the join multiplies it.
    """
    return links.join(settled(sensor_properties(sensors), "sensor-properties"), "sensor")


def sensor_properties(sensors: DataFrame) -> DataFrame:
    opened = sensors.select("sensor", F.explode("observed_properties").alias("alias", "target"))
    return opened.select(
        "sensor",
        "alias",
        F.split_part("target", F.lit("."), F.lit(1)).alias("feature"),
        F.split_part("target", F.lit("."), F.lit(2)).alias("property"),
    )


def node_properties(
    bridge: DataFrame,
    sensors: DataFrame,
    node: str | None = None,
    only_sensors: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    properties: Sequence[str] | None = None,
) -> DataFrame:
    """(network, node, feature, property) a node can report under the given filters."""
    links = bridge.select("network", "node", "sensor")
    if node is not None:
        links = links.filter(F.col("node") == node)
    if only_sensors:
        links = links.filter(F.col("sensor").isin(*only_sensors))
    joined = reported(links, sensors)
    if features:
        joined = joined.filter(F.col("feature").isin(*features))
    if properties:
        joined = joined.filter(F.col("property").isin(*properties))
    return joined.select("network", "node", "feature", F.lower("property").alias("property")).distinct()


def network_metadata(networks: DataFrame, bridge: DataFrame, sensors: DataFrame) -> DataFrame:
    """(network, info, kind, name): the distinct features, nodes and sensors of every network.

    Members come as rows, since a network may have any number of nodes; a network without
    members keeps one row without a name.
    """
    links = bridge.select("network", "node", "sensor")
    of_nodes = links.select("network", F.col("node").alias("name"), F.lit("node").alias("kind"))
    of_sensors = links.select("network", F.col("sensor").alias("name"), F.lit("sensor").alias("kind"))
    in_use = reported(links.select("network", "sensor").distinct(), sensors)
    of_features = in_use.select("network", F.col("feature").alias("name"), F.lit("feature").alias("kind"))
    members = of_nodes.unionByName(of_sensors).unionByName(of_features).distinct()
    known = networks.select("network", "info")
    named = members.join(settled(known, "known"), "network").select("network", "info", "kind", "name")
    # Members never move by network, of which there are few; networks without members come on top.
    empty = known.join(links.select("network").distinct(), "network", "left_anti")
    none = F.lit(None).cast("string")
    return named.unionByName(empty.select("network", "info", none.alias("kind"), none.alias("name")))


def node_metadata(nodes: DataFrame, bridge: DataFrame) -> DataFrame:
    """Nodes as GeoJSON-like rows with the list of their sensors, each kind once."""
    mountings = bridge.groupBy("network", "node").agg(F.sort_array(F.collect_set("sensor")).alias("sensors"))
    return nodes.join(mountings, ["network", "node"], "left").select(
        F.lit("Feature").alias("type"),
        point_geojson(F.col("lon"), F.col("lat")).alias("geometry"),
        F.struct(
            F.col("node").alias("id"), "network", F.coalesce("sensors", F.array().cast("array<string>")).alias("sensors"), "info", "address"
        ).alias("properties"),
    )


def sensor_metadata(sensors: DataFrame) -> DataFrame:
    return sensors.select(F.col("sensor").alias("name"), F.sort_array(F.map_values("observed_properties")).alias("properties"), "info")


def feature_metadata(features: DataFrame) -> DataFrame:
    return features.select(F.col("feature").alias("name"), F.col("observed_properties").alias("properties"))


def feature_sensors(bridge: DataFrame, sensors: DataFrame) -> DataFrame:
    """(network, feature, sensor): which sensors in use report a feature.

    Both sides of the join are distinct, so its rows are; they are more than either side's and are not gathered again.
    """
    features = sensor_properties(sensors).select("sensor", F.lower("feature").alias("feature")).distinct()
    in_use = bridge.select("network", "sensor").distinct()
    return in_use.join(settled(features, "sensor-features"), "sensor").select("network", "feature", "sensor")


def feature_properties(features: DataFrame) -> DataFrame:
    """(feature, property, type, full_name)."""
    opened = features.select("feature", F.explode("observed_properties").alias("p"))
    return opened.select(
        "feature",
        F.col("p.name").alias("property"),
        F.col("p.type").alias("type"),
        F.concat_ws(".", "feature", "p.name").alias("full_name"),
    )


def nodes_within(nodes: DataFrame, geom, network: str | None = None) -> DataFrame:
    """Nodes inside a geometry."""
    if network is not None:
        nodes = nodes.filter(F.col("network") == network)
    return nodes.filter(point_in(F.col("lon"), F.col("lat"), geom))


def sensors_within(nodes: DataFrame, bridge: DataFrame, sensors: DataFrame, geom, network: str | None = None) -> DataFrame:
    """(network, sensor, feature) reachable from the nodes inside a geometry."""
    inside = nodes_within(nodes, geom, network).select("network", "node")
    links = bridge.join(inside, ["network", "node"], "left_semi").select("network", "sensor").distinct()
    return reported(links, sensors).select("network", "sensor", "feature").distinct()


def validate_sensors(sensors: DataFrame, features: DataFrame) -> DataFrame:
    """(sensor, alias, target, problem) for every mapping that names nothing known."""
    opened = sensors.select("sensor", F.explode_outer("observed_properties").alias("alias", "target"))
    checked = opened.withColumn("pieces", F.size(F.split("target", r"\."))).withColumns(
        {
            "feature": F.split_part("target", F.lit("."), F.lit(1)),
            "property": F.split_part("target", F.lit("."), F.lit(2)),
        }
    )
    names = features.select("feature", F.lit(True).alias("known_feature")).distinct()
    properties = feature_properties(features).select("feature", "property", F.lit(True).alias("known_property")).distinct()
    problem = (
        F.when(F.col("target").isNull(), "no observed properties")
        .when(F.col("pieces") != 2, "feature without property")
        .when(F.col("known_feature").isNull(), "unknown feature")
        .when(F.col("known_property").isNull(), "unknown property")
    )
    return (
        checked.join(names, "feature", "left")
        .join(properties, ["feature", "property"], "left")
        .select("sensor", "alias", "target", problem.alias("problem"))
        .filter(F.col("problem").isNotNull())
    )
