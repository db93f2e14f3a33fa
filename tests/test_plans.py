"""What the physical plans must look like at any scale."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from placetime.operators import points, spatial, timeseries
from placetime.operators.ingest import PointRoles, ingest_points
from placetime.sources.shapes import parse_features

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = spark.range(1000).select(
        "id", (F.col("id") % 7).alias("kind"), (F.col("id") / 1000).alias("x"), (F.col("id") / 500).alias("y"),
        F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00' + INTERVAL '1' HOUR * id").alias("when"),
    )
    path = str(tmp_path_factory.mktemp("points") / "set")
    return ingest_points(rows, PointRoles(date="when", lat="y", lon="x"), path)


@pytest.fixture(scope="module")
def polygons(spark):
    ring = "[[0.1,0.1],[0.5,0.2],[0.6,1.1],[0.3,0.5],[0.2,1.2],[0.1,0.1]]"
    text = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[' + ring + ']},"properties":{"id":1}}'
    return parse_features(spark.createDataFrame([(text,)], "value string"), "id:int")


def test_filters_and_columns_reach_the_scan(spark, stored):
    area = {"type": "Polygon", "coordinates": [[[0.1, 0.1], [0.5, 0.2], [0.6, 1.1], [0.3, 0.5], [0.2, 1.2], [0.1, 0.1]]]}
    tree = {"op": "eq", "col": "kind", "val": "3"}
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = points.select_points(stored, "2020-01-02", "2020-02-01", area, tree).select("id")
    text = plan(found)
    pushed = text[text.index("PushedFilters") :]
    for wanted in ("LessThanOrEqual(lon,0.6)", "GreaterThanOrEqual(lat,0.1)", "EqualTo(kind,3)", "GreaterThanOrEqual(point_date,"):
        assert wanted in pushed
    assert "hash" not in pushed[pushed.index("ReadSchema") :]
    assert found.count() > 0


def test_series_shuffles_once_and_reads_one_column(stored):
    text = plan(timeseries.timeseries(stored, "day", "2020-01-01", "2020-02-01"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text
    assert "ReadSchema: struct<point_date:timestamp_ntz>" in text


def test_points_stay_where_they_are(stored, polygons):
    text = plan(spatial.match_points(stored.select("lon", "lat"), polygons, "id"))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_newest_rows_are_a_top_k(stored):
    text = plan(points.detail(stored, 10, 5))
    assert "TakeOrderedAndProject(limit=15, offset=5" in text and "Exchange" not in text


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_query_pairs_everything(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "NestedLoopJoin", "Python", "SinglePartition, REPARTITION"):
        assert unwanted not in text


def test_unasked_observations_stay_where_they_are(spark, stored):
    """Only slots that are asked for, and narrow rows, reach the shuffle that orders them."""
    from placetime.operators import nearest

    obs = spark.range(2000).selectExpr(
        "concat('n', id % 50) as node_id", "timestamp_ntz'2020-01-01' + make_dt_interval(0, cast(id as int), 0, 0) as datetime",
        "cast(id as double) as meta_id", "'s' as sensor", "repeat('payload', 20) as payload",
    )
    queries = spark.createDataFrame([(1, "n3")], "query_id int, node_id string").selectExpr("*", "timestamp_ntz'2020-02-01 05:00:00' as instant")
    found = nearest.nearest_in_time(queries, obs, tie=["meta_id"])
    text = plan(found)
    window = text[text.index("Window") :]
    ordered = window[: window.index("LeftSemi")] if "LeftSemi" in window else ""
    assert ordered and "payload" not in ordered
    rows = found.collect()
    assert rows and all(r["payload"] == "payload" * 20 for r in rows)


def test_members_of_networks_are_joined_once(spark):
    """The known networks are written and meet the members in one broadcast join."""
    from placetime.operators import network

    networks = spark.createDataFrame([("net", "i")], "network string, info string")
    bridge = spark.createDataFrame([("net", "n", "s")], "network string, node string, sensor string")
    sensors = spark.createDataFrame([("s", {"a": "f.p"})], "sensor string, observed_properties map<string,string>")
    text = plan(network.network_metadata(networks, bridge, sensors))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and text.count("SortMergeJoin") <= 1  # networks without members
