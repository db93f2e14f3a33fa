"""Observations and networks on small tables with known answers."""

import datetime as dt
import glob
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from placetime.operators import nearest, network, observations
from placetime.sources import exports
from placetime.streaming import jobs

DAY = dt.datetime(2016, 10, 1)
START, END = "2016-10-01", "2016-10-03"


@pytest.fixture(scope="module")
def vector(spark):
    """A hundred readings on each of three days."""
    rng = random.Random(3)
    rows = [
        ("test_node", DAY + dt.timedelta(days=d, seconds=rng.randrange(86400)), float(i), "sensor_02", rng.random(), rng.random())
        for d in range(3)
        for i in range(100)
    ]
    return spark.createDataFrame(rows, "node_id string, datetime timestamp_ntz, meta_id double, sensor string, x double, y double")


@pytest.fixture(scope="module")
def january(spark):
    rows = [
        (node, dt.datetime(2017, 1, 1) + dt.timedelta(days=d), 0.0, "s", value)
        for node, value in (("node0", 0.0), ("node1", 20.0))
        for d in range(31)
    ]
    return spark.createDataFrame(rows, "node_id string, datetime timestamp_ntz, meta_id double, sensor string, temperature double")


def test_hourly_aggregate_is_dense(vector):
    found = observations.node_aggregate(vector, "hour", "avg", START, END, node="test_node", sensors=["SENSOR_02"])
    rows = observations.fill_gaps(found, "hour", START, END).collect()
    assert len(rows) == 48
    assert sum(r["x_count"] for r in rows) == 200
    assert all((r["x"] is None) == (r["x_count"] == 0) for r in rows)


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "week", "month", "year"])
def test_every_unit_is_filled(vector, unit):
    found = observations.node_aggregate(vector, unit, "max", START, END)
    rows = observations.fill_gaps(found, unit, START, END).collect()
    assert len(rows) == {"minute": 2880, "hour": 48, "day": 2, "week": 1, "month": 1, "year": 1}[unit]
    assert sum(r["y_count"] for r in rows) == 200


def test_empty_stays_empty(vector):
    found = observations.node_aggregate(vector, "hour", "avg", "1999-01-01", "1999-01-02")
    assert observations.fill_gaps(found, "hour", "1999-01-01", "1999-01-02").count() == 0


def test_functions(vector):
    values = [r["x"] for r in vector.filter(F.col("datetime") < "2016-10-02").collect()]
    expected = {
        "avg": statistics.mean(values), "std": statistics.stdev(values), "var": statistics.variance(values),
        "max": max(values), "min": min(values), "med": statistics.median(values),
    }
    for fn, value in expected.items():
        row = observations.node_aggregate(vector, "day", fn, START, "2016-10-02").first()
        assert row["x"] == pytest.approx(value) and row["x_count"] == 100


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 4001])
def test_medians_of_crowded_groups_are_exact(spark, n):
    rng = random.Random(n)
    rows = [("hot", DAY, 0.0, "s", rng.choice([rng.gauss(0, 1e6), 5.0])) for _ in range(n)] + [("cold", DAY, 0.0, "s", 1.0)]
    obs = spark.createDataFrame(rows, "node_id string, datetime timestamp_ntz, meta_id double, sensor string, v double")
    found = {r["node_id"]: r["v"] for r in observations.node_aggregate(obs, "day", "med", hot_rows=min(n - 1, 500)).collect()}
    assert found["hot"] == statistics.median(r[4] for r in rows[:n]) and found["cold"] == 1.0


def test_contradicting_filters(vector):
    with pytest.raises(ValueError):
        observations.node_aggregate(vector, "hour", "avg", properties=["no such property"])
    with pytest.raises(ValueError):
        observations.node_aggregate(vector, "hour", "mode")
    with pytest.raises(ValueError):
        observations.select_observations(vector, prop="no such property")


def test_queries(vector):
    assert observations.observations(vector, start="2016-01-01").count() == 300
    assert observations.observations(vector, nodes=["Test_Node"], start=START, end=END).count() == 200
    newest = observations.observations(vector, limit=3).collect()
    assert [r["datetime"] for r in newest] == sorted((r["datetime"] for r in vector.collect()), reverse=True)[:3]
    two = observations.merge_features({"a": vector, "b": vector.drop("y")}, limit=None)
    assert two.count() == 600 and two.filter("feature = 'b' AND y IS NOT NULL").count() == 0


def test_trigger(vector):
    over = observations.threshold_trigger({"vector": vector}, "x", "gt", 0.5, START, END, limit=None).collect()
    assert len(over) == vector.filter("x > 0.5").filter(F.col("datetime") < END).count()
    assert [r["datetime"] for r in over] == sorted((r["datetime"] for r in over), reverse=True)


def test_archive(spark, january, tmp_path):
    path = str(tmp_path / "archive")
    more = january.withColumn("datetime", F.expr("datetime + INTERVAL '1' MONTH")).unionByName(january)
    exports.archive_month({"temperature": more}, "2017-01-20 12:30:00", path)
    folder = os.path.join(path, "feature=temperature", "month=2017-01", "node=node0")
    assert glob.glob(os.path.join(folder, "*.csv.gz"))
    rows = spark.read.csv(folder, header=True).collect()
    assert len(rows) == 31 and {r["temperature"] for r in rows} == {"0.0"}


def test_exports_of_several_features(spark, vector, january, tmp_path):
    exports.export_observations({"vector": vector, "temperature": january}, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv" / "feature=vector"), header=True).count() == 300
    exports.export_observations({"vector": vector, "temperature": january}, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 362
    with pytest.raises(ValueError):
        exports.export_observations({"vector": vector}, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_nearest_in_time_equals_brute_force(spark, hot_rows):
    """One node has most readings, many at the same instant."""
    rng = random.Random(11)
    base = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(300):
        when = base + dt.timedelta(minutes=rng.choice([rng.randrange(3000), 60 * rng.randrange(5)]))
        rows.append(("hot" if i % 3 else f"n{i % 7}", when, float(i), "s", float(i)))
    obs = spark.createDataFrame(rows, "node_id string, datetime timestamp_ntz, meta_id double, sensor string, v double")
    asked = [(q, rng.choice(["hot", "n0", "n3", "absent"]), base + dt.timedelta(minutes=rng.randrange(-800, 4000))) for q in range(60)]
    queries = spark.createDataFrame(asked, "query_id int, node_id string, instant timestamp_ntz")
    found = {}
    for r in nearest.nearest_in_time(queries, obs, tie=["meta_id"], hot_rows=hot_rows).collect():
        found.setdefault(r["query_id"], {})[r["place"]] = r["meta_id"]
    for q, node, instant in asked:
        close = [r for r in rows if r[0] == node and abs(r[1] - instant) <= dt.timedelta(hours=12)]
        close.sort(key=lambda r: (abs(r[1] - instant), r[1], -r[2] if r[1] <= instant else r[2]))
        assert found.get(q, {}) == {i + 1: r[2] for i, r in enumerate(close[:3])}


def test_nearest_node_with_data(spark):
    nodes = spark.createDataFrame([("net", "a", 0.0, 0.0), ("net", "b", 1.0, 0.0)], "network string, node string, lon double, lat double")
    obs = spark.createDataFrame([("b", DAY, 0.0, "s", 4.0)], "node_id string, datetime timestamp_ntz, meta_id double, sensor string, v double")
    queries = spark.createDataFrame([(1, 0.1, 0.0, DAY + dt.timedelta(hours=12)), (2, 0.1, 0.0, DAY + dt.timedelta(hours=13))],
                                    "query_id int, lon double, lat double, instant timestamp_ntz")
    rows = nearest.nearest_observations(queries, nodes, obs).collect()
    assert [(r["query_id"], r["node_id"], r["v"]) for r in rows] == [(1, "b", 4.0)]


@pytest.fixture(scope="module")
def topology(spark):
    bridge = spark.createDataFrame(
        [("net", "n1", "s1"), ("net", "n1", "s2"), ("net", "n1", "s2"), ("net", "n2", "s3"), ("other", "m", "s3")],
        "network string, node string, sensor string",
    )
    sensors = spark.createDataFrame(
        [("s1", {"t": "temperature.temperature", "h": "humidity.humidity"}), ("s2", {"v": "vector.x", "w": "vector.Y"}),
         ("s3", {"t": "temperature.temperature"}), ("bad", {"a": "nothing", "b": "vector.z", "c": "fog.d"})],
        "sensor string, observed_properties map<string,string>",
    ).withColumn("info", F.lit("i"))
    features = spark.createDataFrame(
        [("temperature", [("temperature", "FLOAT")]), ("vector", [("x", "FLOAT"), ("y", "DOUBLE")]), ("humidity", [("humidity", "INT")])],
        "feature string, observed_properties array<struct<name:string,type:string>>",
    )
    return bridge, sensors, features


def test_network(spark, topology):
    bridge, sensors, features = topology
    assert network.network_tree(bridge, sensors).count() == 4
    trees = {r["node"]: r["tree"] for r in network.nested_tree(bridge, sensors).collect()}
    assert list(trees["n1"]) == ["s1", "s2"] and trees["n1"]["s2"] == {"v": "vector.x", "w": "vector.Y"}
    properties = network.node_properties(bridge, sensors, node="n1", features=["vector"]).collect()
    assert {(r["feature"], r["property"]) for r in properties} == {("vector", "x"), ("vector", "y")}
    assert network.node_properties(bridge, sensors, node="n2", only_sensors=["s1"]).count() == 0
    networks = spark.createDataFrame([("net", "i"), ("empty", "j")], "network string, info string")
    members = network.network_metadata(networks, bridge, sensors).collect()
    assert {(r["kind"], r["name"]) for r in members if r["network"] == "net"} == {
        ("node", "n1"), ("node", "n2"), ("sensor", "s1"), ("sensor", "s2"), ("sensor", "s3"),
        ("feature", "temperature"), ("feature", "humidity"), ("feature", "vector"),
    }
    assert [r["kind"] for r in members if r["network"] == "empty"] == [None]
    problems = {(r["target"], r["problem"]) for r in network.validate_sensors(sensors, features).collect()}
    assert problems == {
        ("nothing", "feature without property"), ("vector.z", "unknown property"), ("fog.d", "unknown feature"),
        ("vector.Y", "unknown property"),
    }


def test_stream_aggregate_emits_closed_windows(spark, vector, tmp_path):
    vector.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(vector.schema).parquet(str(tmp_path / "in"))
    aggregate = jobs.stream_node_aggregate(stream, "1 day", "1 hour", ["x"])
    jobs.run_available(aggregate, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r["x_count"] for r in rows] == [100, 100]
    jobs.run_available(aggregate, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_crowded_slots_repeat_few_rows(spark):
    """Cutting crowded slots adds a few rows a piece; it does not pair every piece of readings with every piece of queries."""
    base = dt.datetime(2020, 1, 1)
    schema = "node_id string, datetime timestamp_ntz, meta_id double, sensor string, v double"
    obs = spark.createDataFrame([("n", base + dt.timedelta(seconds=10 * i), float(i), "s", float(i)) for i in range(2000)], schema)
    queries = spark.createDataFrame([(q, "n", base + dt.timedelta(seconds=10 * q + 1)) for q in range(2000)], "query_id int, node_id string, instant timestamp_ntz")
    found = nearest.nearest_in_time(queries, obs, tie=["meta_id"], hot_rows=3)
    rows = {(r["query_id"], r["place"]): r["v"] for r in found.collect()}
    assert len(rows) == 6000 and all(rows[q, 1] == q for q in range(2000)) and all(rows[q, 2] == q + 1 for q in range(1999))
    most = []

    def visit(node):
        name = node.nodeName()
        if node.metrics().contains("numOutputRows"):
            most.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        if "QueryStage" in name:
            visit(node.plan())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(found._jdf.queryExecution().executedPlan())
    assert max(most) <= 6 * 4000


def test_sensors_of_features_are_gathered_before_the_join(spark):
    """Repeated links and sensors, features that differ in case, unknown ones: each triple once, with no gathering of the joined rows."""
    links = [("a", "n1", "s1"), ("a", "n2", "s1"), ("a", "n1", "s1"), ("b", "n3", "s2"), (None, "n4", "s1"), ("b", "n3", None), ("b", "n5", "gone")]
    bridge = spark.createDataFrame(links, "network string, node string, sensor string")
    maps = [("s1", {"x": "Wind.speed", "y": "wind.gust"}), ("s1", {"z": "rain.sum"}), ("s2", {"x": "rain.sum"}), (None, {"x": "rain.sum"}), ("s3", None)]
    sensors = spark.createDataFrame(maps, "sensor string, observed_properties map<string, string>")
    found = network.feature_sensors(bridge, sensors)
    expected = {(n, f, "s1") for n in ("a", None) for f in ("wind", "rain")} | {("b", "rain", "s2")}
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == ["network", "feature", "sensor"] and len(rows) == len(expected) and set(rows) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
