"""Spatial operators against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placetime.functions.counting import count_inside
from placetime.functions.geometry import geometries_intersect, geometry, metres_to_degrees, point_in
from placetime.functions.text import slug, slugs
from placetime.operators import nearest, shapes, spatial
from placetime.operators.catalog import box_geometry, catalog_search
from placetime.operators.shapes import shapes_filter
from placetime.sources.shapes import parse_features, read_shapes


def star(rng, x, y, size, corners):
    """A simple polygon around a centre, usually concave."""
    ring = []
    for i in range(corners):
        angle, radius = 2 * math.pi * i / corners, size * rng.uniform(0.3, 1)
        ring.append([x + radius * math.cos(angle), y + radius * math.sin(angle)])
    return [*ring, ring[0]]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def features(polygons):
    return [
        json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": rings}, "properties": {"id": i, "name": f"p{i}"}})
        for i, rings in enumerate(polygons)
    ]


@pytest.fixture(scope="module")
def world(spark):
    """Polygons from metres to half a globe, some with holes, and points, a third at one place."""
    rng = random.Random(7)
    polygons = []
    for i in range(60):
        x, y, size = rng.uniform(-88, -87), rng.uniform(41, 42), 10 ** rng.uniform(-4, 0)
        outer = star(rng, x, y, size, rng.randint(3, 40))
        hole = star(rng, x, y, size * 0.2, 5)
        polygons.append([outer, hole] if i % 3 == 0 else [outer])
    polygons.append([[[-170, -80], [170, -80], [170, 80], [-170, 80], [-170, -80]]])
    places = [(rng.uniform(-88.2, -86.8), rng.uniform(40.8, 42.2)) for _ in range(400)] + [(-87.5, 41.5)] * 200
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([*places, (None, None)])], "pid int, lon double, lat double")
    frame = parse_features(spark.createDataFrame([(f,) for f in features(polygons)], "value string"), "id:int, name:string")
    expected = {(p, s) for p, (x, y) in enumerate(places) for s, rings in enumerate(polygons) if inside(x, y, rings)}
    return points, frame.cache(), expected, polygons


@pytest.mark.parametrize("limit, hot_rows", [(1 << 30, 10**6), (0, 10**6), (0, 20)])
def test_join_equals_brute_force(world, limit, hot_rows):
    points, frame, expected, _ = world
    found = spatial.match_points(points, frame, "id", limit=limit, hot_rows=hot_rows).collect()
    assert len(found) == len(expected)
    assert {(r["pid"], r["id"]) for r in found} == expected


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_cells_with_few_sides_are_tested_in_generated_code(world, limit):
    """The walk over many sides has a join of its own, which gets the cells that are left with many after a division."""
    points, frame, _, _ = world
    plan = spatial.match_points(points, frame, "id", limit=limit)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_cell" in line]
    assert sorted("lambdafunction" in line for line in joins) == [False, True]
    whole, divided = (spatial.shape_cells(frame, "id", divisions=n).filter(F.size("_edges") > spatial.SIDES_IN_COLUMNS) for n in (0, 1))
    area = F.sum(F.pow(F.lit(4.0), F.col("level").cast("double")))
    assert divided.agg(area).first()[0] < 0.7 * whole.agg(area).first()[0]


def test_join_brings_attributes(world):
    points, frame, expected, _ = world
    rows = spatial.spatial_join(points, frame, "id").collect()
    assert {(r["pid"], r["shape_id"]) for r in rows} == expected
    assert all(r["shape_name"] == f"p{r['shape_id']}" for r in rows)


def _final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_points_are_shuffled_once(spark, world, hot_rows):
    """Both joins of the shuffled path read the same points, and pairs come from one row per cell of polygons."""
    points, frame, expected, _ = world
    named = points.select(F.col("pid").alias("pid"), "lon", "lat")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spatial.match_points(named, frame, "id", limit=0, hot_rows=hot_rows)
        assert {(r["pid"], r["id"]) for r in found.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = _final_plan(found)
    assert plan.count("SortMergeJoin") == 2 and "ReusedExchange" in plan
    assert plan.count("Generate explode(array(") == 1 and plan.count("Generate inline(_parts") == 1


def test_pieces_of_crowded_cells_do_not_multiply_polygons(spark, monkeypatch):
    """Many polygons on one place: the pieces of its points are few, whatever number of points is crowded."""
    ring = [[0, 0], [8, 0], [8, 8], [0, 8], [0, 0]]
    frame = parse_features(spark.createDataFrame([(f,) for f in features([[ring]] * 200)], "value string"), "id:int")
    points = spark.range(600).select(F.col("id").alias("pid"), (F.col("id") % 20 / 100 + 4.1).alias("lon"), (F.col("id") % 30 / 100 + 4.1).alias("lat"))
    cells = spatial.shape_cells(frame, "id").cache()
    keyed = points.select("*", spatial._own_cells([r["level"] for r in cells.select("level").distinct().collect()]).alias("_cell"))
    pieces, parts = spatial._crowds(keyed, cells, 5)
    assert pieces.isEmpty() and parts.isEmpty()  # 5 points a piece repeated the 200 squares 120 times
    monkeypatch.setattr(spatial, "REPEATED", 0.1)
    monkeypatch.setattr(spatial, "PARTS", 30)
    pieces, parts = spatial._crowds(keyed, cells, 5)
    assert pieces.first()["shards"] == 30 and {r["shards"] for r in parts.collect()} == {7}
    found = spatial.match_points(points, frame, "id", limit=0, hot_rows=5)
    assert found.count() == found.distinct().count() == 600 * 200


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_attributes_join_the_polygons(world, limit):
    """Keys that repeat or are null give the same rows as a join of pairs, also where a point's column has the name of one."""
    points, frame, _, _ = world
    keys = frame.select(F.when(F.col("id") % 5 > 0, F.col("id") - F.col("id") % 2).alias("id"), "name", "geom")
    named = points.select("pid", "lon", "lat", F.lit("p").alias("shape_name"))
    pairs = spatial.match_points(points, keys, "id", limit=limit).select("pid", "id")
    expected = sorted(map(tuple, pairs.join(keys.select("id", "name"), "id").select("id", "pid", "name").collect()))
    found = spatial.spatial_join(named, keys, "id", limit=limit)
    assert found.columns == ["shape_id", "pid", "lon", "lat", "shape_name", "shape_name"]
    rows = found.toDF("id", "pid", "lon", "lat", "p", "name").select("id", "pid", "name").collect()
    assert sorted(map(tuple, rows)) == expected and len(expected) > pairs.filter("id IS NOT NULL").count()
    if limit == 0:
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        union = next(i for i, line in enumerate(plan) if "Union" in line)
        assert not any("Join" in line for line in plan[:union])


def test_counts(world):
    points, frame, expected, _ = world
    counts = {r["id"]: r["count"] for r in spatial.points_per_polygon(points, frame, "id").collect()}
    assert sum(counts.values()) == len(expected)
    assert all(sum(1 for _, s in expected if s == i) == n for i, n in counts.items())


@pytest.mark.parametrize("crowd", [10**6, 300])
@pytest.mark.parametrize("predicate", ["intersects", "within"])
def test_counts_without_pairs(world, predicate, crowd):
    """Cells too many to broadcast: the same counts, and no join of points and cells."""
    points, frame, _, _ = world
    odd = points.select("lon", "lat").unionAll(points.select(F.round("lon"), F.round("lat"))).unionAll(points.select(F.lit(float("nan")), "lat"))
    pairs = spatial.match_points(odd, frame, "id", predicate).groupBy("id").count()
    counted = spatial.count_points(odd, frame, "id", predicate, limit=0, crowd=crowd)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, pairs.collect()))
    plan = spatial.points_per_polygon(odd, frame, "id", predicate, limit=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_points_on_sides_of_a_part():
    """Blocks of points against the test of every point with every side, many points on sides and corners."""
    rng = np.random.default_rng(3)
    x, y = (np.round(rng.random(3000) * 64) / 64 for _ in "xy")
    sides = np.round(rng.random((200, 4)) * 96 - 16) / 64
    sides[::3, 2], sides[1::5, 3] = sides[::3, 0], sides[1::5, 1]
    starts = np.sort(np.append(rng.integers(0, 200, 59), [0, 200]))
    flip = rng.random(60) < 0.5
    boxes = [rng.random(60) * 0.2, 1 - rng.random(60) * 0.2, rng.random(60) * 0.2, 1 - rng.random(60) * 0.2]
    for boundary in (True, False):
        found = count_inside(x, y, flip, starts, sides, boxes, boundary)
        for i in range(60):
            inside_, border = np.full(3000, flip[i]), np.zeros(3000, bool)
            for x1, y1, x2, y2 in sides[starts[i] : starts[i + 1]]:
                if y1 != y2:
                    inside_ ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
                border |= ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)) & ((x - x1) * (x - x2) <= 0) & ((y - y1) * (y - y2) <= 0)
            held = (inside_ | border) if boundary else (inside_ & ~border)
            assert found[i] == (held & (x >= boxes[0][i]) & (x <= boxes[1][i]) & (y >= boxes[2][i]) & (y <= boxes[3][i])).sum()


def test_borders(spark):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    frame = parse_features(spark.createDataFrame([(f,) for f in features([square])], "value string"), "id:int")
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 1.0), (4, 3.0, 1.0), (5, 1.0, 2.0)], "pid int, lon double, lat double")
    within = {r["pid"] for r in spatial.match_points(points, frame, "id").collect()}
    meeting = {r["pid"] for r in spatial.match_points(points, frame, "id", "intersects").collect()}
    assert within == {3} and meeting == {1, 2, 3, 5}
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [1, 2], [0, 2], [0, 0]]]}
    x, y = F.col("lon"), F.col("lat")
    assert {r["pid"] for r in points.filter(point_in(x, y, shape)).collect()} == {3}
    assert {r["pid"] for r in points.filter(point_in(x, y, shape, boundary=True)).collect()} == {1, 2, 3, 5}


def test_no_polygons(spark, world):
    points, frame, _, _ = world
    assert spatial.match_points(points, frame.limit(0), "id").count() == 0


@pytest.mark.parametrize("which", range(0, 61, 6))
def test_literal_polygon(world, which):
    points, _, expected, polygons = world
    shape = {"type": "Polygon", "coordinates": polygons[which]}
    found = {r["pid"] for r in points.filter(point_in(F.col("lon"), F.col("lat"), shape)).collect()}
    assert found == {p for p, s in expected if s == which}


def test_line_buffer(spark):
    reach = metres_to_degrees(100, 0)[1]
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 0], [1, 1]]}
    places = [(0.5, reach * 0.99), (0.5, reach * 1.01), (1 + reach * 0.7, -reach * 0.7), (1 + reach * 0.8, -reach * 0.8), (-reach * 0.9, 0.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "pid int, lon double, lat double")
    assert {r["pid"] for r in points.filter(point_in(F.col("lon"), F.col("lat"), line)).collect()} == {0, 2, 4}


@pytest.mark.parametrize(
    "coordinates, expected",
    [
        ([[0.5, 0.5], [0.6, 0.5], [0.6, 0.6], [0.5, 0.5]], True),  # inside
        ([[-5, -5], [5, -5], [5, 5], [-5, 5], [-5, -5]], True),  # around
        ([[1, 1], [2, 1], [2, 2], [1, 1]], True),  # touching a corner
        ([[0.4, -1], [0.6, -1], [0.6, 3], [0.4, 3], [0.4, -1]], True),  # across, no corner inside
        ([[1.5, 0], [2, 0], [2, 1], [1.5, 0]], False),
    ],
)
def test_shapes_meet(spark, coordinates, expected):
    frame = parse_features(spark.createDataFrame([(features([[[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]])[0],)], "value string"), "id:int")
    shape = {"type": "Polygon", "coordinates": [coordinates]}
    assert frame.filter(geometries_intersect(F.col("geom"), shape)).count() == int(expected)


def test_shape_inside_a_hole_does_not_meet(spark):
    rings = [[[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[2, 2], [7, 2], [7, 7], [2, 7], [2, 2]]]
    frame = parse_features(spark.createDataFrame([(features([rings])[0],)], "value string"), "id:int")
    shape = {"type": "Polygon", "coordinates": [[[3, 3], [4, 3], [4, 4], [3, 3]]]}
    assert frame.filter(geometries_intersect(F.col("geom"), shape)).count() == 0


def test_lines_are_shapes_too(spark, tmp_path):
    street = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [4, 4]]}, "properties": {"Street Name": "a"}}
    nothing = {"type": "Feature", "geometry": None, "properties": {"Street Name": "b"}}
    path = tmp_path / "streets.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [street, nothing]}))
    frame = read_shapes(spark, str(path))
    assert frame.columns == ["street_name", "geom"]
    area = {"type": "Polygon", "coordinates": [[[1, 0], [3, 0], [3, 5], [1, 5], [1, 0]]]}
    assert shapes.shapes_filter(frame, area).count() == 1
    exported = [json.loads(r["value"]) for r in shapes.shape_features(frame).collect()]
    assert [f["geometry"] for f in exported] == [{"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [4.0, 4.0]]]}]
    counts = shapes.shapes_intersecting({"streets": frame, "none": frame.limit(0)}, area).collect()
    assert [(r["dataset_name"], r["num_shapes"]) for r in counts] == [("streets", 1)]


def test_geometry_arguments():
    with pytest.raises(ValueError):
        geometry({"type": "Point", "coordinates": [0, 0]})
    east, north = metres_to_degrees(100, 60)
    assert math.isclose(east, 2 * north, rel_tol=1e-9)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_neighbours_equal_brute_force(spark, k):
    rng = random.Random(k)
    spots = [(rng.gauss(-87.6, 0.01), rng.gauss(41.9, 0.01)) for _ in range(30)] + [(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(10)]
    nodes = spark.createDataFrame([("net", f"n{i:03}", x, y) for i, (x, y) in enumerate(spots)], "network string, node string, lon double, lat double")
    asked = [(-87.6, 41.9), (0.0, 0.0), (179.9, 84.0), (-87.61, 41.95), (-180.0, -85.0)]
    queries = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(asked)], "query_id int, lon double, lat double")
    found = {}
    for r in nearest.knn_nodes(queries, nodes, k).collect():
        found.setdefault(r["query_id"], set()).add(r["node"])
    for i, (x, y) in enumerate(asked):
        order = sorted(range(len(spots)), key=lambda n: math.hypot(spots[n][0] - x, spots[n][1] - y))
        assert found[i] == {f"n{n:03}" for n in order[:k]}
    single = nearest.nearest_node(nodes, *asked[0], k).collect()
    assert {r["node"] for r in single} == found[0]


def test_neighbours_from_afar_meet_few_nodes(spark):
    """Queries far from a dense cluster are joined with a small multiple of k of its nodes, not with all."""
    rng = random.Random(5)
    spots = [(rng.uniform(0, 0.01), rng.uniform(0, 0.01)) for _ in range(4000)] + [(50.0, 50.0)] * 3
    nodes = spark.createDataFrame([("net", f"n{i:04}", x, y) for i, (x, y) in enumerate(spots)], "network string, node string, lon double, lat double")
    asked = [(30.0 + i, -20.0 + 3 * i) for i in range(20)]
    queries = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(asked)], "query_id int, lon double, lat double")
    *_, depth = nearest._cells(nodes.select("network", "node", F.col("lon").alias("x"), F.col("lat").alias("y")), 10)
    assert depth > 3
    result = nearest.knn_nodes(queries, nodes, 10)
    rows = result.collect()
    for i, (x, y) in enumerate(asked):
        order = sorted(range(len(spots)), key=lambda n: (math.hypot(spots[n][0] - x, spots[n][1] - y), n))
        assert [r["node"] for r in sorted((r for r in rows if r["query_id"] == i), key=lambda r: (r["distance"], r["node"]))] == [f"n{n:04}" for n in order[:10]]
    joined = []

    def visit(node):
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        if "QueryStage" in name:
            visit(node.plan())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(result._jdf.queryExecution().executedPlan())
    assert joined and max(joined) <= 20 * 10 * 20


def test_neighbours_of_crowded_and_absent_places(spark):
    nodes = spark.createDataFrame([("b", f"n{i:02}", 1.0, 1.0) for i in range(40)] + [("a", "x", 1.0, 1.0), ("a", "y", None, 1.0)], "network string, node string, lon double, lat double")
    queries = spark.createDataFrame([(1, 1.0, 1.0), (2, -5.0, 7.0), (3, None, 0.0)], "query_id int, lon double, lat double")
    rows = nearest.knn_nodes(queries, nodes, 3).orderBy("query_id", "network", "node").collect()
    assert [(r["query_id"], r["node"], r["rank"]) for r in rows] == [(q, n, 1) for q in (1, 2) for n in ("x", "n00", "n01")]
    assert nearest.knn_nodes(queries, nodes.limit(0), 3).collect() == []
    assert nearest.knn_nodes(queries.limit(0), nodes, 3).collect() == []


def test_slugs():
    assert slug("A-Awef-Basdf-123") == "a_awef_basdf_123"
    assert slugs(["Zip Code", "zip  code", "!"]) == ["zip_code", "zip_code_2", "column"]


def test_a_line_reaches_shapes_and_datasets_within_its_buffer(spark):
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 0]]}  # 100 m are 0.000898 degrees
    boxes = {
        "beside": (0.4, 0.0005, 0.6, 0.1), "too far": (0.4, 0.002, 0.6, 0.1), "around": (-1.0, -1.0, 2.0, 1.0),
        "beyond": (1.0005, -0.1, 1.1, 0.1), "too far beyond": (1.002, -0.1, 1.1, 0.1), "corner": (1.0008, 0.0008, 1.1, 0.1),
    }
    catalog = spark.createDataFrame([(n, *b) for n, b in boxes.items()], "dataset_name string, xmin double, ymin double, xmax double, ymax double")
    near = {"beside", "around", "beyond"}
    found = catalog_search(catalog, geom=line, ingested=F.lit(True))
    assert {r["dataset_name"] for r in found.collect()} == near
    shapes = catalog.withColumn("geom", box_geometry())
    assert {r["dataset_name"] for r in shapes_filter(shapes, line).collect()} == near


def test_crowds_of_queries_go_down_together(spark):
    """What the search joins grows with the groups of queries in a cell, not with the queries."""
    rng = random.Random(9)
    spots = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(300)]
    nodes = spark.createDataFrame([("net", f"n{i:04}", x, y) for i, (x, y) in enumerate(spots)], "network string, node string, lon double, lat double")
    asked = [(rng.uniform(0.4, 0.5), rng.uniform(0.4, 0.5)) for _ in range(3000)]
    queries = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(asked)], "query_id int, lon double, lat double")
    result = nearest.knn_nodes(queries, nodes, 10)
    found = {}
    for r in result.collect():
        found.setdefault(r["query_id"], []).append((r["distance"], r["node"], r["rank"]))
    for i, (x, y) in list(enumerate(asked))[::50]:
        order = sorted(range(len(spots)), key=lambda n: math.hypot(spots[n][0] - x, spots[n][1] - y))
        assert [(node, rank) for _, node, rank in sorted(found[i])] == [(f"n{n:04}", place) for place, n in enumerate(order[:10], 1)]
    joined = []

    def visit(node):
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            joined.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        if "QueryStage" in name:
            visit(node.plan())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(result._jdf.queryExecution().executedPlan())
    assert joined and max(joined) <= 2 * len(asked)
