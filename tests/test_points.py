"""Expected counts for point queries over the small public tables."""

import json

import pytest
from fixtures import CRIMES, DOGS, FLU, FLU_COLUMNS, LOOP, LOOP_AND_SOUTHEAST, OPERA, RADIO
from pyspark.sql import functions as F

from placetime.operators import ingest, points, timeseries
from placetime.operators.filters import compile_arguments, compile_tree
from placetime.operators.catalog import dataset_extent
from placetime.operators.grid import grid_count, grid_features
from placetime.sources.points import PointRoles, apply_types, infer_schema, read_points, read_raw
from placetime.sources.store import dataset_path, open_datasets

ZIP = {"op": "eq", "col": "zip", "val": 60620}
WEDNESDAY = {"op": "eq", "col": "day", "val": "Wednesday"}
YEAR = {"start": "2013-01-01", "end": "2013-12-31"}


@pytest.fixture(scope="module")
def flu(spark):
    raw = spark.createDataFrame(FLU, FLU_COLUMNS)
    return ingest.ingest_points(raw, PointRoles(date="date", lat="latitude", lon="longitude")).cache()


@pytest.fixture(scope="module")
def crimes(spark):
    raw = spark.createDataFrame(CRIMES, ["id", "date", "code", "latitude", "longitude"])
    return ingest.ingest_points(raw, PointRoles(date="date", lat="latitude", lon="longitude")).cache()


@pytest.mark.parametrize(
    "tree, expected",
    [
        (ZIP, 4),
        (WEDNESDAY, 10),
        ({"op": "and", "val": [ZIP, WEDNESDAY]}, 1),
        ({"op": "or", "val": [ZIP, WEDNESDAY]}, 13),
        ({"op": "and", "val": [{"op": "ge", "col": "point_date", "val": "2013-11-01"}, {"op": "or", "val": [ZIP, WEDNESDAY]}]}, 4),
    ],
)
def test_trees(flu, tree, expected):
    assert points.detail(flu, start="2000-01-01", tree=tree).count() == expected
    assert flu.filter(compile_tree(flu.schema, json.dumps(tree))).count() == expected


def test_dates_are_inclusive(flu):
    assert points.detail(flu, start="2013-09-22", end="2013-10-01").count() == 5
    assert points.detail(flu, start="2013-09-22", end="2013-10-01", hours=(0, 23)).count() == 5


def test_hours(crimes):
    assert points.detail(crimes, start="2000-01-01", hours=(5, 17)).count() == 3
    assert points.detail(crimes, start="2015-01-01", hours=(6, 23)).count() == 2


def test_places(flu):
    assert points.detail(flu, geom=LOOP, **YEAR).count() == 5
    assert points.detail(flu, geom=json.dumps(LOOP_AND_SOUTHEAST), **YEAR).count() == 11
    collection = {"type": "FeatureCollection", "features": [LOOP, LOOP_AND_SOUTHEAST]}
    assert points.detail(flu, geom=collection, **YEAR).count() == 5


def test_flat_arguments(flu):
    arguments = {"obs_date__le": "2016/01/19", "event_type__in": "Alderman,CPD", "obs_date__ge": "2012/10/21", "dataset_name": "flu"}
    wanted, warnings = compile_arguments(flu.schema, arguments)
    assert flu.filter(wanted).count() == 53 and warnings == []
    _, warnings = compile_arguments(flu.schema, {"nonsense": 1})
    assert len(warnings) == 1


def test_grid(flu, crimes):
    cells = grid_count(flu, 500, geom=LOOP, start="2013-01-01", end="2014-01-01")
    assert sorted(r["count"] for r in cells.collect()) == [1, 1, 1, 2]
    squares = [json.loads(r["value"]) for r in grid_features(cells).collect()]
    assert all(len(s["geometry"]["coordinates"][0]) == 5 for s in squares)
    church = {"op": "eq", "col": "event_type", "val": "Church"}
    assert grid_count(flu, 500, tree=church, start="2013-01-01").count() == 6
    assert grid_count(crimes, 500, tree={"op": "eq", "col": "code", "val": "1150"}).count() == 2


def test_grid_counts_every_row(flu):
    gaps = flu.withColumns({c: F.when(F.col("ward") > 10, F.col(c)) for c in ("lon", "lat")})
    cells = grid_count(gaps, 500).collect()
    assert sum(r["count"] for r in cells) == 65
    assert [r["count"] for r in cells if r["xmin"] is None] == [gaps.filter("lon IS NULL").count()]


@pytest.mark.parametrize(
    "unit, expected",
    [("day", [1, 0, 0, 0, 0, 0, 1, 0, 1, 2]), ("week", [1, 1, 3]), ("month", [3, 2]), ("quarter", [3, 2]), ("year", [5])],
)
def test_series(flu, unit, expected):
    rows = timeseries.timeseries(flu, unit, "2013-09-22", "2013-10-01").orderBy("time_bucket").collect()
    assert [r["count"] for r in rows] == expected


def test_panel(flu, crimes):
    panel = timeseries.timeseries_panel({"flu": flu, "crimes": crimes}, "year", "2012-01-01", "2013-12-31")
    rows = panel.orderBy("dataset_name", "time_bucket").collect()
    assert [(r["dataset_name"], r["count"], r["total"]) for r in rows] == [("flu", 0, 65), ("flu", 65, 65)]
    pivoted = timeseries.pivot_panel(
        timeseries.timeseries_panel({"flu": flu, "crimes": crimes}, "year", "2013-09-22", "2013-10-01"), ["flu"]
    ).collect()
    assert [(str(r["temporal_group"]), r["flu"]) for r in pivoted] == [("2013-01-01", 5)]
    everything = timeseries.timeseries_panel({"flu": flu, "crimes": crimes}, "year", "2012-01-01", "2013-12-31", keep_empty=True)
    assert everything.count() == 4


def test_panel_of_all_approved_datasets(spark, flu, crimes, tmp_path):
    rows = []
    for name, df, approved in (("flu", flu, True), ("crimes", crimes, True), ("hidden", flu, False)):
        df.write.parquet(dataset_path(str(tmp_path), name))
        extent = dataset_extent(df).first()
        rows.append((name, approved, extent["obs_to"], extent["obs_from"], extent["obs_to"]))
    catalog = spark.createDataFrame(rows, "dataset_name string, approved_status boolean, date_added timestamp_ntz, obs_from timestamp_ntz, obs_to timestamp_ntz")
    assert set(open_datasets(catalog, str(tmp_path))) == {"flu", "crimes"}
    found = open_datasets(catalog, str(tmp_path), start="2013-01-01", end="2014-01-01")
    assert set(found) == {"flu"}
    by_name = timeseries.timeseries_panel(found, "month", "2013-09-22", "2013-12-31")
    stacked = timeseries.stacked_panel(flu.withColumn("dataset_name", F.lit("flu")), "month", "2013-09-22", "2013-12-31")
    assert sorted(by_name.collect()) == sorted(stacked.collect())


def test_series_add_up_and_do_not_depend_on_partitions(flu):
    one = timeseries.timeseries(flu.repartition(1), "week", **YEAR)
    many = timeseries.timeseries(flu.repartition(7), "week", **YEAR)
    assert sorted(one.collect()) == sorted(many.collect())
    assert one.agg(F.sum("count")).first()[0] == 65


def test_presentation(flu):
    page = points.detail(flu, start="2013-09-22", end="2013-10-01")
    assert {"hash", "point_date"}.isdisjoint(points.present(page, "csv").columns)
    features = [json.loads(r["value"]) for r in points.present(page, "geojson").collect()]
    assert len(features) == 5 and all({"latitude", "longitude"} <= set(f["properties"]) for f in features)
    assert features[0]["geometry"]["type"] == "Point"
    with pytest.raises(ValueError):
        points.present(page, "kml")


@pytest.mark.parametrize(
    "tree",
    [
        {"op": "eq", "col": "no_such_column", "val": 1},
        {"op": "near", "col": "zip", "val": 1},
        {"op": "eq", "col": "zip", "val": "no number"},
        {"op": "ge", "col": "point_date", "val": "no date"},
        {"op": "and", "val": []},
        {"op": "like", "col": "zip", "val": "6%"},
        {"op": "eq", "val": 1},
        {"col": "zip"},
    ],
)
def test_bad_conditions_fail_before_running(flu, tree):
    with pytest.raises(ValueError):
        compile_tree(flu.schema, tree)


def test_bad_arguments(flu):
    with pytest.raises(ValueError):
        points.detail(flu, limit=10_001, max_limit=10_000)
    with pytest.raises(ValueError):
        timeseries.timeseries(flu, "hour", "2013-01-01", "2013-01-02")
    with pytest.raises(ValueError):
        points.detail(flu, hours=(0, 24))


# -- loading -----------------------------------------------------------------------------------


def _write(tmp_path, text):
    path = tmp_path / "data.csv"
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("text, roles", [
    (RADIO, PointRoles(date="date", lat="lat", lon="lon")),
    (DOGS, PointRoles(date="date", lat="lat", lon="lon")),
    (OPERA, PointRoles(date="date", location="location")),
])
def test_load_csv(spark, tmp_path, text, roles):
    stored = ingest.ingest_points(read_points(spark, _write(tmp_path, text)), roles, str(tmp_path / "set"))
    rows = stored.orderBy("point_date").collect()
    assert len(rows) == 5
    assert str(rows[0]["point_date"]) == "2015-10-25 00:00:00"
    assert all(r["lon"] < -87 and 39 < r["lat"] < 43 and len(r["hash"]) == 32 for r in rows)


def test_reload_after_change_and_deletion(spark, tmp_path):
    roles = PointRoles(date="date", lat="lat", lon="lon")
    before = ingest.ingest_points(read_points(spark, _write(tmp_path, DOGS)), roles)
    deleted = "\n".join(line for line in DOGS.splitlines() if not line.startswith("3,")) + "\n"
    other = tmp_path / "later"
    other.mkdir()
    after = ingest.ingest_points(read_points(spark, _write(other, deleted)), roles)
    assert after.count() == 4
    assert ingest.sync_snapshot(before, after).count() == 4
    assert ingest.ingest_new_rows(after, before).count() == 0
    changed = RADIO.replace("baz,11/10/2015", "baz,11/10/1993")
    third = tmp_path / "changed"
    third.mkdir()
    old = ingest.ingest_points(read_points(spark, _write(tmp_path, RADIO)), roles)
    new = ingest.ingest_points(read_points(spark, _write(third, changed)), roles)
    assert [str(r["point_date"])[:10] for r in ingest.ingest_new_rows(new, old).collect()] == ["1993-11-10"]
    assert ingest.append_new_rows(new, old).count() == 6


def test_duplicates_and_null_island(spark):
    raw = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 5.0), (3, None, 5.0)], "id int, x double, y double")
    rows = {r["id"]: r for r in ingest.ingest_points(raw, PointRoles(lon="x", lat="y")).collect()}
    assert len(rows) == 3
    assert rows[1]["lon"] is None and rows[3]["lat"] is None and rows[2]["lat"] == 5.0


def test_merging_does_not_depend_on_who_brings_the_rows(spark):
    """Rows that lie by a key already are dealt anew, so no task merges more than its even share."""
    few = spark.range(200).selectExpr("id", "if(id % 3 = 0, null, 'x') AS _bucket").repartition(2, "id")
    merged = ingest.dedup_hash(few.unionByName(few).unionByName(few.filter("id = 6")))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "ENSURE_REQUIREMENTS" in plan
    rows = merged.collect()
    assert len(rows) == 200 == len({r["hash"] for r in rows}) and merged.columns == ["id", "_bucket", "hash"]


def test_roles_need_a_place():
    with pytest.raises(ValueError):
        PointRoles(date="d", lat="y")


@pytest.mark.parametrize(
    "values, expected",
    [
        (["Yes", "no", "T"], ("boolean", False)),
        (["yes", ""], ("string", True)),
        (["1", "2,000", "-3", "na"], ("int", True)),
        (["1", "3000000000"], ("bigint", False)),
        (["1", "99999999999999999999"], ("double", False)),
        (["1.5", "2", "1e3", "N/A"], ("double", True)),
        (["0810", "1"], ("string", False)),
        (["0", "00"], ("int", False)),
        (["10/25/2015", "2015-01-02", "May 3, 2015", "December 1, 2015"], ("date", False)),
        (["2015-10-19 15:58:42", "2015-10-19"], ("timestamp_ntz", False)),
        (["10/25/2015 01:30 PM", "10/25/2015 1:30:05 am"], ("timestamp_ntz", False)),
        (["13/45/2015"], ("string", False)),
        (["09:30", "23:59:59"], ("time", False)),
        (["09:30", "2015-01-01"], ("string", False)),
        (["", None, "."], ("int", True)),
        (["a", "1"], ("string", False)),
    ],
)
def test_types_of_columns(spark, values, expected):
    raw = spark.createDataFrame([(v,) for v in values], "c string")
    row = infer_schema(raw).first()
    assert (row["field_type"], row["has_nulls"]) == expected


def test_typed_values(spark, tmp_path):
    text = 'A-Name,when,flag,n,code\nx,10/25/2015 01:30 PM,Yes,"1,000",007\ny,NA,no,n/a,008\n'
    df = read_points(spark, _write(tmp_path, text))
    assert df.columns == ["a_name", "when", "flag", "n", "code"]
    rows = df.collect()
    assert (str(rows[0]["when"]), rows[0]["flag"], rows[0]["n"], rows[0]["code"]) == ("2015-10-25 13:30:00", True, 1000, "007")
    assert rows[1]["when"] is None and rows[1]["n"] is None


@pytest.mark.parametrize("kind", ["int", "double", "boolean", "date", "timestamp_ntz"])
def test_bad_value_fails_the_load(spark, tmp_path, kind):
    path = _write(tmp_path, "a\nNA\nno such value\n")
    with pytest.raises(Exception, match=f"not a {kind}"):
        read_points(spark, path, types={"a": kind}).collect()


def test_bad_row_fails_the_load(spark, tmp_path):
    with pytest.raises(Exception):
        read_raw(spark, _write(tmp_path, "a,b\n1,2\n1,2,3\n")).collect()


def test_only_numbers_written_in_full_count(spark):
    """A cast alone would take the suffixes of Java's literals."""
    raw = spark.createDataFrame([("1.5", "12", "(41.8, -87.6)", "1e3"), ("12D", "7", "(41.8D, -87.6)", "1f")], "a string, b string, place string, c string")
    kinds = {r["field_name"]: r["field_type"] for r in infer_schema(raw).collect()}
    assert kinds == {"a": "string", "b": "int", "place": "string", "c": "string"}
    for column, kind in (("a", "double"), ("a", "int"), ("c", "double")):
        with pytest.raises(Exception, match="not a"):
            apply_types(raw.select(column), {column: kind}).collect()
    placed = ingest.derive_point(raw.withColumn("when", F.lit("2015-01-01")), PointRoles(date="when", location="place")).collect()
    assert [(r["lat"], r["lon"]) for r in placed] == [(41.8, -87.6), (None, None)]
    placed = ingest.derive_point(raw, PointRoles(lat="a", lon="b")).collect()
    assert [(r["lat"], r["lon"]) for r in placed] == [(1.5, 12.0), (None, None)]


def test_types_of_many_columns_and_of_none(spark):
    names = [f"c{i}" for i in range(11)]
    raw = spark.createDataFrame([[str(i) if i % 2 else f"{i}.5" for i in range(11)], [None] * 11], ", ".join(f"{n} string" for n in names))
    rows = infer_schema(raw).orderBy("position").collect()
    assert [(r["position"], r["field_name"]) for r in rows] == list(enumerate(names, 1))
    assert [r["field_type"] for r in rows] == ["int" if i % 2 else "double" for i in range(11)] and all(r["has_nulls"] for r in rows)
    empty = infer_schema(raw.limit(0)).collect()
    assert len(empty) == 11 and not any(r["has_nulls"] for r in empty)
