"""Stored tables: monthly loads, keyed tables, layouts, pages, panels over a catalog."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from placetime.functions.timeparts import ts_lit
from placetime.operators import catalog, ingest, paging, points, timeseries
from placetime.operators.ingest import PointRoles, ingest_points
from placetime.operators.weather import DAILY_HEADERS, HOURLY_HEADERS
from placetime.sources import observations, store
from placetime.sources import weather as files
from placetime.sources.keyed import KeyedTable


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scan_metric(df, metric: str) -> int:
    """A metric of the scans of an executed frame, summed."""
    total = 0

    def visit(node):
        nonlocal total
        name = node.nodeName()
        if name.startswith("Scan") and node.metrics().contains(metric):
            total += node.metrics().apply(metric).value()
        if name == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        if "QueryStage" in name:
            visit(node.plan())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return total


# -- monthly loads ----------------------------------------------------------------------------------------


def _daily(path, old: bool, rows) -> None:
    """A file of daily reports: rows of (station, day, greatest temperature)."""
    names = [pair[int(old)] for pair in DAILY_HEADERS.values()]
    at = {name: i for i, name in enumerate(DAILY_HEADERS)}
    lines = [",".join(names)]
    for station, day, warmest in rows:
        cells = ["-"] * len(names)
        cells[at["wban_code"]], cells[at["date"]], cells[at["temp_max"]] = station, day, warmest
        lines.append(",".join(cells))
    path.write_text("\n".join(lines) + "\n")


def test_two_layouts_loaded_again_and_again(spark, tmp_path):
    landing, shop = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    _daily(landing / "200704daily.txt", True, [("1", "20070401", "50"), ("1", "20070402", "51*"), ("1", "20070402", "49"), ("2", "20070501", "70")])
    _daily(landing / "200705daily.txt", False, [("2", "20070501", "72"), ("1", "20070531", " M"), ("3", "notaday", "1")])
    load = lambda *months, **lists: files.load_months(spark, str(landing), shop, "daily", months, **lists)
    rows = lambda: sorted((r["wban_code"], str(r["date"]), r["temp_max"], r["month"]) for r in files.stored_reports(spark, shop).collect())
    assert load((2007, 4)) == ["2007-04", "2007-05"]
    first = [("1", "2007-04-01", 50.0, "2007-04"), ("1", "2007-04-02", 51.0, "2007-04"), ("2", "2007-05-01", 70.0, "2007-05")]
    assert rows() == first
    assert load((2007, 4), (2007, 5)) == ["2007-04", "2007-05"]
    both = sorted([*first, ("1", "2007-05-31", None, "2007-05")], key=str)
    assert sorted(rows(), key=str) == both
    load((2007, 5), (2007, 4))
    assert sorted(rows(), key=str) == both
    # A later file leaves the folders of other months alone.
    _daily(landing / "200706daily.txt", False, [("1", "20070601", "80"), ("9", "20070602", "81"), ("8", "20070603", "82")])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("month=2007-0[45]/*.parquet")}
    assert load((2007, 6), only=["1", "9"], without=["9"]) == ["2007-06"]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("month=2007-0[45]/*.parquet")}
    assert [r for r in rows() if r[3] == "2007-06"] == [("1", "2007-06-01", 80.0, "2007-06")]


def test_the_regular_load_takes_both_spans(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for month in (1, 2):
        _daily(landing / f"20150{month}daily.txt", False, [("1", f"20150{month}01", "50")])
        names = [pair[0] for pair in HOURLY_HEADERS.values()]
        cells = ["-"] * len(names)
        cells[0], cells[1], cells[2] = "1", f"20150{month}01", "130"
        (landing / f"20150{month}hourly.txt").write_text(",".join(names) + "\n" + ",".join(cells) + "\n")
    got = files.update_weather(spark, str(landing), str(tmp_path / "store"), dt.date(2015, 2, 5))
    assert got == {"daily": ["2015-01", "2015-02"], "hourly": ["2015-01", "2015-02"]}
    assert files.update_weather(spark, str(landing), str(tmp_path / "store"), dt.date(2015, 2, 15)) == {"daily": ["2015-02"], "hourly": ["2015-02"]}
    hours = files.stored_reports(spark, str(tmp_path / "store" / "hourly")).orderBy("datetime").collect()
    assert [r["datetime"] for r in hours] == [dt.datetime(2015, 1, 1, 1, 30), dt.datetime(2015, 2, 1, 1, 30)]


# -- keyed tables -----------------------------------------------------------------------------------------


@pytest.fixture
def keyed(spark, tmp_path):
    table = KeyedTable(spark, f"keyed_{uuid.uuid4().hex}", ("hash",), buckets=4)
    yield table, str(tmp_path / "keyed")
    spark.sql(f"DROP TABLE IF EXISTS {table.name}")


def test_only_unseen_rows_are_added(spark, keyed):
    table, path = keyed
    make = lambda ids, mark: spark.createDataFrame([(f"h{i}", {"a": i, "b": None}, mark) for i in ids], "hash string, props map<string,int>, mark string")
    table.add(make([1, 2, 2, 3], "first"), path)
    table.add(make([2, 3, 4, 4], "second"))
    table.add(make([2, 3, 4, 4], "second"))
    rows = sorted((r["hash"], r["props"]["a"], r["mark"]) for r in table.rows().collect())
    assert rows == [("h1", 1, "first"), ("h2", 2, "first"), ("h3", 3, "first"), ("h4", 4, "second")]


def test_stored_rows_do_not_move(spark, keyed):
    """Only what comes in is shuffled, once; of the stored rows the keys alone are read."""
    table, path = keyed
    rows = spark.range(1000).selectExpr("md5(cast(id as string)) as hash", "id", "id % 7 as kind")
    table.add(rows.filter("id < 900"), path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = table.unseen(rows)
        text = plan(fresh)
        assert fresh.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stored = text[text.index("Scan parquet") :] if "Scan parquet" in text else text[text.index("FileScan parquet") :]
    assert "Bucketed: true" in stored and "ReadSchema: struct<hash:string>" in stored
    join = text[: text.index("FileScan parquet")]
    assert "LeftAnti" in join
    # The branch of the stored side is the last one: nothing between join and scan moves rows.
    branch = join[join.rindex("Exchange") :] if "Exchange" in join else join
    assert "hashpartitioning(hash" in branch and "Range" in branch


def test_rows_with_maps_have_a_largest(spark):
    rows = spark.createDataFrame([("a", {"x": 1}, 1), ("a", {"x": 2}, 1), ("b", None, 2)], "k string, m map<string,int>, v int")
    found = {r["k"]: r["m"] for r in catalog.largest_per_key(rows, ["k"]).collect()}
    assert found == {"a": {"x": 2}, "b": None}
    assert ingest.ingest_new_rows(rows, rows.filter("k = 'b'"), ["k"]).count() == 1
    nested = rows.select("k", F.array("m").alias("list"), F.struct("m").alias("in"))
    assert catalog.largest_per_key(nested, ["k"]).count() == 2


# -- layouts ----------------------------------------------------------------------------------------------


def test_a_box_and_a_day_read_few_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-87.9, -87.5), rng.uniform(41.6, 42.0), dt.datetime(2015, 1, 1) + dt.timedelta(hours=rng.randrange(8760))) for i in range(20_000)]
    raw = spark.createDataFrame(rows, "id int, x double, y double, when timestamp_ntz").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        stored = ingest_points(raw, PointRoles(date="when", lat="y", lon="x"), str(tmp_path / "points"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    box = {"type": "Polygon", "coordinates": [[[-87.75, 41.7], [-87.65, 41.7], [-87.65, 41.8], [-87.75, 41.8], [-87.75, 41.7]]]}
    found = points.select_points(stored, "2015-06-01", "2015-07-01", box).select("id")
    want = {i for i, x, y, t in rows if dt.datetime(2015, 6, 1) <= t <= dt.datetime(2015, 7, 1) and -87.75 < x < -87.65 and 41.7 < y < 41.8}
    assert {r["id"] for r in found.collect()} == want
    assert scan_metric(found, "numOutputRows") < 20_000 / 2  # a twelfth of the time, a sixteenth of the ground, 64 files


def test_observations_lie_by_day(spark, tmp_path):
    rows = spark.range(2000).selectExpr(
        "concat('N', id % 20) as node_id", "timestamp_ntz'2020-01-01' + make_dt_interval(0, cast(id as int), 0, 0) as datetime",
        "cast(id as double) as meta_id", "'s' as sensor", "cast(id as double) as value",
    )
    rows = rows.unionByName(rows.limit(1).withColumn("datetime", F.lit(None).cast("timestamp_ntz")))
    path = str(tmp_path / "obs")
    observations.write_observations(rows.filter("value < 1000 or datetime is null"), path)
    for _ in range(2):
        observations.write_observations(rows.filter("value >= 900 and datetime is not null").filter(F.col("datetime") >= ts_lit("2020-02-08")), path, "overwrite")
    days = observations.read_observations(spark, path, schema=rows.schema)
    assert days.columns == rows.columns
    few = observations.read_observations(spark, path, "2020-02-01", "2020-02-03 12:00:00", ["n3"], rows.schema)
    start = dt.datetime(2020, 1, 1)
    want = [i for i in range(1000) if i % 20 == 3 and dt.datetime(2020, 2, 1) <= start + dt.timedelta(hours=i) < dt.datetime(2020, 2, 3, 12)]
    assert sorted(r["value"] for r in few.collect()) == want
    assert scan_metric(few, "numFiles") <= 3 < scan_metric(days, "numFiles")
    assert days.filter("datetime is null").count() == 1
    late = sorted(r["value"] for r in days.filter(F.col("datetime") >= ts_lit("2020-02-08")).collect())
    assert late == [float(i) for i in range(2000) if start + dt.timedelta(hours=i) >= dt.datetime(2020, 2, 8)]
    with pytest.raises(ValueError):
        observations.write_observations(rows, path, "ignore")


# -- pages ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def dated(spark):
    rng = random.Random(9)
    rows = [(i, None if i % 50 == 0 else dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(300)), f"t{rng.randrange(9)}") for i in range(1200)]
    ordered = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or dt.datetime(2020, 1, 1)).timestamp(), r[2], r[0]))
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz, tie string").repartition(7), [r[0] for r in ordered]


@pytest.mark.parametrize(("offset", "limit"), [(0, 10), (5, None), (700, 300), (1100, 500), (2000, 10), (0, 1200), (1199, None)])
def test_pages_cut_from_ranges(dated, offset, limit):
    df, want = dated
    page = paging.cut(df, paging.newest_order("ts", ["tie", "id"]), offset, limit)
    assert [r["id"] for r in page.collect()] == want[offset : None if limit is None else offset + limit]
    assert page.columns == df.columns


def test_deep_pages_need_no_single_task(dated, monkeypatch):
    df, want = dated
    monkeypatch.setattr(paging, "TOP_ROWS", 100)
    for page in (paging.newest(df, "ts", ["tie", "id"], None, 5), paging.newest(df, "ts", ["tie", "id"], 400, 300)):
        text = plan(page)
        assert "SinglePartition" not in text and "CollectLimit" not in text and "GlobalLimit" not in text
    assert [r["id"] for r in paging.newest(df, "ts", ["tie", "id"], 400, 300).collect()] == want[300:700]


def test_pages_follow_each_other(dated):
    df, want = dated
    seen, last = [], None
    while True:
        page = paging.newest(df, "ts", ["tie", "id"], 250) if last is None else paging.newest_after(df, "ts", ["tie", "id"], last, 250)
        rows = page.collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        last = rows[-1].asDict()
    assert seen == want


# -- panels over a catalog --------------------------------------------------------------------------------


def test_one_plan_for_any_number_of_datasets(spark, tmp_path):
    def stored(names):
        root = str(tmp_path / f"root{len(names)}")
        rows = spark.range(100 * len(names)).selectExpr(
            f"concat('ds', id % {len(names)}) as dataset_name", "md5(cast(id as string)) as hash",
            "timestamp_ntz'2015-01-01' + make_dt_interval(cast(id % 90 as int), 0, 0, 0) as point_date", "0.5 as lon", "0.5 as lat",
        )
        rows.write.partitionBy("dataset_name").parquet(root)
        listed = [(n, i % 2 == 0, dt.datetime(2015, 1, 1), dt.datetime(2015, 1, 1), dt.datetime(2015, 4, 1)) for i, n in enumerate(names)]
        made = spark.createDataFrame(listed, "dataset_name string, approved_status boolean, date_added timestamp_ntz, obs_from timestamp_ntz, obs_to timestamp_ntz")
        return made, root

    sizes = []
    for n in (3, 30):
        listed, root = stored([f"ds{i}" for i in range(n)])
        panel = store.catalog_panel(listed, root, "month", "2015-01-10", "2015-03-20")
        sizes.append(len(panel._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        by_name = timeseries.timeseries_panel(store.open_datasets(listed, root), "month", "2015-01-10", "2015-03-20")
        assert sorted(panel.collect()) == sorted(by_name.select(panel.columns).collect())
        assert scan_metric(store.stored_points(listed, root, names=["ds2"]), "numFiles") < scan_metric(store.stored_points(listed, root, False), "numFiles")
    assert sizes[0] == sizes[1]
