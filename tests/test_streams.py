"""Streams over several batches: late and repeated rows, restarts, merges, bounded state."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from placetime.sources.keyed import KeyedTable
from placetime.streaming import jobs

START = dt.datetime(2020, 1, 1)
OBS = "node_id string, datetime timestamp_ntz, meta_id double, sensor string, v double"


class Feed:
    """A folder to which batches are added, and a stream that is run after each from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def run(self, rows, build, mode="append", schema=OBS):
        df = self.spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        stream = jobs.stream_files(self.spark, str(self.folder / "in"), df.schema)
        jobs.run_available(build(stream), str(self.folder / "out"), str(self.folder / "cp"), mode)

    def out(self):
        return self.spark.read.parquet(str(self.folder / "out"))


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def obs(*readings, node="a"):
    return [(node, at(m), float(m), "s", float(v)) for m, v in readings]


def test_late_rows_do_not_reopen_a_window(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    build = lambda s: jobs.stream_node_aggregate(s, "1 hour", "30 minutes", ["v"])
    feed.run(obs((5, 1), (10, 3), (100, 5)), build)
    feed.run(obs((50, 9), (70, 7)), build)  # the first window is closed, the second isn't
    feed.run(obs((400, 0)), build)
    rows = {r["time_bucket"].replace(tzinfo=None): (r["v"], r["v_count"]) for r in feed.out().collect()}
    assert rows == {START: (2.0, 2), at(60): (6.0, 2)}


def test_repeated_rows_are_known_from_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    line = "METAR KABC 0{d}{h:02}{m:02}Z 27005KT 10SM CLR 10/05 A3000"
    signs = spark.createDataFrame([("KABC", "00001")], "call_sign string, wban_code string")
    report = lambda h, m=0: (line.format(d=5, h=h, m=m), dt.datetime(2020, 1, 5, h, m))
    build = lambda s: jobs.stream_metar(s, signs)
    schema = "report string, received timestamp_ntz"
    feed.run([report(8), report(9), report(9)], build, schema=schema)
    feed.run([report(9), report(10), report(5)], build, schema=schema)  # a repeated one, a new one, one that is late
    feed.run([report(9, 30), report(10)], build, schema=schema)
    hours = sorted((r["datetime"].hour, r["datetime"].minute) for r in feed.out().collect())
    assert hours == [(8, 0), (9, 0), (9, 30), (10, 0)]


def test_files_arrive_a_few_at_a_time(spark, tmp_path):
    for k in range(4):
        rows = spark.createDataFrame(obs((k, k)), OBS)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), rows.schema, per_batch=1)
    jobs.run_available(stream.groupBy("node_id").agg(F.count("v").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    counts = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
    assert [(r["batch"], r["n"]) for r in counts] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_batches_merge_into_a_stored_table(spark, tmp_path):
    table = KeyedTable(spark, f"merged_{uuid.uuid4().hex}", ("node_id", "datetime"), buckets=2)
    try:
        for at_, rows in enumerate([obs((1, 1), (2, 2), (2, 2)), obs((2, 7), (3, 3))]):
            spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = jobs.stream_files(spark, str(tmp_path / "in"), spark.createDataFrame(rows, OBS).schema)
            jobs.merge_available(stream, table, str(tmp_path / "cp"), str(tmp_path / "table"))
        jobs.merge_available(stream, table, str(tmp_path / "cp-lost"))  # all batches again
        assert sorted(r["v"] for r in table.rows().collect()) == [1.0, 2.0, 3.0]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")


@pytest.mark.parametrize("keep", [3, 50])
def test_trigger_lists_follow_the_newest_readings(spark, tmp_path, keep):
    rng = random.Random(keep)
    feed = Feed(spark, tmp_path)
    schema = "feature string, " + OBS + ", w double"
    conditions = [("one.v", "gt", 2), ("two.w", "le", 5), ("one.w", "eq", 1)]

    def build(stream):
        return jobs.stream_trigger({n: stream.filter(F.col("feature") == n) for n in ("one", "two")}, conditions, keep, "30 minutes")

    seen, lists = [], {}
    for batch in range(3):
        rows = [
            (rng.choice(["one", "two"]), rng.choice(["a", "b"]), at(rng.randrange(40) + 15 * batch), 0.0, "s", float(rng.randrange(6)), float(rng.randrange(8)))
            for _ in range(40)
        ]
        feed.run(rows, build, "update", schema)
        for feature, node, when, _, _, v, w in rows:
            seen += [(node, when, "one.v", v)] * (feature == "one" and v > 2) + [(node, when, "two.w", w)] * (feature == "two" and w <= 5)
            seen += [(node, when, "one.w", w)] * (feature == "one" and w == 1)
        got = feed.out().filter(F.col("batch") == batch).collect()
        for node in {r["node_id"] for r in got}:
            own = sorted((r for r in seen if r[0] == node), key=lambda r: (-(r[1] - START).total_seconds(), r[2], r[3]))
            since = own[0][1] - dt.timedelta(minutes=30)
            lists[node] = [(when, name, value) for _, when, name, value in own if when > since][:keep]
            mine = sorted((r for r in got if r["node_id"] == node), key=lambda r: r["place"])
            assert [(r["datetime"].replace(tzinfo=None), r["property"], r["value"]) for r in mine] == lists[node]
            assert {r["as_of"].replace(tzinfo=None) for r in mine} == {own[0][1]}
    assert set(lists) == {"a", "b"}
