"""Streams over the driver's tables, whose rows arrive in several batches, late and repeated ones among them.

Each batch of files is put into a folder, and the stream is started again from its checkpoint, so what it
knows of earlier batches is the state that it has stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from placetime.plans.derived import derive, duck
from placetime.plans.registry import query
from placetime.plans.weather_queries import _METAR_SQL
from placetime.session import scratch_path
from placetime.sources.keyed import KeyedTable
from placetime.streaming import jobs

# Rows arrive in three batches by event time, cut at two instants. One row in ten of the first batch is
# held back until the third: long after the watermark has passed it.
FIRST, SECOND = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def _held_back(key: str, ts: str = "TIMESTAMP") -> str:
    return f"({key} % 10 = 3 AND datetime < {ts} '{FIRST}' - INTERVAL '1' DAY)"


def _batches(rows, key: str):
    """Three batches of rows with a `datetime`; the second one repeats the last hour of the first."""
    late = F.expr(_held_back(key, "TIMESTAMP_NTZ"))
    first, second = (F.expr(f"TIMESTAMP_NTZ '{at}'") for at in (FIRST, SECOND))
    when = F.col("datetime")
    early = rows.filter((when < first) & ~late)
    return [
        early,
        rows.filter((when >= first) & (when < second)).unionByName(early.filter(when >= first - F.expr("INTERVAL '1' HOUR"))),
        rows.filter((when >= second) | late),
    ]


def _replayed(spark, batches, run) -> None:
    """Calls `run` with the stream of all files so far, once per batch."""
    source = scratch_path(spark, "stream-in")
    for batch in batches:
        batch.write.mode("append").parquet(source)
        run(jobs.stream_files(spark, source, batch.schema))


def _finished(spark, batches, build, name: str, mode: str = "append"):
    path, checkpoint = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-checkpoint")
    _replayed(spark, batches, lambda stream: jobs.run_available(build(stream), path, checkpoint, mode))
    return spark.read.parquet(path)


def _dated_reports(spark, sf):
    """METAR lines with the instant that they tell, worked out from the keys that they were made of."""
    day = "event_id % 28"
    instant = (
        f"CAST(date_trunc('MONTH', received) AS TIMESTAMP_NTZ) - make_ym_interval(0, CASE WHEN {day} + 1 > day(received) THEN 1 ELSE 0 END)"
        f" + make_dt_interval(CAST({day} AS INT), CAST(event_id % 24 AS INT), CAST(event_id % 60 AS INT), 0)"
    )
    return derive(spark, sf, "metar_lines", heavy=True).withColumn("datetime", F.expr(instant))


@query("stream_metar", f"WITH {_METAR_SQL} SELECT DISTINCT wban_code, datetime FROM decoded WHERE NOT {_held_back('event_id')}")
def stream_metar(spark, sf):
    """Repeated reports are known from the state, late ones are left out."""
    signs = derive(spark, sf, "call_signs")
    batches = _batches(_dated_reports(spark, sf), "event_id")
    done = _finished(spark, batches, lambda s: jobs.stream_metar(s.drop("datetime"), signs), "metar")
    return done.select("wban_code", F.col("datetime").cast("timestamp_ntz").alias("datetime"))


@query(
    "stream_node_agg",
    duck("event_obs")
    + f", hours AS (SELECT node_id, CAST(date_trunc('hour', datetime) AS TIMESTAMP) AS time_bucket, round(avg(value), 6) AS value,"
    f" count(value) AS value_count FROM event_obs WHERE NOT {_held_back('meta_id')} GROUP BY 1, 2)"
    " SELECT * FROM hours WHERE time_bucket + INTERVAL 3 HOUR <= (SELECT max(datetime) FROM event_obs)",
)
def stream_node_agg(spark, sf):
    """Windows that the watermark has closed, late rows left out; the newest windows stay open.

    Nothing is repeated here, as an aggregate would count it twice.
    """
    first, second, third = _batches(derive(spark, sf, "event_obs"), "meta_id")
    second = second.filter(F.col("datetime") >= F.expr(f"TIMESTAMP_NTZ '{FIRST}'"))
    done = _finished(spark, [first, second, third], lambda s: jobs.stream_node_aggregate(s, properties=["value"]), "node-agg")
    return done.select("node_id", F.col("time_bucket").cast("timestamp_ntz").alias("time_bucket"), F.round("value", 6).alias("value"), "value_count")


@query("stream_threshold", duck("event_obs") + "SELECT node_id, datetime, value FROM event_obs WHERE value > 100")
def stream_threshold(spark, sf):
    """Without state nothing is late; nothing is repeated here either."""
    obs = derive(spark, sf, "event_obs")
    halves = [obs.filter("meta_id % 2 = 0"), obs.filter("meta_id % 2 = 1")]
    done = _finished(spark, halves, lambda s: jobs.stream_threshold(s, "value", "gt", 100), "threshold")
    return done.select("node_id", "datetime", "value")


@query(
    "stream_merge",
    duck("event_obs")
    + "SELECT node_id, CAST(date_trunc('hour', datetime) AS TIMESTAMP) AS hour, 1 AS n,"
    f" bool_or(datetime < TIMESTAMP '{FIRST}' AND NOT {_held_back('meta_id')}) AS early FROM event_obs GROUP BY 1, 2",
)
def stream_merge(spark, sf):
    """Batches merged into a stored table, keys of earlier batches staying as they are; then all batches once more."""
    obs = derive(spark, sf, "event_obs")
    table = KeyedTable(spark, f"stream_merge_{uuid.uuid4().hex}", ("node_id", "hour"), buckets=8)
    path = scratch_path(spark, "merged")
    hours = [
        part.select("node_id", F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("hour"), F.lit(at == 0).alias("early"))
        for at, part in enumerate(_batches(obs, "meta_id"))
    ]
    for _ in range(2):
        checkpoint = scratch_path(spark, "merge-checkpoint")
        _replayed(spark, hours, lambda stream: jobs.merge_available(stream, table, checkpoint, path))
    return table.rows().groupBy("node_id", "hour").agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_or("early").alias("early"))


_TRIGGERS = (("event.value", "ge", 60), ("event.level", "gt", 90), ("ship.price", "lt", 1200))
_SHIP_LIKE = "datetime + INTERVAL '336' MONTH"


@query(
    "stream_trigger",
    duck("event_obs", "ship_obs")
    + ", readings AS (SELECT node_id, datetime, 'event.value' AS property, value FROM event_obs WHERE value >= 60"
    " UNION ALL SELECT node_id, datetime, 'event.level', level FROM event_obs WHERE level > 90"
    f" UNION ALL SELECT node_id, {_SHIP_LIKE}, 'ship.price', price FROM ship_obs WHERE price < 1200),"
    " latest AS (SELECT *, max(datetime) OVER (PARTITION BY node_id) AS as_of FROM readings)"
    " SELECT node_id, as_of, property, datetime, value, row_number() OVER (PARTITION BY node_id ORDER BY datetime DESC, property, value) AS place"
    " FROM latest WHERE datetime > as_of - INTERVAL 2 DAY QUALIFY place <= 5",
)
def stream_trigger(spark, sf):
    """Two features and three conditions over two batches; what each node's list is after the last one.

    Readings are far apart here, so a list reaches back two days and holds five.
    """
    events = derive(spark, sf, "event_obs").withColumn("price", F.lit(None).cast("double"))
    ships = derive(spark, sf, "ship_obs").withColumn("datetime", F.expr(_SHIP_LIKE))
    whole = events.select(F.lit("event").alias("feature"), "node_id", "datetime", "value", "level", "price").unionByName(
        ships.select(F.lit("ship").alias("feature"), "node_id", "datetime", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("level"), "price")
    )
    halves = [whole.filter(F.pmod(F.xxhash64("datetime"), F.lit(2)) == part) for part in (0, 1)]

    def build(stream):
        both = {name: stream.filter(F.col("feature") == name) for name in ("event", "ship")}
        return jobs.stream_trigger(both, _TRIGGERS, keep=5, span="2 days")

    lists = _finished(spark, halves, build, "trigger", "update").withColumnRenamed("batch", "run")
    last = lists.groupBy("node_id").agg(F.max("run").alias("run"))
    shown = lists.join(last, ["node_id", "run"])
    return shown.select(
        "node_id", F.col("as_of").cast("timestamp_ntz").alias("as_of"), "property", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "value", "place"
    )
