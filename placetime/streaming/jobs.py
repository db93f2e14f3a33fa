"""Continuous METAR loading, windowed node aggregates, threshold triggers, merges into stored tables.

Each function takes a streaming DataFrame and returns one; `run_available` writes a stream to
parquet until its input is used up, `merge_available` into a keyed table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from placetime.functions import metar
from placetime.operators.observations import exceeding, numeric_properties
from placetime.operators.weather import station_numbers
from placetime.sources.keyed import KeyedTable

METAR_DELAY = "2 hours"

# What a trigger hands out, and how far back it looks.
TRIGGER_ROWS = 50
TRIGGER_SPAN = "30 minutes"


def zoned(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return df if isinstance(df.schema[ts].dataType, T.TimestampType) else df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder, oldest first, at most `per_batch` of them in a micro-batch."""
    reader = spark.readStream.schema(schema)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def stream_metar(reports: DataFrame, call_signs: DataFrame, delay: str = METAR_DELAY) -> DataFrame:
    """Decoded reports, one per station and time; state is dropped `delay` after the event time."""
    decoded = metar.decode(reports)
    numbered = decoded.join(station_numbers(call_signs), "call_sign").select("wban_code", *decoded.columns)
    return zoned(numbered, "datetime").withWatermark("datetime", delay).dropDuplicatesWithinWatermark(["wban_code", "datetime"])


def stream_node_aggregate(obs: DataFrame, window: str = "1 hour", delay: str = METAR_DELAY, properties: Sequence[str] | None = None) -> DataFrame:
    """(node_id, time_bucket, mean and count per property), emitted once a window is over."""
    names = numeric_properties(obs, properties)
    columns = [c for n in names for c in (F.avg(n).alias(n), F.count(n).alias(f"{n}_count"))]
    return (
        zoned(obs, "datetime")
        .withWatermark("datetime", delay)
        .groupBy(F.window("datetime", window), "node_id")
        .agg(*columns)
        .select("node_id", F.col("window.start").alias("time_bucket"), *names, *[f"{n}_count" for n in names])
    )


def stream_threshold(obs: DataFrame, prop: str, op: str, value) -> DataFrame:
    """Observations whose property passes a comparison; keeps no state."""
    return exceeding(obs, prop, op, value)


class _Newest(StatefulProcessor):
    """Per node the newest readings of the last `span` seconds, at most `keep` of them, as state.

    A list is handed out whenever a batch brings readings of its node. Newest first; readings of the same
    instant by property, then by value. Memory holds `keep` readings, whatever a batch brings.
    """

    STATE = "datetime timestamp, property string, value double"

    def __init__(self, keep: int, span: float):
        self.keep, self.span = keep, pd.Timedelta(seconds=span)

    def init(self, handle) -> None:
        self.readings = handle.getListState("readings", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [(pd.Timestamp(r[0]), r[1], r[2]) for r in self.readings.get()]
        for batch in rows:
            new = zip(batch["datetime"], batch["property"], batch["value"])
            kept = heapq.nsmallest(self.keep, [*kept, *new], key=lambda r: (-r[0].value, r[1], r[2]))
        since = kept[0][0] - self.span
        kept = [r for r in kept if r[0] > since]
        self.readings.put([(when.to_pydatetime(), name, value) for when, name, value in kept])
        yield pd.DataFrame(
            {
                "node_id": key[0], "as_of": kept[0][0], "place": range(1, len(kept) + 1),
                "property": [r[1] for r in kept], "datetime": [r[0] for r in kept], "value": [r[2] for r in kept],
            }
        )

    def close(self) -> None:
        pass


TRIGGERED = "node_id string, as_of timestamp, place long, property string, datetime timestamp, value double"


def stream_trigger(
    by_feature: Mapping[str, DataFrame], conditions: Sequence[tuple[str, str, object]], keep: int = TRIGGER_ROWS, span: str = TRIGGER_SPAN
) -> DataFrame:
    """(node_id, as_of, place, property, datetime, value): a node's newest readings that pass, each time there are new ones.

    `conditions` are (feature.property, operator, value); readings of several features go into one list
    per node. `as_of` is the node's newest passing reading: the list reaches back `span` from it and has
    `keep` rows at most. That list is all the state there is.
    """
    parts = []
    for name, op, value in conditions:
        feature, prop = name.split(".", 1)
        passing = zoned(exceeding(by_feature[feature], prop, op, value), "datetime")
        parts.append(passing.select("node_id", "datetime", F.lit(name).alias("property"), F.col(f"`{prop}`").cast("double").alias("value")))
    readings = reduce(DataFrame.unionByName, parts).filter(F.col("node_id").isNotNull() & F.col("datetime").isNotNull())
    newest = _Newest(keep, pd.Timedelta(span).total_seconds())
    return readings.groupBy("node_id").transformWithStateInPandas(newest, TRIGGERED, "Update", "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; a restart with the same checkpoint goes on where it ended.

    State lies in RocksDB, so it may outgrow the executors' memory.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        if mode == "append":
            writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        else:
            # Only appended rows can go straight to files; of updates each batch is written into a folder of its own.
            writer = stream.writeStream.outputMode(mode).foreachBatch(
                lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
            )
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def merge_available(stream: DataFrame, table: KeyedTable, checkpoint: str, path: str | None = None) -> None:
    """Merges a stream into a stored table, one micro-batch after the other: keys already stored stay as they are.

    A batch that is run again after a crash finds its keys stored, so each row counts once.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, _: table.add(rows, path))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
