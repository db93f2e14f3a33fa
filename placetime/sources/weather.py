"""Weather station files as landed: monthly daily and hourly reports, stations, call signs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.operators.weather import ARRIVAL, clean_daily, clean_hourly, clean_stations, time_column, weather_upsert
from placetime.plans.sizing import settled

# Fixed value: from this month on reports come in the newer layout.
NEW_LAYOUT_FROM = date(2007, 5, 1)


def month_archive(year: int, month: int) -> str:
    """Name of a month's archive; the layout changed in May 2007."""
    old = date(year, month, 1) < NEW_LAYOUT_FROM
    return f"{year}{month:02d}.tar.gz" if old else f"QCLCD{year}{month:02d}.zip"


def report_file(year: int, month: int, span: str) -> str:
    """Name of the extracted file for `span`, daily or hourly."""
    if span not in ("daily", "hourly"):
        raise ValueError(f"unknown span {span!r}")
    return f"{year}{month:02d}{span}.txt"


def months_to_load(today: date | datetime, weeks_back: int = 1) -> list[tuple[int, int]]:
    """This month, preceded by last month if it ended less than a week ago."""
    months = [(today - timedelta(days=7 * weeks_back)), today]
    return list(dict.fromkeys((d.year, d.month) for d in months))


def read_reports(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Reports as text columns under their own header names, and `source_file`."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, quote='"', escape='"')
    return raw.toDF(*[c.strip() for c in raw.columns]).withColumn("source_file", F.input_file_name())


SPANS = {"daily": clean_daily, "hourly": clean_hourly}


def read_span(spark: SparkSession, paths: Sequence[str], span: str, **stations: Sequence[str] | None) -> DataFrame:
    """Cleaned reports of files in either layout; `only` and `without` are station numbers.

    A file's own header tells its layout, not its name. Files with the same header are one scan.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = spark.read.csv(path, header=True, schema=None, inferSchema=False).columns
        by_header.setdefault(tuple(header), []).append(path)
    parts = [SPANS[span](read_reports(spark, same), **stations) for same in by_header.values()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def stored_reports(spark: SparkSession, store: str, schema: T.StructType | None = None) -> DataFrame:
    """All reports of a store, with their `month` as yyyy-MM; no rows if nothing was loaded yet."""
    if schema is None:
        return spark.read.parquet(store)
    try:
        return spark.read.schema(schema).parquet(store)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_months(
    spark: SparkSession,
    landing: str,
    store: str,
    span: str,
    months: Sequence[tuple[int, int]],
    only: Sequence[str] | None = None,
    without: Sequence[str] | None = None,
) -> list[str]:
    """Loads the `span` files of some months below `landing` into `store`; gives the months it touched.

    A store has a folder per month of the reports. Reports already stored stay as they are; of the others the
    largest row of a station and time is added. The months that the files hold are read, put together and
    written anew as whole folders, so a load that is repeated, or died and is run again, ends with
    the same rows, each once. Other months are neither read nor written.
    """
    paths = [f"{landing.rstrip('/')}/{report_file(year, month, span)}" for year, month in months]
    reports = read_span(spark, paths, span, only=only, without=without)
    dated = reports.filter(F.col(time_column(reports)).isNotNull())
    incoming = settled(dated.withColumn("month", F.date_format(time_column(reports), "yyyy-MM")), "reports")
    touched = sorted(row["month"] for row in incoming.select("month").distinct().collect())
    if not touched:
        return []
    stored = stored_reports(spark, store, incoming.schema).filter(F.col("month").isin(touched))
    # What is read can't be overwritten, so the folders are made aside first.
    whole = settled(weather_upsert(stored.select(*incoming.columns), incoming), "months")
    gathered = whole.hint("rebalance", "month").sortWithinPartitions("month", "wban_code", time_column(reports))
    writer = gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month").parquet(store)
    return touched


def update_weather(spark: SparkSession, landing: str, store: str, today: date | datetime, **stations: Sequence[str] | None) -> dict[str, list[str]]:
    """The regular load: this month, and last month as well if it ended less than a week ago; both spans."""
    months = months_to_load(today)
    return {span: load_months(spark, landing, f"{store.rstrip('/')}/{span}", span, months, **stations) for span in SPANS}


def read_stations(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The station history file, cleaned; the first line of each station counts.

    Lines are ordered by file, by the split of the file they were read from, and within it.
    """
    names = "usaf wban_code station_name country state icao lat lon elevation begin end".split()
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', enforceSchema=True)
    split = ("_metadata.file_path", "_metadata.file_block_start")
    arrival = F.struct(*split, F.monotonically_increasing_id().alias("line"))
    return clean_stations(raw.select("*", arrival.alias(ARRIVAL)))


def read_call_signs(spark: SparkSession, path: str) -> DataFrame:
    """(call_sign, wban_code) from a two-column file with a header, station number first."""
    raw = spark.read.csv(path, header=True, schema="wban_code string, call_sign string", enforceSchema=True)
    return raw.select("call_sign", "wban_code").filter(F.col("call_sign").isNotNull())
