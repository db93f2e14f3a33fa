"""Time buckets and dense bucket series on zone-free timestamps."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"

# Text form of timestamps in exports; Spark's default drops microseconds.
TEXT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TEXT_OPTIONS = {"timestampFormat": TEXT_FORMAT, "timestampNTZFormat": TEXT_FORMAT}
JSON_OPTIONS = {**TEXT_OPTIONS, "ignoreNullFields": "false"}
CSV_OPTIONS = {**TEXT_OPTIONS, "header": "true", "quote": '"', "escape": '"'}
DATE_UNITS = ("day", "week", "month", "quarter", "year")
CLOCK_UNITS = ("minute", "hour")
UNITS = CLOCK_UNITS + DATE_UNITS

_STEP = {
    "minute": "INTERVAL '1' MINUTE",
    "hour": "INTERVAL '1' HOUR",
    "day": "INTERVAL '1' DAY",
    "week": "INTERVAL '7' DAY",
    "month": "INTERVAL '1' MONTH",
    "quarter": "INTERVAL '3' MONTH",
    "year": "INTERVAL '1' YEAR",
}

_SECONDS = {
    "minute": 60, "hour": 3600, "day": 86400, "week": 604800,
    "month": 28 * 86400, "quarter": 90 * 86400, "year": 365 * 86400,
}


def instant(value: str | date | datetime) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value.replace(tzinfo=None)


def ts_lit(value: str | date | datetime) -> Column:
    return F.lit(instant(value).isoformat(sep=" ")).cast(NTZ)


def check_unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unknown time unit {unit!r}, use one of {', '.join(UNITS)}")
    return unit


def bucket(ts: Column, unit: str) -> Column:
    """Start of the bucket `ts` falls into; weeks start on Monday.

    Goes through the date instead of `date_trunc`, whose result depends on the session zone.
    """
    day = F.to_date(ts)
    if check_unit(unit) == "day":
        return day.cast(NTZ)
    if unit in DATE_UNITS:
        return F.trunc(day, unit).cast(NTZ)
    zero = F.lit(0)
    minutes = F.minute(ts) if unit == "minute" else zero
    return day.cast(NTZ) + F.make_dt_interval(zero, F.hour(ts), minutes, F.lit(0))


def bucket_count(unit: str, start, end) -> int:
    """Upper bound of the number of buckets in a range, known before anything runs."""
    return int((instant(end) - instant(start)).total_seconds() // _SECONDS[check_unit(unit)]) + 2


def step(unit: str) -> Column:
    return F.expr(_STEP[check_unit(unit)])


def spine(spark: SparkSession, unit: str, start, end) -> DataFrame:
    """Every bucket from the one holding `start` to the one holding `end`, as `time_bucket`."""
    series = F.sequence(bucket(ts_lit(start), unit), bucket(ts_lit(end), unit), step(unit))
    return spark.range(1).select(F.explode(series).alias("time_bucket"))


def recent(now: datetime | None = None, **span: float) -> tuple[datetime, datetime]:
    """The time up to `now`, by default as far back as point and observation queries look: 90 days.

    Other usual spans: days=1 for node aggregates, days=7 for downloads, minutes=30 for triggers.
    """
    end = now or datetime.now(timezone.utc).replace(tzinfo=None)
    return end - timedelta(**(span or {"days": 90})), end


def month_bounds(value: str | date | datetime) -> tuple[datetime, datetime]:
    """First of the month and first of the next one."""
    first = instant(value).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    following = first.replace(year=first.year + first.month // 12, month=first.month % 12 + 1)
    return first, following


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, independent of the session zone."""
    day_part = F.unix_date(F.to_date(ts)).cast("long") * F.lit(86_400_000_000)
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * F.lit(1_000_000)
    return day_part + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
