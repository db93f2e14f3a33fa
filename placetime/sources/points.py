"""CSV point files: header, column types, typed scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placetime.functions.text import NUMBER, slugs

# Texts that stand for a missing value, and for true and false.
NULL_WORDS = ("na", "n/a", "none", "null", ".", "", " ")
TRUE_WORDS = ("yes", "y", "true", "t")
FALSE_WORDS = ("no", "n", "false", "f")

WHOLE = r"^[+-]?\d+$"
REAL = NUMBER + r"|^[+-]?(?i)(nan|inf|infinity)$"
DAY = r"\d{4}-\d{1,2}-\d{1,2}"
DAY_PATTERN = rf"^{DAY}$"
INSTANT_PATTERN = rf"^{DAY}[ T]\d{{1,2}}:\d{{2}}(:\d{{2}}(\.\d{{1,6}})?)?$"
AMPM_PATTERN = rf"^{DAY} \d{{1,2}}:\d{{2}}(:\d{{2}})? ?[AaPp][Mm]$"
WRITTEN_DAY_PATTERN = r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"
TIME_PATTERN = r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?$"

@dataclass(frozen=True)
class PointRoles:
    """Which columns say when and where: a date, and either two coordinates or one text."""

    date: str | None = None
    lat: str | None = None
    lon: str | None = None
    location: str | None = None

    def __post_init__(self) -> None:
        if not self.location and not (self.lat and self.lon):
            raise ValueError("give a location column, or both latitude and longitude")


def read_raw(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """CSV as text columns under slugged names; a malformed row fails the load.

    `multi_line` allows line breaks inside quotes, at the price of one task per file.
    """
    raw = spark.read.csv(path, header=True, mode="FAILFAST", quote='"', escape='"', multiLine=multi_line)
    return raw.toDF(*slugs(raw.columns))


def cleaned(column: Column) -> Column:
    """Null words become nulls."""
    return F.when(~F.lower(column).isin(*NULL_WORDS), column)


# Patterns decide before anything is parsed, since a failed parse costs an exception per row.


def _iso(text: Column) -> Column:
    """Text that starts like a day, with slashed days as year-month-day; null for other text."""
    day = F.regexp_replace(F.trim(text), r"(\d)Z$", "$1")
    slashed = F.when(day.rlike(r"^\d{4}"), F.regexp_replace(day, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")).otherwise(
        F.regexp_replace(day, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    )
    return F.when(text.rlike(r"^\s*(\d{4}-\d|[A-Za-z]{3,9} \d)"), day).when(text.rlike(r"^\s*\d{1,4}/\d{1,2}/\d"), slashed)


def _date(iso: Column) -> Column:
    # Three letters are a short month name (May is both).
    written = F.when(iso.rlike(r"^[A-Za-z]{3} "), F.try_to_timestamp(iso, F.lit("MMM d, yyyy"))).otherwise(
        F.try_to_timestamp(iso, F.lit("MMMM d, yyyy"))
    )
    return F.when(iso.rlike(DAY_PATTERN), iso.try_cast("date")).when(iso.rlike(WRITTEN_DAY_PATTERN), F.to_date(written))


def _timestamp(iso: Column) -> Column:
    spaced = F.upper(F.regexp_replace(iso, r" ?([AaPp][Mm])$", " $1"))
    seconds = iso.rlike(r":\d{2}:\d{2}")
    clock = F.when(seconds, F.try_to_timestamp(spaced, F.lit("y-M-d h:mm:ss a"))).otherwise(
        F.try_to_timestamp(spaced, F.lit("y-M-d h:mm a"))
    )
    return F.when(iso.rlike(INSTANT_PATTERN), iso.try_cast("timestamp_ntz")).when(
        iso.rlike(AMPM_PATTERN), clock.cast("timestamp_ntz")
    )


def parse_instant(text: Column) -> Column:
    """A timestamp from any of the known date or timestamp layouts."""
    iso = _iso(text)
    return F.coalesce(_timestamp(iso), _date(iso).cast("timestamp_ntz"))


# A value's kind is one bit; the kinds a column holds decide about its type.
_KINDS = ("missing", "boolean", "int", "bigint", "double", "date", "time", "timestamp_ntz", "string")
_BIT = {kind: 1 << i for i, kind in enumerate(_KINDS)}
# Types in order of preference, with the kinds they can hold.
_HOLDS = {
    "boolean": ("boolean",),
    "int": ("missing", "int"),
    "bigint": ("missing", "int", "bigint"),
    "double": ("missing", "int", "bigint", "double"),
    "date": ("missing", "date"),
    "time": ("missing", "time"),
    "timestamp_ntz": ("missing", "date", "timestamp_ntz"),
}


def _kind(text: Column, digits: Column, iso: Column) -> Column:
    """The narrowest kind of a value. Branches go from cheap to dear and stop at the first hit."""
    bit = lambda kind: F.lit(_BIT[kind])
    return (
        F.when(text.isNull(), bit("missing"))
        .when(F.lower(text).isin(*TRUE_WORDS, *FALSE_WORDS), bit("boolean"))
        .when(digits.rlike(r"^0\d*[1-9]\d*$"), bit("string"))
        .when(
            digits.rlike(WHOLE),
            F.when(digits.try_cast("int").isNotNull(), bit("int"))
            .when(digits.try_cast("bigint").isNotNull(), bit("bigint"))
            .otherwise(bit("double")),
        )
        .when(digits.rlike(REAL), bit("double"))
        .when(iso.isNull(), F.when(text.rlike(TIME_PATTERN), bit("time")).otherwise(bit("string")))
        .when(_date(iso).isNotNull(), bit("date"))
        .when(_timestamp(iso).isNotNull(), bit("timestamp_ntz"))
        .otherwise(bit("string"))
    )


def infer_schema(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, field_name, field_type, has_nulls) found from all values in one pass.

    Columns are laid out as rows, so that any number of them needs only one expression; a value
    contributes one bit, and tasks hand on one integer per column. A boolean column may not hold
    nulls, and zero-padded numbers are text.
    """
    names = list(columns or raw.columns)
    cells = raw.select(F.posexplode(F.array(*[F.col(f"`{n}`").cast("string") for n in names])).alias("place", "value"))
    texts = cells.select("place", cleaned(F.col("value")).alias("t"))
    pieces = texts.select("*", F.trim(F.replace("t", F.lit(","), F.lit(""))).alias("d"), _iso(F.col("t")).alias("i"))
    kinds = pieces.groupBy("place").agg(F.bit_or(_kind(F.col("t"), F.col("d"), F.col("i"))).alias("kinds"))
    listed = raw.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("place", "field_name"))
    held = F.coalesce("kinds", F.lit(0))
    choice = F.lit("string")
    for kind, allowed in reversed(_HOLDS.items()):
        others = ~sum(_BIT[k] for k in allowed)
        choice = F.when(held.bitwiseAND(F.lit(others)) == 0, F.lit(kind)).otherwise(choice)
    return listed.join(kinds, "place", "left").select(
        (F.col("place") + 1).alias("position"),
        "field_name",
        choice.alias("field_type"),
        (held.bitwiseAND(F.lit(_BIT["missing"])) != 0).alias("has_nulls"),
    )


def typed(column: Column, kind: str) -> Column:
    """Text converted to a type; a value that does not fit fails the load. Times of day stay text."""
    text = cleaned(column)
    word = F.lower(text)
    parsed = {
        "boolean": F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False)),
        "date": _date(_iso(text)),
        "timestamp_ntz": parse_instant(text),
    }
    if kind in ("int", "bigint", "double"):
        digits = F.trim(F.replace(text, F.lit(","), F.lit("")))
        value = F.when(digits.rlike(REAL if kind == "double" else WHOLE), digits.try_cast(kind))
    elif kind in parsed:
        value = parsed[kind]
    else:
        return text
    problem = F.raise_error(F.concat(F.lit(f"not a {kind}: "), text))
    return F.when(text.isNotNull() & value.isNull(), problem).otherwise(value)


def apply_types(raw: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return raw.select(*[typed(F.col(f"`{c}`"), types.get(c, "string")).alias(c) for c in raw.columns])


def read_points(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """A typed scan. With `schema` Spark's reader does the typing and fails on bad rows; with
    `types` (name to type) or nothing the columns are converted from text, in the latter case
    after inference, whose result (one row per column) is all that comes to the driver."""
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", quote='"', escape='"', enforceSchema=True)
    raw = read_raw(spark, path)
    if types is None:
        types = {row["field_name"]: row["field_type"] for row in infer_schema(raw).collect()}
    return apply_types(raw, types)
