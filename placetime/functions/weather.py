"""Cleaning of weather station reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placetime.functions.text import NUMBER, strict_double

# Marks for a missing number, traces of precipitation, compass points, codes.
MISSING = ("M", "-", "err", "null", "")
TRACE = "T"
TRACE_INCHES = 0.005
VARIABLE_MARKS = ("VR", "M", "VRB")
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
DESCRIPTORS = ("MI", "PR", "BC", "DR", "BL", "SH", "TS", "FZ")
PRECIPITATION = ("DZ", "RA", "SN", "SG", "IC", "PE", "PL", "GR", "GS", "UP")
OBSCURATION = ("BR", r"FG\+", "FG", "FU", "VA", "DU", "SA", "HZ", "PY")
OTHER = ("PO", "SQ", "FC", r"\+FC", "SS", "DS", "GL")

PRESENT_WEATHER = (
    rf"^([-+])?(VC)?({'|'.join(DESCRIPTORS)})?((?:{'|'.join(PRECIPITATION)})*)"
    rf"({'|'.join(OBSCURATION)})?({'|'.join(OTHER)})?.*$"
)


def number(text: Column) -> Column:
    value = F.trim(text)
    return F.when(~value.isin(*MISSING) & value.rlike(NUMBER), value.try_cast("double"))


def whole(text: Column) -> Column:
    value = F.trim(text)
    return F.when(~value.isin(*MISSING, "VRB") & value.rlike(r"^[+-]?\d+$"), value.try_cast("int"))


def temperature(text: Column) -> Column:
    """A trailing star marks an extreme and is dropped."""
    return number(F.regexp_replace(text, r"\*$", ""))


def precipitation(text: Column) -> Column:
    return F.when(F.trim(text) == TRACE, F.lit(TRACE_INCHES)).otherwise(number(text))


def cardinal(degrees: Column) -> Column:
    """Degrees to one of sixteen compass points."""
    points = F.array(*[F.lit(p) for p in COMPASS])
    # Truncation, not floor: a negative angle rounds towards zero before the remainder.
    sector = (degrees.cast("double") / 22.5 + 0.5).cast("int")
    # element_at takes a missing index for the last place where the array holds no nulls.
    return F.when(degrees.isNotNull(), F.element_at(points, F.pmod(sector, F.lit(16)) + 1))


def wind(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Direction (rounded degrees or VRB, as text) and compass point; both null in a calm."""
    mark = F.trim(direction)
    variable = mark.isin(*VARIABLE_MARKS)
    degrees = F.rint(strict_double(mark)).cast("int")
    calm = F.coalesce(speed == 0, F.lit(False))
    known = ~calm & ~mark.isin("", "-")
    text = F.when(known & variable, F.lit("VRB")).when(known, degrees.cast("string"))
    point = F.when(known & variable, F.lit("VRB")).when(known, cardinal(degrees))
    return text, point


def groups(text: Column, pattern: str, *wanted: int) -> Column:
    """Several groups of one anchored pattern as an array, at the price of one match."""
    return F.split(F.regexp_replace(text, pattern, ",".join(f"${i}" for i in wanted)), ",")


def code_pieces(token: Column) -> Column:
    """The six pieces of one code group as texts, empty where it has none."""
    return groups(token, PRESENT_WEATHER, 1, 2, 3, 4, 5, 6)


def weather_tuples(found: Column) -> Column:
    """Pieces of one code group as six-tuples (intensity, vicinity, descriptor, precipitation, obscuration,
    other); further kinds of precipitation add a tuple each."""
    none = F.lit(None).cast("string")
    # The fourth place may hold several two-letter codes.
    first = F.transform(found, lambda v, i: F.when(v != "", F.when(i == 3, F.substring(v, 1, 2)).otherwise(v)))
    more = F.regexp_extract_all(F.substr(found[3], F.lit(3)), F.lit("([A-Z]{2})"), F.lit(1))
    return F.concat(F.array(first), F.transform(more, lambda p: F.array(none, none, none, p, none, none)))


def weather_types(text: Column) -> Column:
    """All code groups of a report; null when there are none."""
    value = F.trim(text)
    # Two steps, so that a group is matched once however often its pieces are looked at.
    pieces = F.transform(F.split(value, " "), code_pieces)
    return F.when(~value.isin("", "-"), F.flatten(F.transform(pieces, weather_tuples)))


def sky_top(sky: Column) -> Column:
    """The topmost layer is reported last."""
    return F.element_at(F.split(sky, " "), -1)


def report_time(day: Column, clock: Column) -> Column:
    """Timestamp from yyyymmdd and a clock that may lack leading zeros; null if impossible."""
    digits = F.when(F.trim(clock).rlike(r"^\d{1,4}$"), F.lpad(F.trim(clock), 4, "0"))
    pieces = F.concat_ws(
        " ",
        F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)),
        F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2)),
    )
    return F.when(digits.isNotNull() & F.trim(day).rlike(r"^\d{8}$"), pieces.try_cast("timestamp_ntz"))


def report_day(day: Column) -> Column:
    pieces = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    return F.when(F.trim(day).rlike(r"^\d{8}$"), pieces.try_cast("date"))
