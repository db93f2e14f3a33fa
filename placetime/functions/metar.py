"""Aviation weather reports (METAR) decoded with column expressions.

A report is plain text: groups separated by blanks, then remarks after RMK. Every value is
one regular expression plus unit arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.functions.weather import DESCRIPTORS, cardinal, groups

# Conversions and code groups.
MPS_PER_KNOT = 0.514444
MPS_PER_MPH = 0.447
KMH_PER_MPS = 3.6
HPA_PER_INCH = 33.86398
METRES_PER_MILE = 1609.344
FAR_METRES = 10_000.0

# Where to find each group in a report: the whole group is cut out once, then taken apart.
STATION = r"^ (?:(?:METAR|SPECI) )?(?:COR )?([A-Z][A-Z0-9]{3}) "
TIME = r" (\d{6})Z "
WIND = r" ((?:\d{3}|VRB|///)(?:P?\d{2,3}|//)(?:GP?\d{2,3})?(?:KT|MPS|KMH)) "
MILES = r" [PM]?((?:\d{1,2} )?(?:\d{1,2}/\d{1,2}|\d{1,2}))SM "
METRES = r" (\d{4})(?:NDV)? "
TEMPERATURE = r" (M?\d{2}/(?:M?\d{2})?) "
ALTIMETER = r" ([AQ]\d{4}) "
SEA_LEVEL = r" SLP(\d{3}) "
RAIN_1H = r" P(\d{4}) "
RAIN_6H = r" 6(\d{4}) "
RAIN_24H = r" 7(\d{4}) "
TENTHS = r" T([01]\d{3}(?:[01]\d{3})?) "

WIND_PARTS = r"^(\d{3}|VRB|///)P?(\d{2,3}|//)(?:GP?(\d{2,3}))?(KT|MPS|KMH)$"
MILES_PARTS = r"^(?:(\d{1,2}) )?(?:(\d{1,2})/(\d{1,2})|(\d{1,2}))$"
SKY = r"^(CLR|SKC|NSC|NCD|VV|FEW|SCT|BKN|OVC)(\d{3})?(CB|TCU)?$"
PRESENT = (
    rf"^([-+]?(?:VC)?|VC)((?:{'|'.join(DESCRIPTORS)})*)((?:DZ|RA|SN|SG|IC|PL|GR|GS|UP)*)"
    r"(BR|FG|FU|VA|DU|SA|HZ|PY)?(PO|SQ|FC|SS|DS)?$"
)


def _int(value: Column) -> Column:
    return F.rint(value).cast("int")


def _number(text: Column) -> Column:
    """A number, null for text that is empty or no number."""
    return text.try_cast("double")


def _miles_per_hour(value: Column, unit: Column) -> Column:
    mps = (
        F.when(unit == "KT", value * MPS_PER_KNOT).when(unit == "KMH", value / KMH_PER_MPS).otherwise(value)
    )
    return mps / MPS_PER_MPH


def _celsius(signed: Column) -> Column:
    """Whole degrees with M for minus."""
    return _number(F.translate(signed, "M", "-"))


def _tenths(signed: Column) -> Column:
    """A sign digit (1 for minus) and tenths of degrees."""
    size = _number(F.substring(signed, 2, 3)) / 10.0
    return F.when(signed.startswith("1"), -size).otherwise(size)


def _fahrenheit(celsius: Column) -> Column:
    return celsius * 1.8 + 32.0


def issued(stamp: Column, received: Column) -> Column:
    """Day, hour and minute (six digits) as a timestamp; the month is that of `received`, or the one
    before if the day has not come yet."""
    day, hour, minute = (F.substring(stamp, i, 2).try_cast("int") for i in (1, 3, 5))
    today = F.to_date(received)
    month = F.add_months(F.trunc(today, "month"), F.when(day > F.dayofmonth(today), -1).otherwise(0))
    date = F.date_add(month, day - 1)
    # A day beyond the month's last one lands in the next month.
    possible = (F.dayofmonth(date) == day) & (hour < 24) & (minute < 60)
    return F.when(possible, date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, F.lit(0)))


def _layers(codes: Column) -> Column:
    return F.transform(
        F.filter(codes, lambda g: g.rlike(SKY)),
        lambda g: F.struct(F.regexp_extract(g, r"(\d{3})", 1).try_cast("int").alias("height"), g.alias("code")),
    )


def _top(layers: Column) -> Column:
    """The highest layer, the last of equals; without heights the last one."""

    def better(best: Column, layer: Column) -> Column:
        higher = F.coalesce(layer["height"], F.lit(-1)) >= F.coalesce(best["height"], F.lit(-1))
        return F.when(best["code"].isNull() | higher, layer).otherwise(best)

    start = F.lit(None).cast("struct<height:int,code:string>")
    return F.aggregate(layers, F.struct(start["height"].alias("height"), start["code"].alias("code")), better)["code"]


def _present(code: Column) -> Column:
    parts = groups(code, PRESENT, 1, 2, 3, 4, 5)
    lead, signed = parts[0], parts[0].rlike("^[-+]")
    return F.concat(
        F.array(F.when(signed, F.substring(lead, 1, 1)), F.when(signed & (F.length(lead) > 1), F.substr(lead, F.lit(2)))),
        F.transform(F.slice(parts, 2, 4), lambda v: F.when(v != "", v)),
    )


def decode(reports: DataFrame, text: str = "report", received: str = "received") -> DataFrame:
    """All columns of decoded reports but the station number.

    Three projections: the text is split at its remarks, the groups are cut out, the groups are
    read. So every search over the text runs once per row.
    """
    # Blanks around every group let a pattern ask for them.
    padded = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.col(text)), r"\s+", " "), F.lit(" "))
    halves = reports.select(padded.alias("line"), F.col(received).alias("received")).select(
        "received",
        F.concat(F.substring_index("line", " RMK ", 1), F.lit(" ")).alias("body"),
        F.when(F.col("line").contains(" RMK "), F.concat(F.lit(" "), F.substring_index("line", " RMK ", -1)))
        .otherwise(F.lit(""))
        .alias("remarks"),
    )
    body, remarks = F.col("body"), F.col("remarks")
    in_body = {
        "station": STATION, "stamp": TIME, "wind": WIND, "miles": MILES, "metres": METRES, "temps": TEMPERATURE, "altimeter": ALTIMETER,
    }
    in_remarks = {"slp": SEA_LEVEL, "rain1": RAIN_1H, "rain6": RAIN_6H, "rain24": RAIN_24H, "tenths": TENTHS}
    codes = F.split(F.trim(body), " ")
    cut = halves.select(
        "received",
        *[F.regexp_extract(body, pattern, 1).alias(name) for name, pattern in in_body.items()],
        *[F.regexp_extract(remarks, pattern, 1).alias(name) for name, pattern in in_remarks.items()],
        body.contains(" CAVOK ").alias("clear"),
        _layers(codes).alias("layers"),
        F.filter(codes, lambda g: g.rlike(PRESENT) & ~g.isin("", "+", "-", "VC")).alias("present"),
    )
    parts = cut.select(
        "*",
        groups(F.col("wind"), WIND_PARTS, 1, 2, 3, 4).alias("w"),
        groups(F.col("miles"), MILES_PARTS, 1, 2, 3, 4).alias("m"),
        F.split("temps", "/").alias("t"),
    )
    return parts.select(*[column.alias(name) for name, column in _values().items()])


def _values() -> dict[str, Column]:
    # A group that is absent splits into one empty text, so its later places are null.
    wind, miles_parts, temps = (lambda i, c=c: F.get(c, F.lit(i)) for c in ("w", "m", "t"))
    unit = wind(3)
    speed, gust = (_miles_per_hour(_number(wind(i)), unit) for i in (1, 2))
    degrees = wind(0).try_cast("int")

    ones, top, bottom, plain = (_number(miles_parts(i)) for i in range(4))
    miles = F.coalesce(plain, top / bottom) + F.coalesce(ones, F.lit(0.0))
    metres = F.when(F.col("clear"), F.lit(FAR_METRES)).otherwise(_number(F.col("metres")))
    metres = F.when(metres == 9999.0, F.lit(FAR_METRES)).otherwise(metres)

    tenths = F.col("tenths")
    temp = F.coalesce(_tenths(F.substring(tenths, 1, 4)), _celsius(temps(0)))
    dew = F.coalesce(_tenths(F.substring(tenths, 5, 4)), _celsius(temps(1)))

    altimeter = F.col("altimeter")
    pressure = _number(F.substring(altimeter, 2, 4))
    pressure = F.when(altimeter.startswith("Q"), pressure / HPA_PER_INCH).otherwise(pressure / 100.0)
    slp = _number(F.col("slp")) / 10.0
    sea_level = (slp + F.when(slp < 50, 1000.0).otherwise(900.0)) / HPA_PER_INCH

    layers, codes = F.col("layers"), F.transform("layers", lambda s: s["code"])
    # Every fourth intermediate hour reports three hours of rain, the others six.
    three_hourly = F.substring("stamp", 3, 2).try_cast("int") % 6 == 3
    rain = {hours: _number(F.col(f"rain{hours}")) / 100.0 for hours in (1, 6, 24)}
    return {
        "call_sign": F.when(F.col("station") != "", F.col("station")),
        "datetime": issued(F.col("stamp"), F.col("received")),
        "sky_condition": F.when(F.size(layers) > 0, F.array_join(codes, " ")),
        "sky_condition_top": _top(layers),
        "visibility": F.coalesce(miles, metres / METRES_PER_MILE),
        "weather_types": F.transform("present", _present),
        "temp_fahrenheit": _fahrenheit(temp),
        "dewpoint_fahrenheit": _fahrenheit(dew),
        "wind_speed": _int(speed),
        "wind_direction": degrees.cast("string"),
        "wind_direction_cardinal": cardinal(degrees),
        "wind_gust": _int(gust),
        "station_pressure": pressure,
        "sealevel_pressure": sea_level,
        "precip_1hr": rain[1],
        "precip_3hr": F.when(three_hourly, rain[6]),
        "precip_6hr": F.when(~three_hourly, rain[6]),
        "precip_24hr": rain[24],
    }
