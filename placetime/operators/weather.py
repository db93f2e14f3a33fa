"""Weather reports: cleaning, stations, queries, incremental loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.functions import metar, weather
from placetime.functions.geometry import point_geojson
from placetime.functions.text import strict_double
from placetime.functions.timeparts import month_bounds, ts_lit
from placetime.operators.catalog import first_per_key, largest_per_key
from placetime.operators.filters import compile_arguments
from placetime.operators.paging import newest, newest_order
from placetime.plans.sizing import settled

# Order of arrival of raw lines, where the first one counts.
ARRIVAL = "arrival"
PAGE = 1000

# Header names of the daily reports, output column -> (newer layout, older layout).
DAILY_HEADERS = {
    "wban_code": ("WBAN", "Wban Number"),
    "date": ("YearMonthDay", "YearMonthDay"),
    "temp_max": ("Tmax", "Max Temp"),
    "temp_min": ("Tmin", "Min Temp"),
    "temp_avg": ("Tavg", "Avg Temp"),
    "departure_from_normal": ("Depart", "Dep from Normal"),
    "dewpoint_avg": ("DewPoint", "Avg Dew Pt"),
    "wetbulb_avg": ("WetBulb", "Avg Wet Bulb"),
    "weather_types": ("CodeSum", "Significant Weather"),
    "snowice_depth": ("Depth", "Snow/Ice Depth"),
    "snowice_waterequiv": ("Water1", "Snow/Ice Water Equiv"),
    "snowfall": ("SnowFall", "Precipitation Snowfall"),
    "precip_total": ("PrecipTotal", "Precipitation Water Equiv"),
    "station_pressure": ("StnPressure", "Pressue Avg Station"),
    "sealevel_pressure": ("SeaLevel", "Pressure Avg Sea Level"),
    "resultant_windspeed": ("ResultSpeed", "Wind Speed"),
    "resultant_winddirection": ("ResultDir", "Wind Direction"),
    "avg_windspeed": ("AvgSpeed", "Wind Avg Speed"),
    "max5_windspeed": ("Max5Speed", "Max 5 sec speed"),
    "max5_winddirection": ("Max5Dir", "Max 5 sec Dir"),
    "max2_windspeed": ("Max2Speed", "Max 2 min speed"),
    "max2_winddirection": ("Max2Dir", "Max 2 min Dir"),
}
DAILY_WINDS = {
    "resultant": ("resultant_windspeed", "resultant_winddirection", "resultant_winddirection_cardinal"),
    "max5": ("max5_windspeed", "max5_winddirection", "max5_direction_cardinal"),
    "max2": ("max2_windspeed", "max2_winddirection", "max2_direction_cardinal"),
}

# Header names of the hourly reports.
HOURLY_HEADERS = {
    "wban_code": ("WBAN", "Wban Number"),
    "date": ("Date", "YearMonthDay"),
    "time": ("Time", "Time"),
    "station_type": ("StationType", "Station Type"),
    "sky_condition": ("SkyCondition", "Sky Conditions"),
    "visibility": ("Visibility", "Visibility"),
    "weather_types": ("WeatherType", "Weather Type"),
    "drybulb_fahrenheit": ("DryBulbFarenheit", "Dry Bulb Temp"),
    "wetbulb_fahrenheit": ("WetBulbFarenheit", "Wet Bulb Temp"),
    "dewpoint_fahrenheit": ("DewPointFarenheit", "Dew Point Temp"),
    "relative_humidity": ("RelativeHumidity", "% Relative Humidity"),
    "wind_speed": ("WindSpeed", "Wind Speed (kt)"),
    "wind_direction": ("WindDirection", "Wind Direction"),
    "station_pressure": ("StationPressure", "Station Pressure"),
    "sealevel_pressure": ("SeaLevelPressure", "Sea Level Pressure"),
    "report_type": ("RecordType", "Record Type"),
    "hourly_precip": ("HourlyPrecip", "Precip. Total"),
}


def _is_old(raw: DataFrame) -> bool:
    return "Wban Number" in raw.columns


def _texts(raw: DataFrame, headers: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    side = 1 if _is_old(raw) else 0
    missing = [names[side] for names in headers.values() if names[side] not in raw.columns]
    if missing:
        raise ValueError(f"not a known report layout, missing {missing}")
    return {name: F.col(f"`{names[side]}`") for name, names in headers.items()}


def _stations_kept(df: DataFrame, only: Sequence[str] | None, without: Sequence[str] | None) -> DataFrame:
    if only is not None:
        df = df.filter(F.col("wban_code").isin(*only))
    if without is not None:
        df = df.filter(~F.coalesce(F.col("wban_code").isin(*without), F.lit(False)))
    return df


def clean_daily(raw: DataFrame, only: Sequence[str] | None = None, without: Sequence[str] | None = None) -> DataFrame:
    """Daily reports of either layout as typed columns."""
    text = _texts(raw, DAILY_HEADERS)
    out: dict[str, Column] = {"wban_code": F.trim(text["wban_code"]), "date": weather.report_day(text["date"])}
    for name in ("temp_max", "temp_min", "temp_avg"):
        out[name] = weather.temperature(text[name])
    for name in ("departure_from_normal", "dewpoint_avg", "wetbulb_avg"):
        out[name] = weather.number(text[name])
    out["weather_types"] = weather.weather_types(text["weather_types"])
    for name in ("snowice_depth", "snowice_waterequiv", "snowfall", "precip_total"):
        out[name] = weather.precipitation(text[name])
    for name in ("station_pressure", "sealevel_pressure", "avg_windspeed"):
        out[name] = weather.number(text[name])
    for speed, direction, point in DAILY_WINDS.values():
        out[speed] = weather.number(text[speed])
        out[direction], out[point] = weather.wind(out[speed], text[direction])
    return _stations_kept(raw.select(*[c.alias(n) for n, c in out.items()]), only, without)


def clean_hourly(
    raw: DataFrame,
    only: Sequence[str] | None = None,
    without: Sequence[str] | None = None,
    drop_special: bool = True,
) -> DataFrame:
    """Hourly reports of either layout as typed columns; rows without a possible time are dropped.

    Special reports repeat a regular one and are dropped unless told otherwise. The older
    layout pads station numbers with zeros and has no usable visibility.
    """
    old, text = _is_old(raw), _texts(raw, HOURLY_HEADERS)
    if drop_special:
        raw = raw.filter(~F.trim(text["report_type"]).eqNullSafe("SP"))
    code, none = F.trim(text["wban_code"]), F.lit(None)
    sky = F.trim(text["sky_condition"])
    speed = weather.whole(text["wind_speed"])
    direction, point = weather.wind(speed, text["wind_direction"])
    out = {
        "wban_code": F.ltrim(code, F.lit("0")) if old else code,
        "datetime": weather.report_time(text["date"], text["time"]),
        "old_station_type": F.trim(text["station_type"]) if old else none.cast("string"),
        "station_type": none.cast("int") if old else weather.whole(text["station_type"]),
        "sky_condition": sky,
        "sky_condition_top": weather.sky_top(sky),
        "visibility": none.cast("double") if old else weather.number(text["visibility"]),
        "weather_types": weather.weather_types(text["weather_types"]),
        "drybulb_fahrenheit": weather.number(text["drybulb_fahrenheit"]),
        "wetbulb_fahrenheit": weather.number(text["wetbulb_fahrenheit"]),
        "dewpoint_fahrenheit": weather.number(text["dewpoint_fahrenheit"]),
        "relative_humidity": weather.whole(text["relative_humidity"]),
        "wind_speed": speed,
        "wind_direction": direction,
        "wind_direction_cardinal": point,
        "station_pressure": weather.number(text["station_pressure"]),
        "sealevel_pressure": weather.number(text["sealevel_pressure"]),
        "report_type": F.trim(text["report_type"]),
        "hourly_precip": weather.precipitation(text["hourly_precip"]),
    }
    cleaned = raw.select(*[c.alias(n) for n, c in out.items()]).filter(F.col("datetime").isNotNull())
    return _stations_kept(cleaned, only, without)


def decode_metar(
    reports: DataFrame,
    call_signs: DataFrame,
    only: Sequence[str] | None = None,
    without: Sequence[str] | None = None,
    text: str = "report",
    received: str = "received",
) -> DataFrame:
    """Decoded reports of stations that have a number; others lie outside the covered country."""
    decoded = metar.decode(reports, text, received)
    numbered = decoded.join(station_numbers(call_signs), "call_sign").select("wban_code", *decoded.columns)
    return _stations_kept(numbered, only, without)


def station_numbers(call_signs: DataFrame) -> DataFrame:
    """One number per call sign."""
    numbers = call_signs.groupBy("call_sign").agg(F.min("wban_code").alias("wban_code"))
    return settled(numbers, "call-signs")


def clean_stations(raw: DataFrame) -> DataFrame:
    """The first line of every numbered station that has a place, typed.

    The first line is found by a minimum that combines map side, so many lines of one station
    never meet in one task.
    """
    lat, lon, elevation = (strict_double(F.regexp_replace(F.col(c), r"\+", "")) for c in ("lat", "lon", "elevation"))
    placed = raw.filter((F.col("wban_code") != "99999") & lat.isNotNull() & lon.isNotNull())
    typed = placed.select(
        "wban_code",
        "station_name",
        "country",
        "state",
        F.lit("").alias("call_sign"),
        lon.alias("lon"),
        lat.alias("lat"),
        elevation.alias("elevation"),
        weather.report_day(F.col("begin")).alias("begin"),
        weather.report_day(F.col("end")).alias("end"),
        ARRIVAL,
    )
    return first_per_key(typed, ["wban_code"], [F.col(ARRIVAL)]).drop(ARRIVAL)


def add_missing_stations(stations: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known stations stay as they are; unknown numbers are added."""
    return stations.unionByName(incoming.join(stations.select("wban_code"), "wban_code", "left_anti"))


def time_column(reports: DataFrame) -> str:
    return "date" if "date" in reports.columns else "datetime"


def weather_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored reports plus the incoming ones whose station and time are new.

    Of reports of one station and time the largest row is taken, so a rerun gives the same.
    """
    keys = ["wban_code", time_column(stored)]
    fresh = largest_per_key(incoming, keys).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def weather_locate(reports: DataFrame, stations: DataFrame, month=None) -> DataFrame:
    """Coordinates from the station where a report has none at all; only within `month` if given."""
    places = stations.select("wban_code", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    missing = F.col("longitude").isNull() & F.col("latitude").isNull()
    if month is not None:
        start, end = month_bounds(month)
        when = F.col(time_column(reports))
        missing = missing & (when >= ts_lit(start)) & (when < ts_lit(end))
    joined = reports.join(settled(places, "places"), "wban_code", "left")
    return joined.withColumns(
        {
            "longitude": F.when(missing, F.col("_lon")).otherwise(F.col("longitude")),
            "latitude": F.when(missing, F.col("_lat")).otherwise(F.col("latitude")),
        }
    ).drop("_lon", "_lat")


def weather_query(
    reports: DataFrame,
    stations: DataFrame,
    arguments: Mapping[str, object] | None = None,
    limit: int = PAGE,
    offset: int = 0,
    tie: Sequence[str] = ("wban_code",),
) -> DataFrame:
    """The newest matching reports with the data of their station; station columns are prefixed.

    Filters come first, so they reach the scan; then one page is cut, and only its rows are
    joined on. Stations are unique by number; reports of unknown stations do not count, which
    a semi join checks before the cut.
    """
    ts = time_column(reports)
    # `null` stands for a missing value; unknown columns and operators are errors.
    wanted, _ = compile_arguments(reports.schema, arguments or {}, date_column=ts, strict=True, null_word="null")
    stations = settled(stations, "stations")  # worked out once, read twice
    known = reports.filter(wanted).join(stations.select("wban_code"), "wban_code", "left_semi")
    page = newest(known, ts, tie, limit, offset)
    renamed = stations.select("wban_code", *[F.col(c).alias(f"station_{c}") for c in stations.columns if c != "wban_code"])
    # A shuffled join loses the order of the page.
    return page.join(renamed, "wban_code").orderBy(*newest_order(ts, tie))


def station_query(stations: DataFrame, arguments: Mapping[str, object] | None = None) -> DataFrame:
    wanted, _ = compile_arguments(stations.schema, arguments or {}, strict=True, null_word="null")
    return stations.filter(wanted)


def weather_nested(
    reports: DataFrame,
    stations: DataFrame,
    arguments: Mapping[str, object] | None = None,
    limit: int = PAGE,
    offset: int = 0,
    tie: Sequence[str] = ("wban_code",),
) -> DataFrame:
    """The same page grouped by station: station_info and its observations, newest first.

    A list holds no more rows than the page.
    """
    page = weather_query(reports, stations, arguments, limit, offset, tie)
    ts = time_column(reports)
    own = [F.col(f"`{c}`") for c in (ts, *[c for c in reports.columns if c != ts])]
    entries = page.groupBy("wban_code").agg(F.reverse(F.array_sort(F.collect_list(F.struct(*own)))).alias("observations"))
    info = F.struct(
        "wban_code",
        *[c for c in stations.columns if c not in ("wban_code", "lon", "lat")],
        point_geojson(F.col("lon"), F.col("lat")).alias("location"),
    )
    return entries.join(stations, "wban_code").select("wban_code", info.alias("station_info"), "observations")


def stations_in_month(reports: DataFrame, month) -> DataFrame:
    """Numbers of the stations that reported in a month."""
    start, end = month_bounds(month)
    when = F.col(time_column(reports))
    return reports.filter((when >= ts_lit(start)) & (when < ts_lit(end))).select("wban_code").distinct()


def metar_prune(metars: DataFrame, hourly: DataFrame) -> DataFrame:
    """Reports not older than the newest quality-controlled hourly one; all, if there is none."""
    newest_hourly = hourly.agg(F.max("datetime").alias("newest")).scalar()
    return metars.filter(F.coalesce(F.col("datetime") >= newest_hourly, F.lit(True)))
