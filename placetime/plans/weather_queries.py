"""Queries on weather reports and stations.

The raw lines are put together from keys; the SQL side computes the expected values from the
same keys and never parses a line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from placetime.functions import weather
from placetime.operators import weather as wx
from placetime.plans.derived import call_sign, derive, duck, pick, present_pieces, text
from placetime.plans.point_queries import lit
from placetime.plans.registry import query
from placetime.session import scratch_path
from placetime.sources import weather as files

_TUPLE = ("intensity", "vicinity", "descriptor", "precipitation", "obscuration")

COMPASS_SQL = "CAST(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'] AS VARCHAR[])"


def cardinal_sql(degrees: str) -> str:
    return f"{COMPASS_SQL}[CAST(trunc({degrees} / 22.5e0 + 5e-1) AS BIGINT) % 16 + 1]"


def types_sql(key: str) -> str:
    """The decoded tuples as text, from the pieces a code group was built of."""
    pieces = present_pieces(key)
    first = " || ',' || ".join(f"COALESCE({pieces[name]}, '')" for name in _TUPLE)
    nothing = " AND ".join(f"{pieces[name]} IS NULL" for name in (*_TUPLE, "too"))
    more = f"CASE WHEN {pieces['too']} IS NULL THEN '' ELSE ';,,,' || {pieces['too']} || ',,' END"
    return f"CASE WHEN ({nothing}) OR ({_only_minus(pieces)}) THEN NULL ELSE {first} || ',' || {more} END"


def _only_minus(pieces: dict[str, str]) -> str:
    """A lone minus sign stands for no weather at all."""
    rest = " AND ".join(f"{p} IS NULL" for name, p in pieces.items() if name != "intensity")
    return f"{pieces['intensity']} = '-' AND {rest}"


def types_text(column: str = "weather_types"):
    """Tuples as text: fields by comma, tuples by semicolon."""
    one = lambda t: F.array_join(F.transform(t, lambda v: F.coalesce(v, F.lit(""))), ",")
    return F.array_join(F.transform(column, one), ";")


# -- daily ----------------------------------------------------------------------------------------

_DAILY_SQL = (
    "daily AS (SELECT o_orderkey AS k, "
    f"lpad({text('o_custkey % 997')}, 5, '0') AS wban_code, CAST(o_orderdate AS DATE) AS date,"
    " CAST(o_orderkey % 110 AS DOUBLE) AS temp_max, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 60 AS DOUBLE) END AS temp_min,"
    " CAST(o_orderkey % 80 AS DOUBLE) AS temp_avg, CAST(-(o_orderkey % 20 + 1) AS DOUBLE) AS departure_from_normal,"
    " CASE o_orderkey % 4 WHEN 1 THEN 41e0 WHEN 3 THEN 12.5e0 END AS dewpoint_avg, CASE o_orderkey % 3 WHEN 1 THEN 44e0 END AS wetbulb_avg,"
    f" {types_sql('o_orderkey')} AS weather_types,"
    " CASE o_orderkey % 4 WHEN 2 THEN 3e0 WHEN 3 THEN NULL ELSE 5e-3 END AS snowice_depth,"
    " CASE o_orderkey % 2 WHEN 0 THEN 0.25e0 END AS snowice_waterequiv,"
    " CASE o_orderkey % 3 WHEN 0 THEN 5e-3 WHEN 1 THEN 1.5e0 ELSE 0e0 END AS snowfall,"
    " CASE WHEN o_orderkey % 5 = 0 THEN 5e-3 ELSE CAST('0.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS precip_total,"
    " CAST('29.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS station_pressure, 30.01e0 AS sealevel_pressure,"
    " CAST(o_orderkey % 4 AS DOUBLE) AS resultant_windspeed,"
    " CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey * 7 % 360 AS VARCHAR) END AS resultant_winddirection,"
    f" CASE WHEN o_orderkey % 4 > 0 THEN {cardinal_sql('(o_orderkey * 7 % 360)')} END AS resultant_winddirection_cardinal,"
    " CAST(o_orderkey % 25 AS DOUBLE) AS avg_windspeed, CAST(o_orderkey % 40 AS DOUBLE) AS max5_windspeed,"
    f" CASE WHEN o_orderkey % 40 > 0 THEN {pick('o_orderkey', 'VRB', 'VRB', '90', None, None, None, '11')} END AS max5_winddirection,"
    f" CASE WHEN o_orderkey % 40 > 0 THEN {pick('o_orderkey', 'VRB', 'VRB', 'E', None, None, None, 'N')} END AS max5_direction_cardinal,"
    f" CASE o_orderkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 7e0 END AS max2_windspeed,"
    f" {pick('o_orderkey', None, 'VRB', '180')} AS max2_winddirection, {pick('o_orderkey', None, 'VRB', 'S')} AS max2_direction_cardinal"
    " FROM orders)"
)


def _daily(spark, sf):
    return wx.clean_daily(derive(spark, sf, "daily_lines", heavy=True).drop("order_key"))


@query("weather_daily_clean", f"WITH {_DAILY_SQL} SELECT * EXCLUDE (k) FROM daily")
def weather_daily_clean(spark, sf):
    return _daily(spark, sf).withColumn("weather_types", types_text())


@query(
    "weather_types",
    f"WITH {_DAILY_SQL} SELECT k AS order_key, weather_types FROM daily WHERE weather_types IS NOT NULL",
)
def weather_types(spark, sf):
    rows = derive(spark, sf, "daily_lines").select("order_key", weather.weather_types(F.col("CodeSum")).alias("weather_types"))
    return rows.withColumn("weather_types", types_text()).filter(F.col("weather_types").isNotNull())


@query(
    "weather_wind",
    f"WITH {_DAILY_SQL} SELECT k AS order_key, max5_windspeed AS speed, max5_winddirection AS direction, max5_direction_cardinal AS cardinal FROM daily",
)
def weather_wind(spark, sf):
    speed = weather.number(F.col("Max5Speed"))
    direction, point = weather.wind(speed, F.col("Max5Dir"))
    return derive(spark, sf, "daily_lines").select(
        "order_key", speed.alias("speed"), direction.alias("direction"), point.alias("cardinal")
    )


# -- hourly ---------------------------------------------------------------------------------------

_HOURLY_SQL = (
    "hourly AS (SELECT CAST(l_suppkey % 997 + 1 AS VARCHAR) AS wban_code,"
    " CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (l_orderkey % 24) + INTERVAL 1 MINUTE * (l_partkey % 60) AS datetime,"
    f" {pick('l_orderkey', 'AO2', '-')} AS old_station_type, NULL::INTEGER AS station_type,"
    f" {pick('l_partkey', 'CLR', 'SCT013 BKN021 OVC029', 'FEW018 BKN029')} AS sky_condition,"
    f" {pick('l_partkey', 'CLR', 'OVC029', 'BKN029')} AS sky_condition_top, NULL::DOUBLE AS visibility,"
    f" {types_sql('l_orderkey')} AS weather_types, CAST(l_partkey % 100 AS DOUBLE) AS drybulb_fahrenheit,"
    " CASE WHEN l_partkey % 2 = 1 THEN 50e0 END AS wetbulb_fahrenheit, CAST(l_partkey % 70 AS DOUBLE) AS dewpoint_fahrenheit,"
    " CAST(l_partkey % 101 AS INTEGER) AS relative_humidity, CAST(CASE l_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 12 END AS INTEGER) AS wind_speed,"
    " CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey * 10 % 370 AS VARCHAR) END AS wind_direction,"
    f" CASE WHEN l_partkey % 3 > 0 THEN {cardinal_sql('(l_partkey * 10 % 370)')} END AS wind_direction_cardinal,"
    " 29.92e0 AS station_pressure, CASE WHEN l_orderkey % 2 = 1 THEN 30.12e0 END AS sealevel_pressure, 'AA' AS report_type,"
    " CASE l_orderkey % 3 WHEN 0 THEN 5e-3 WHEN 1 THEN 0.1e0 END AS hourly_precip, l_orderkey, l_partkey, l_linenumber"
    " FROM lineitem WHERE l_linenumber % 3 <> 1 AND l_partkey % 19 <> 0)"
)


def _hourly(spark, sf):
    return wx.clean_hourly(derive(spark, sf, "hourly_lines", heavy=True))


def _in_layout(lines, headers, old: bool):
    """Lines under the header names of the other layout."""
    frm, to = (0, 1) if old else (1, 0)
    names = {pair[frm]: pair[to] for pair in headers.values()}
    return lines.select(*[F.col(f"`{c}`").alias(names[c]) for c in lines.columns if c in names])


@query("weather_daily_old", f"WITH {_DAILY_SQL} SELECT * EXCLUDE (k) FROM daily")
def weather_daily_old(spark, sf):
    """Daily reports under the header of the older layout."""
    old = _in_layout(derive(spark, sf, "daily_lines", heavy=True), wx.DAILY_HEADERS, old=True)
    return wx.clean_daily(old).withColumn("weather_types", types_text())


_NEW_HOURLY = "old_station_type, station_type, visibility, wban_code"


@query(
    "weather_hourly_new",
    f"WITH {_HOURLY_SQL} SELECT * EXCLUDE (l_orderkey, l_partkey, l_linenumber, {_NEW_HOURLY}), lpad(wban_code, 6, '0') AS wban_code,"
    " CASE WHEN l_orderkey % 2 = 0 THEN 12 END AS station_type, NULL::VARCHAR AS old_station_type, 10e0 AS visibility FROM hourly",
)
def weather_hourly_new(spark, sf):
    """Hourly reports under the header of the newer layout, where stations have types by number and visibilities."""
    lines = derive(spark, sf, "hourly_lines")
    kind = F.when(F.trim("Station Type") == "AO2", " 12").otherwise("-")
    new = _in_layout(lines.withColumn("Station Type", kind).withColumn("Visibility", F.lit("10.0")), wx.HOURLY_HEADERS, old=False)
    return wx.clean_hourly(new).withColumn("weather_types", types_text())


_ONLY = [f"{i:05}" for i in range(0, 997, 3)]
_WITHOUT = [f"{i:05}" for i in range(0, 997, 5)]


@query(
    "weather_station_lists",
    f"WITH {_DAILY_SQL} SELECT wban_code, date, temp_max FROM daily WHERE CAST(wban_code AS INT) % 3 = 0 AND CAST(wban_code AS INT) % 5 <> 0",
)
def weather_station_lists(spark, sf):
    """Reports of listed stations without those of banned ones."""
    lines = derive(spark, sf, "daily_lines").drop("order_key")
    return wx.clean_daily(lines, only=_ONLY, without=_WITHOUT).select("wban_code", "date", "temp_max")


def _landed(lines, day: str, old, span: str, headers):
    """Two files of a landing folder, each in its layout: lines up to a day and after it."""
    landing = scratch_path(lines.sparkSession, "landing")
    first, second = lines.filter(F.col(day) < "19980501"), lines.filter(F.col(day) >= "19980501")
    if old:
        second = _in_layout(second, headers, old=False)
    else:
        first = _in_layout(first, headers, old=True)
    for month, part in (((1998, 4), first), ((1998, 5), second)):
        part.write.option("header", True).csv(f"{landing}/{files.report_file(*month, span)}", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return landing


@query(
    "weather_month_load",
    f"WITH {_DAILY_SQL} SELECT wban_code, date, max(temp_max) AS temp_max, strftime(date, '%Y-%m') AS month, 1 AS n FROM daily GROUP BY wban_code, date",
)
def weather_month_load(spark, sf):
    """Daily files in both layouts, loaded twice: every report is stored once, in its month's folder."""
    lines = derive(spark, sf, "daily_lines").drop("order_key")
    landing, store = _landed(lines, "YearMonthDay", False, "daily", wx.DAILY_HEADERS), scratch_path(spark, "daily")
    files.load_months(spark, landing, store, "daily", [(1998, 4)])
    for _ in range(2):
        files.load_months(spark, landing, store, "daily", [(1998, 4), (1998, 5)])
    rows = files.stored_reports(spark, store)
    counted = rows.groupBy("wban_code", "date", F.col("month").cast("string").alias("month"))
    return counted.agg(F.max("temp_max").alias("temp_max"), F.count(F.lit(1)).alias("n"))


@query(
    "weather_month_load_hourly",
    f"WITH {_HOURLY_SQL} SELECT CASE WHEN datetime < TIMESTAMP '1998-05-01' THEN wban_code ELSE lpad(wban_code, 6, '0') END AS wban_code, datetime,"
    " strftime(datetime, '%Y-%m') AS month, 1 AS n FROM hourly GROUP BY ALL",
)
def weather_month_load_hourly(spark, sf):
    """Hourly files in both layouts, the later one first, then both."""
    lines = derive(spark, sf, "hourly_lines", heavy=True)
    landing, store = _landed(lines, "YearMonthDay", True, "hourly", wx.HOURLY_HEADERS), scratch_path(spark, "hourly")
    for months in ([(1998, 5)], [(1998, 4), (1998, 5)]):
        files.load_months(spark, landing, store, "hourly", months)
    rows = files.stored_reports(spark, store)
    return rows.groupBy("wban_code", "datetime", F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("weather_hourly_clean", f"WITH {_HOURLY_SQL} SELECT * EXCLUDE (l_orderkey, l_partkey, l_linenumber) FROM hourly")
def weather_hourly_clean(spark, sf):
    return _hourly(spark, sf).withColumn("weather_types", types_text())


# -- stations -------------------------------------------------------------------------------------

_STATIONS_SQL = duck("station_lines") + (
    ", stations AS (SELECT wban_code, station_name, country, state, '' AS call_sign, TRY_CAST(lon AS DOUBLE) AS lon,"
    " TRY_CAST(replace(lat, '+', '') AS DOUBLE) AS lat, TRY_CAST(replace(elevation, '+', '') AS DOUBLE) AS elevation,"
    " DATE '1973-01-01' AS begin, DATE '2017-01-31' AS \"end\" FROM station_lines WHERE wban_code <> '99999' AND lat <> ''"
    " QUALIFY row_number() OVER (PARTITION BY wban_code ORDER BY arrival) = 1)"
)


def _stations(spark, sf):
    return wx.clean_stations(derive(spark, sf, "station_lines"))


@query("weather_stations_clean", _STATIONS_SQL + " SELECT * FROM stations")
def weather_stations_clean(spark, sf):
    return _stations(spark, sf)


@query(
    "stations_upsert",
    _STATIONS_SQL
    + " SELECT wban_code, CASE WHEN state = 'IL' THEN station_name ELSE upper(station_name) || '!' END AS station_name FROM stations",
)
def stations_upsert(spark, sf):
    """Known stations keep their data, new ones come in."""
    stations = _stations(spark, sf)
    known = stations.filter(F.col("state") == "IL")
    incoming = stations.withColumn("station_name", F.concat(F.upper("station_name"), F.lit("!")))
    return wx.add_missing_stations(known, incoming).select("wban_code", "station_name")


@query(
    "stations_query",
    _STATIONS_SQL + " SELECT wban_code, station_name, lon, lat FROM stations WHERE state IN ('IL', 'WI')"
    f" AND station_name LIKE '%1' AND elevation IS NOT NULL AND lon > {lit(-87.8)} AND lon < {lit(-87.1)} AND lat > {lit(41.2)} AND lat < {lit(41.9)}",
)
def stations_query(spark, sf):
    box = {"type": "Polygon", "coordinates": [[[-87.8, 41.2], [-87.1, 41.2], [-87.1, 41.9], [-87.8, 41.9], [-87.8, 41.2]]]}
    found = wx.station_query(
        _stations(spark, sf),
        {"state__in": "IL,WI", "station_name__endswith": "1", "elevation__ne": "null", "location__within": box},
    )
    return found.select("wban_code", "station_name", "lon", "lat")


# -- loading --------------------------------------------------------------------------------------


@query(
    "weather_upsert",
    f"WITH {_DAILY_SQL} SELECT wban_code, date, count(*) AS n FROM daily GROUP BY ALL HAVING bool_or(date < DATE '1998-05-01')"
    f" UNION ALL SELECT wban_code, date, 1 FROM daily GROUP BY ALL HAVING bool_and(date >= DATE '1998-05-01')",
)
def weather_upsert(spark, sf):
    """Months already stored stay; of a full reload only unseen station days are added, once each."""
    full = _daily(spark, sf)
    stored = full.filter(F.col("date") < "1998-05-01")
    whole = wx.weather_upsert(stored, full)
    return whole.groupBy("wban_code", "date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "weather_locate",
    _STATIONS_SQL
    + f", {_DAILY_SQL}, reports AS (SELECT k, wban_code, date, CASE WHEN k % 4 = 0 THEN -1e0 END AS longitude,"
    " CASE WHEN k % 4 = 0 THEN 1e0 END AS latitude FROM daily)"
    " SELECT k, wban_code, COALESCE(longitude, lon) AS longitude, COALESCE(latitude, lat) AS latitude FROM reports LEFT JOIN stations USING (wban_code)",
)
def weather_locate(spark, sf):
    lines = derive(spark, sf, "daily_lines")
    known = F.col("order_key") % 4 == 0
    reports = lines.select(
        F.col("order_key").alias("k"),
        F.col("WBAN").alias("wban_code"),
        weather.report_day(F.col("YearMonthDay")).alias("date"),
        F.when(known, -1.0).alias("longitude"),
        F.when(known, 1.0).alias("latitude"),
    )
    return wx.weather_locate(reports, _stations(spark, sf)).select("k", "wban_code", "longitude", "latitude")


@query(
    "stations_in_month",
    f"WITH {_DAILY_SQL} SELECT DISTINCT wban_code FROM daily WHERE date >= DATE '1997-04-01' AND date < DATE '1997-05-01'",
)
def stations_in_month(spark, sf):
    return wx.stations_in_month(_daily(spark, sf), "1997-04-12")


# -- queries --------------------------------------------------------------------------------------

_PAGE_SQL = (
    _STATIONS_SQL
    + f", {_DAILY_SQL}, page AS (SELECT d.k, d.wban_code, d.date, temp_max, s.station_name AS station_station_name, s.lat AS station_lat"
    " FROM (SELECT min(k) AS k, wban_code, date, max(temp_max) AS temp_max FROM daily GROUP BY wban_code, date) d JOIN stations s USING (wban_code)"
    " WHERE temp_max >= 20 AND date <= DATE '2000-12-31' ORDER BY date DESC, wban_code LIMIT 1000 OFFSET 10)"
)


_ARGUMENTS = {"temp_max__ge": "20", "date__le": "2000-12-31", "limit": 5}


def _one_per_day(spark, sf):
    return _daily(spark, sf).groupBy("wban_code", "date").agg(F.max("temp_max").alias("temp_max"))


@query("weather_query", _PAGE_SQL + " SELECT wban_code, date, temp_max, station_station_name, station_lat FROM page")
def weather_query(spark, sf):
    page = wx.weather_query(_one_per_day(spark, sf), _stations(spark, sf), _ARGUMENTS, offset=10)
    return page.select("wban_code", "date", "temp_max", "station_station_name", "station_lat")


@query(
    "weather_nested",
    _PAGE_SQL
    + " SELECT wban_code, station_station_name AS name, string_agg(CAST(date AS VARCHAR) || ' ' || CAST(CAST(temp_max AS BIGINT) AS VARCHAR), ','"
    " ORDER BY date DESC) AS observations FROM page GROUP BY ALL",
)
def weather_nested(spark, sf):
    nested = wx.weather_nested(_one_per_day(spark, sf), _stations(spark, sf), _ARGUMENTS, offset=10)
    shown = F.transform("observations", lambda o: F.concat_ws(" ", o["date"].cast("string"), o["temp_max"].cast("long").cast("string")))
    return nested.select("wban_code", F.col("station_info.station_name").alias("name"), F.array_join(shown, ",").alias("observations"))


# -- METAR ------------------------------------------------------------------------------------------

_MPH = "(514444e-6 / 447e-3)"
_METAR_SQL = (
    f"decoded AS (SELECT event_id, lpad(CAST(user_id AS VARCHAR), 5, '0') AS wban_code, {call_sign('user_id')} AS call_sign,"
    " date_trunc('month', ts) - CASE WHEN event_id % 28 + 1 > day(ts) THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END"
    " + INTERVAL 1 DAY * (event_id % 28) + INTERVAL 1 HOUR * (event_id % 24) + INTERVAL 1 MINUTE * (event_id % 60) AS datetime,"
    f" {pick('event_id', 'CLR', 'FEW015 BKN040CB OVC200', 'BKN065 SCT020')} AS sky_condition,"
    f" {pick('event_id', 'CLR', 'OVC200', 'BKN065')} AS sky_condition_top,"
    " CASE event_id % 3 WHEN 0 THEN 10e0 WHEN 1 THEN 1.5e0 ELSE 0.25e0 END AS visibility,"
    f" {pick('event_id', '-,,,RA,,', ',,TS,RA,,;,,,,BR,', '', '+,,SH,SN,,;,,,,FG,')} AS weather_types,"
    " CASE WHEN event_id % 5 = 0 THEN -5.6e0 * 1.8e0 + 32e0 ELSE (CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * (event_id % 30) * 1.8e0 + 32e0 END AS temp_fahrenheit,"
    " CASE WHEN event_id % 5 = 0 THEN -6.7e0 * 1.8e0 + 32e0 ELSE (event_id % 20) * 1.8e0 + 32e0 END AS dewpoint_fahrenheit,"
    f" CAST(round_even((event_id % 30) * {_MPH}, 0) AS INTEGER) AS wind_speed,"
    f" {pick('event_id', None, '270', '5')} AS wind_direction, {pick('event_id', None, 'W', 'N')} AS wind_direction_cardinal,"
    f" CASE WHEN event_id % 2 = 1 THEN CAST(round_even(35 * {_MPH}, 0) AS INTEGER) END AS wind_gust,"
    " (2900 + event_id % 100) / 1e2 AS station_pressure,"
    " ((event_id % 1000) / 1e1 + CASE WHEN event_id % 1000 < 500 THEN 1000 ELSE 900 END) / 33.86398e0 AS sealevel_pressure,"
    " (event_id % 50) / 1e2 AS precip_1hr, CASE WHEN event_id % 24 % 6 = 3 THEN (event_id % 70) / 1e2 END AS precip_3hr,"
    " CASE WHEN event_id % 24 % 6 <> 3 THEN (event_id % 70) / 1e2 END AS precip_6hr, NULL::DOUBLE AS precip_24hr"
    " FROM events WHERE user_id IN (SELECT c_custkey FROM customer))"
)

_ROUNDED = ("temp_fahrenheit", "dewpoint_fahrenheit", "sealevel_pressure", "station_pressure")


def _metars(spark, sf):
    return wx.decode_metar(derive(spark, sf, "metar_lines", heavy=True), derive(spark, sf, "call_signs"))


@query(
    "metar_decode",
    f"WITH {_METAR_SQL} SELECT * EXCLUDE (event_id) REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)}) FROM decoded",
)
def metar_decode(spark, sf):
    rows = _metars(spark, sf).withColumn("weather_types", types_text())
    return rows.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(
    "metar_prune",
    f"WITH {_METAR_SQL} SELECT wban_code, datetime, wind_speed FROM decoded WHERE datetime >="
    " (SELECT max(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) + INTERVAL '266' MONTH FROM lineitem)",
)
def metar_prune(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    hourly = lines.select((F.to_date("l_shipdate").cast("timestamp_ntz") + F.expr("INTERVAL '266' MONTH")).alias("datetime"))
    return wx.metar_prune(_metars(spark, sf), hourly).select("wban_code", "datetime", "wind_speed")
