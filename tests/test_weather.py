"""Weather reports with known meanings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from placetime.functions import metar, weather
from placetime.operators import weather as wx
from placetime.sources import weather as files

EXAMPLE = (
    "METAR KEWR 111851Z VRB03G19KT 2SM R04R/3000VP6000FT TSRA BR FEW015 BKN040CB BKN065 OVC200 22/22 A2987"
    " RMK AO2 PK WND 29028/1817 WSHFT 1812 TSB05RAB22 SLP114 FRQ LTGICCCCG TS OHD AND NW-N-E MOV NE P0013 T02270215"
)
RECEIVED = dt.datetime(2017, 3, 20, 19, 0)


def decoded(spark, *lines):
    frame = spark.createDataFrame([(line, RECEIVED) for line in lines], "report string, received timestamp_ntz")
    return metar.decode(frame).collect()


def test_example_report(spark):
    (row,) = decoded(spark, EXAMPLE)
    assert row["call_sign"] == "KEWR" and row["datetime"] == dt.datetime(2017, 3, 11, 18, 51)
    assert row["sky_condition"] == "FEW015 BKN040CB BKN065 OVC200" and row["sky_condition_top"] == "OVC200"
    assert row["weather_types"] == [[None, None, "TS", "RA", None, None], [None, None, None, None, "BR", None]]
    assert row["temp_fahrenheit"] == pytest.approx(72.86) and row["dewpoint_fahrenheit"] == pytest.approx(70.7)
    assert (row["wind_speed"], row["wind_direction"], row["wind_direction_cardinal"], row["wind_gust"]) == (3, None, None, 22)
    assert row["visibility"] == 2.0 and row["station_pressure"] == pytest.approx(29.87)
    assert row["sealevel_pressure"] == pytest.approx(1011.4 / 33.86398)
    assert row["precip_1hr"] == pytest.approx(0.13) and row["precip_6hr"] is None


def test_report_variants(spark):
    rows = decoded(
        spark,
        "KORD 251551Z 00000KT 1 1/2SM -SN OVC008 M05/M11 A3012 RMK 60021 70125",
        "SPECI EGLL 201520Z AUTO 24015MPS 9999 -RADZ SCT010 BKN020 08/06 Q0998",
        "KXYZ 202451Z 090P99KT M1/4SM FG VV002 10/ A2992",
        "LFPG 201200Z 18005KT CAVOK 20/10 Q1013",
        "nonsense",
    )
    ord_, egll, odd, cavok, nonsense = rows
    # The 25th has not come yet, so it was last month's; a quarter past 15 reports three hours.
    assert ord_["datetime"] == dt.datetime(2017, 2, 25, 15, 51) and ord_["wind_direction_cardinal"] == "N"
    assert ord_["visibility"] == 1.5 and ord_["temp_fahrenheit"] == pytest.approx(23.0)
    assert (ord_["precip_3hr"], ord_["precip_6hr"], ord_["precip_24hr"]) == (0.21, None, 1.25)
    assert ord_["weather_types"] == [["-", None, None, "SN", None, None]]
    assert egll["call_sign"] == "EGLL" and egll["wind_speed"] == 34 and egll["visibility"] == pytest.approx(10000 / 1609.344)
    assert egll["weather_types"][0][3] == "RADZ" and egll["station_pressure"] == pytest.approx(998 / 33.86398)
    assert odd["datetime"] is None and odd["visibility"] == 0.25 and odd["dewpoint_fahrenheit"] is None
    assert odd["sky_condition_top"] == "VV002" and odd["wind_speed"] == 114
    assert cavok["visibility"] == pytest.approx(10000 / 1609.344) and cavok["sky_condition"] is None
    assert nonsense["call_sign"] is None and nonsense["weather_types"] == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", None),
        (" - ", None),
        ("FZFG", [[None, None, "FZ", None, "FG", None]]),
        ("-RASN BR", [["-", None, None, "RA", None, None], [None, None, None, "SN", None, None], [None, None, None, None, "BR", None]]),
        ("+FC", [["+", None, None, None, None, "FC"]]),
        ("VCTS", [[None, "VC", "TS", None, None, None]]),
        ("FG+", [[None, None, None, None, "FG+", None]]),
        ("XX", [[None] * 6]),
    ],
)
def test_present_weather(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(weather.weather_types(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    "speed, direction, expected",
    [
        (5.0, "VR", ("VRB", "VRB")), (5.0, " M ", ("VRB", "VRB")), (5.0, "", (None, None)), (5.0, "-", (None, None)),
        (0.0, "090", (None, None)), (None, "090", ("90", "E")), (3.0, "x", (None, None)), (3.0, "348.8", ("349", "N")),
        (3.0, "11.5", ("12", "NNE")), (3.0, "360", ("360", "N")),
    ],
)
def test_wind(spark, speed, direction, expected):
    frame = spark.createDataFrame([(speed, direction)], "s double, d string")
    assert tuple(frame.select(*weather.wind(F.col("s"), F.col("d"))).first()) == expected


def test_numbers(spark):
    frame = spark.createDataFrame([("  T",), ("1.5",), ("M",), ("err",), ("x",), ("81*",), ("",)], "t string")
    t = F.col("t")
    rows = frame.select(weather.precipitation(t), weather.number(t), weather.temperature(t), weather.whole(t)).collect()
    assert [tuple(r) for r in rows] == [
        (0.005, None, None, None), (1.5, 1.5, 1.5, None), (None,) * 4, (None,) * 4, (None,) * 4, (None, None, 81.0, None), (None,) * 4,
    ]


def test_report_times(spark):
    frame = spark.createDataFrame([("20140801", "601"), ("20140801", "0"), ("20140801", "2460"), ("20140832", "100"), ("20140801", "x")], "d string, t string")
    times = [r[0] for r in frame.select(weather.report_time(F.col("d"), F.col("t"))).collect()]
    assert times == [dt.datetime(2014, 8, 1, 6, 1), dt.datetime(2014, 8, 1), None, None, None]


def test_stations_file(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text(
        '"USAF","WBAN","STATION NAME","CTRY","STATE","ICAO","LAT","LON","ELEV(M)","BEGIN","END"\n'
        '"1","94846","OHARE","US","IL","KORD","+41.995","-087.934","+0205.4","19461001","20170301"\n'
        '"2","94846","OHARE OLD","US","IL","","+42.000","-088.000","+0205.4","19461001","20170301"\n'
        '"3","99999","BUOY","US","","","+41.0","-087.0","","19461001","20170301"\n'
        '"4","14819","MIDWAY","US","IL","KMDW","","","","19461001","20170301"\n'
    )
    (row,) = files.read_stations(spark, str(path)).collect()
    assert (row["wban_code"], row["station_name"], row["lat"], row["lon"]) == ("94846", "OHARE", 41.995, -87.934)
    assert row["begin"] == dt.date(1946, 10, 1)


def test_months():
    assert files.month_archive(2007, 4) == "200704.tar.gz" and files.month_archive(2007, 5) == "QCLCD200705.zip"
    assert files.months_to_load(dt.date(2017, 3, 3)) == [(2017, 2), (2017, 3)]
    assert files.months_to_load(dt.date(2017, 3, 20)) == [(2017, 3)]
    assert files.report_file(2011, 1, "hourly") == "201101hourly.txt"


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        wx.clean_daily(spark.createDataFrame([("1",)], "WBAN string"))


def test_newer_hourly_layout(spark):
    columns = [new for new, _ in wx.HOURLY_HEADERS.values()]
    values = {
        "WBAN": "94846", "Date": "20140801", "Time": "0051", "StationType": "12", "SkyCondition": "FEW018 OVC100", "Visibility": "10.00",
        "WeatherType": "RA", "WindSpeed": "VRB", "WindDirection": "VR", "RecordType": "AA", "HourlyPrecip": "T", "RelativeHumidity": "70",
    }
    rows = [tuple(values.get(c, "M") for c in columns), tuple({**values, "RecordType": "SP"}.get(c, "M") for c in columns)]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    (row,) = wx.clean_hourly(raw).collect()
    assert row["station_type"] == 12 and row["visibility"] == 10.0 and row["sky_condition_top"] == "OVC100"
    assert row["wind_speed"] is None and row["wind_direction"] == "VRB" and row["hourly_precip"] == 0.005
    assert wx.clean_hourly(raw, drop_special=False).count() == 2
    assert wx.clean_hourly(raw, only=["1"]).count() == 0 and wx.clean_hourly(raw, without=["94846"]).count() == 0


def test_query_arguments(spark):
    reports = spark.createDataFrame([("1", dt.date(2017, 1, 2), None), ("1", dt.date(2017, 1, 3), 4.0), ("2", dt.date(2017, 1, 3), 5.0)],
                                    "wban_code string, date date, temp_max double")
    stations = spark.createDataFrame([("1", "A", -87.0, 41.0)], "wban_code string, station_name string, lon double, lat double")
    assert wx.weather_query(reports, stations).count() == 2
    assert wx.weather_query(reports, stations, {"temp_max": "null"}).count() == 1
    (row,) = wx.weather_query(reports, stations, {"wban_code": "1"}, limit=1, offset=1).collect()
    assert row["date"] == dt.date(2017, 1, 2) and row["station_station_name"] == "A"
    with pytest.raises(ValueError):
        wx.weather_query(reports, stations, {"no_such": 1})
    nested = wx.weather_nested(reports, stations).first()
    assert [o["date"].day for o in nested["observations"]] == [3, 2] and nested["station_info"]["location"]["type"] == "Point"


def test_prune_without_hourly_keeps_all(spark):
    metars = spark.createDataFrame([("1", RECEIVED)], "wban_code string, datetime timestamp_ntz")
    assert wx.metar_prune(metars, metars.limit(0)).count() == 1
    assert wx.metar_prune(metars, metars.withColumn("datetime", F.expr("datetime + INTERVAL '1' HOUR"))).count() == 0


def test_a_code_group_is_matched_once(spark):
    lines = spark.createDataFrame([("-RASN BR",), ("-",), ("",), (None,), ("+TSRAGR  VCFG+",), ("VCSHSNDZRA PO",)], "t string")
    found = lines.select(weather.weather_types(F.col("t")).alias("types"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    none = [None] * 6
    assert [r["types"] for r in found.collect()] == [
        [["-", None, None, "RA", None, None], [None, None, None, "SN", None, None], [None, None, None, None, "BR", None]],
        None, None, None,
        [["+", None, "TS", "RA", None, None], [None, None, None, "GR", None, None], none, [None, "VC", None, None, "FG+", None]],
        [[None, "VC", "SH", "SN", None, None], [None, None, None, "DZ", None, None], [None, None, None, "RA", None, None], [None, None, None, None, None, "PO"]],
    ]
