"""Semantics of the scalar building blocks."""

import math

from pyspark.sql import functions as F

from skylag.functions import exprs as X
from skylag.sources.tables import _nan_to_null


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_hhmm_to_hour_folds_2400(spark):
    df = rows(spark, [(0,), (59,), (2359,), (2400,), (None,)], "t int")
    got = [r[0] for r in df.select(X.hhmm_to_hour("t")).collect()]
    assert got == [0, 0, 23, 0, None]


def test_time_slot_bin_edges(spark):
    hours = [0, 5, 6, 11, 12, 17, 18, 23, 24, None]
    df = rows(spark, [(h,) for h in hours], "h int")
    got = [r[0] for r in df.select(X.time_slot("h")).collect()]
    assert got == ["night", "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", None, None]


def test_distance_class_left_closed(spark):
    ds = [-1.0, 0.0, 499.9, 500.0, 1499.9, 1500.0, None]
    df = rows(spark, [(d,) for d in ds], "d double")
    got = [r[0] for r in df.select(X.distance_class("d")).collect()]
    assert got == [None, "short", "short", "medium", "medium", "long", None]
    nb = [r[0] for r in df.select(X.distance_class_notebook("d")).collect()]
    assert nb == ["short", "short", "short", "medium", "medium", "long", "long"]


def test_delay_class_right_closed(spark):
    ys = [-1.0, 0.0, 0.5, 15.0, 15.5, 60.0, 61.0, None]
    df = rows(spark, [(y,) for y in ys], "y double")
    got = [r[0] for r in df.select(X.delay_class("y")).collect()]
    assert got == ["Early", "Early", "On-time", "On-time", "Slight delay", "Slight delay", "Severe delay", None]


def test_isin_null_is_false_and_flags_are_ints(spark):
    df = rows(spark, [(7,), (10,), (None,)], "h int")
    got = [r[0] for r in df.select(X.is_peak_hour("h")).collect()]
    assert got == [1, 0, 0]


def test_clip_keeps_nulls(spark):
    df = rows(spark, [(10.0,), (200.0,), (None,)], "y double")
    got = [r[0] for r in df.select(X.clip("y", 15, 180)).collect()]
    assert got == [15.0, 180.0, None]


def test_late_label_null_counts_not_late(spark):
    df = rows(spark, [(15.0,), (15.5,), (None,)], "y double")
    assert [r[0] for r in df.select(X.late_label("y")).collect()] == [0, 1, 0]


def test_nan_becomes_null_at_read(spark):
    df = _nan_to_null(rows(spark, [(float("nan"),), (16.0,)], "y double"))
    got = [r[0] for r in df.select(X.late_label("y")).collect()]
    assert got == [0, 1]


def test_route_concat_null_propagates(spark):
    df = rows(spark, [("A", "B"), (None, "B")], "ORIGIN_AIRPORT string, DESTINATION_AIRPORT string")
    assert [r[0] for r in df.select(X.route()).collect()] == ["A-B", None]


def test_haversine_matches_python(spark):
    lat1, lon1, lat2, lon2 = 40.64, -73.78, 33.94, -118.41

    def py(a, b, c, d):
        r = 3958.8
        p1, p2 = math.radians(a), math.radians(c)
        dl, dn = math.radians(c - a), math.radians(d - b)
        h = math.sin(dl / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dn / 2) ** 2
        return r * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
    df = rows(spark, [(lat1, lon1, lat2, lon2), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(X.haversine_miles("a", "b", "c", "d")).collect()]
    assert abs(got[0] - py(lat1, lon1, lat2, lon2)) < 1e-9
    assert got[1] is None


def test_bround_half_even(spark):
    df = rows(spark, [(2.5,), (3.5,), (0.25,)], "x double")
    assert [r[0] for r in df.select(X.round_half_even("x", 0)).collect()][:2] == [2.0, 4.0]


def test_missing_fields_and_reply(spark):
    df = rows(spark, [(1, None, "x"), (1, 2, "y")], "a int, b int, c string")
    out = df.select(X.missing_fields(["a", "b", "c"]).alias("m")).withColumn(
        "reply", X.reply_fallback(F.lit(None).cast("double"), "m")).collect()
    assert out[0]["m"] == ["b"] and out[0]["reply"] == "To complete the prediction, I still need: b."
    assert out[1]["m"] == [] and out[1]["reply"] == "How can I help you predict your flight delay?"


def test_json_parse_tolerates_bad_records(spark):
    df = rows(spark, [('{"k": 3}',), ("not json",), (None,)], "p string")
    got = [r[0] for r in df.select(X.parse_json("p", "k INT")["k"]).collect()]
    assert got == [3, None, None]


def test_timestamp_parts_iso_weekday(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-07 13:45:00' AS ts")   # a Sunday
    r = df.select(*X.timestamp_parts("ts")).first()
    assert r["iso_weekday"] == 7 and r["weekday_name"] == "Sunday" and r["hour"] == 13


def test_flights_csv_reader(spark, tmp_path):
    import pytest
    from skylag.sources.tables import FLIGHTS, load_flight_data
    names = [f.name for f in FLIGHTS.fields]
    row = {n: "" for n in names}
    row.update({"YEAR": "2015", "MONTH": "1", "DAY": "1", "DAY_OF_WEEK": "4", "AIRLINE": "AA", "TAIL_NUMBER": "N1",
                "ORIGIN_AIRPORT": "JFK", "DESTINATION_AIRPORT": "LAX", "SCHEDULED_DEPARTURE": "5",
                "DISTANCE": "2475", "SCHEDULED_ARRIVAL": "430", "ARRIVAL_DELAY": "NaN", "DIVERTED": "0", "CANCELLED": "0"})
    d = tmp_path / "data"
    d.mkdir()
    (d / "flights.csv").write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    (d / "airports.csv").write_text("IATA_CODE,AIRPORT,CITY,STATE,COUNTRY,LATITUDE,LONGITUDE\n"
                                    "JFK,John F. Kennedy,New York,NY,USA,40.64,-73.78\nECP,Beaches,Panama City,FL,USA,,\n")
    (d / "airlines.csv").write_text("IATA_CODE,AIRLINE\nAA,American Airlines Inc.\n")
    t = load_flight_data(spark, str(d))
    r = t["flights"].first()
    assert r["SCHEDULED_DEPARTURE"] == 5 and r["DISTANCE"] == 2475.0 and r["ARRIVAL_DELAY"] is None
    assert t["airports"].filter("IATA_CODE = 'ECP'").first()["LATITUDE"] is None
    (d / "flights.csv").write_text(",".join(reversed(names)) + "\n" + ",".join(row[n] for n in reversed(names)) + "\n")
    with pytest.raises(Exception):
        load_flight_data(spark, str(d))["flights"].collect()
    with pytest.raises(FileNotFoundError):
        load_flight_data(spark, str(tmp_path / "missing"))
