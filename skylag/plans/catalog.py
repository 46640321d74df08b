"""Registered queries: one per operator family of the inventory.

Each entry pairs a Spark callable ``(spark, data_dir) -> DataFrame`` built
from the library's operators with, where SQL can express it, an
independent DuckDB text over the same Parquet tables. Doubles that are
derived (means, rates, trigonometry) are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..operators import clean as P
from ..operators import encode as E
from ..operators import features as FE
from ..operators import lookups as J
from ..operators import metrics as M
from ..operators import profile as PR
from ..operators import search as S
from ..operators import sessions as K
from ..operators import stats as A
from ..session import materialize
from ..sources import fixtures as FX
from ..sources import tables as TB
from .sqltext import DIST_CASE, FEATURE_CTES, LATE, TEST, TRAIN, featured, slot_case, with_

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 digits."""
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- shared Spark inputs ------------------------------------------------------

def trips(spark, d):
    return FX.trips(spark, d)


def written_trips(spark, d):
    """The trips, joined once and written in even parts."""
    return materialize(TB.dealt(trips(spark, d)), "trips")


def cleaned(spark, d):
    return P.clean_flights(trips(spark, d))


def prepared(spark, d, flights=None):
    return FE.add_route_features(FE.preprocess_flights(trips(spark, d) if flights is None else flights))


def eda(spark, d):
    return FE.with_route_and_hours(P.eda_filter(trips(spark, d)))


def fitted(spark, d):
    tr, te = P.split_by_month(prepared(spark, d))
    return E.fit_features(tr), tr, te


def scored_test(spark, d, fits=None):
    """Hold-out rows with a deterministic score: the train-fitted late rate
    of the row's route (no model needed, so the metric queries have a SQL
    oracle). ``fits`` is a result of ``fitted`` to use again."""
    fm, _, te = fits or fitted(spark, d)
    t = fm.transform(te)
    return t.select(X.late_label("ARRIVAL_DELAY").alias("label"), F.col("ROUTE_DELAY_RATE_15").alias("score"),
                    F.col("ARRIVAL_DELAY").alias("y"), F.col("ROUTE_DELAY_MEAN").alias("pred"), "DEP_HOUR")


SCORED_SQL = featured("te", "ft") + (
    ", scored AS (SELECT CASE WHEN ARRIVAL_DELAY > 15 THEN 1 ELSE 0 END AS label, ROUTE_DELAY_RATE_15 AS score, "
    "ARRIVAL_DELAY AS y, ROUTE_DELAY_MEAN AS pred, DEP_HOUR FROM ft)")


def scored_with(body: str, extra=()) -> str:
    return with_(["te"] + FEATURE_CTES, body, extra=[SCORED_SQL, *extra])


# ============================================================================
# Sources (S1, S2)

ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "embeddings", "conversations", "documents", "labels", "pages", "benchmark"]


@query("s1_load_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ALL_TABLES))
def s1_load_tables(spark, d):
    """Every driver table read with its explicit schema after an
    existence check; row count per table."""
    tabs = TB.load_raw_tables(spark, d, ALL_TABLES)
    out = None
    for name, df in tabs.items():
        c = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = c if out is None else out.unionByName(c)
    return out


@query("s2_dimensions", with_(["airports", "airlines"],
       "SELECT 'airport' AS kind, IATA_CODE, AIRPORT AS name, LATITUDE, LONGITUDE FROM airports "
       "UNION ALL SELECT 'airline', IATA_CODE, AIRLINE, NULL, NULL FROM airlines"))
def s2_dimensions(spark, d):
    """The two dimensions."""
    ap = FX.airports(spark, d)
    al = FX.airlines(spark, d)
    return (ap.select(F.lit("airport").alias("kind"), "IATA_CODE", F.col("AIRPORT").alias("name"),
                      "LATITUDE", "LONGITUDE")
              .unionByName(al.select(F.lit("airline").alias("kind"), "IATA_CODE", F.col("AIRLINE").alias("name"),
                                     F.lit(None).cast("double").alias("LATITUDE"),
                                     F.lit(None).cast("double").alias("LONGITUDE"))))


# ============================================================================
# Filters and projections

CLEAN_COLS = ("flight_id, \"YEAR\", \"MONTH\", \"DAY\", DAY_OF_WEEK, AIRLINE, TAIL_NUMBER, ORIGIN_AIRPORT, "
              "DESTINATION_AIRPORT, SCHEDULED_DEPARTURE, SCHEDULED_ARRIVAL, DISTANCE, ARRIVAL_DELAY")


@query("p1_clean_flights", with_(["clean"], f"SELECT {CLEAN_COLS} FROM clean"))
def p1_clean_flights(spark, d):
    """P1 + P2: cleaned modelling frame."""
    return cleaned(spark, d)


@query("p2_drop_leakage", with_(["trips"], "SELECT * EXCLUDE (CANCELLED, DIVERTED) FROM trips"))
def p2_drop_leakage(spark, d):
    """Post-departure columns removed where present (no row filter)."""
    return P.drop_leakage(trips(spark, d))


@query("p3_eda_filter", with_(["eda"], "SELECT flight_id, \"MONTH\", ROUTE, DEP_HOUR, ARR_HOUR, ARRIVAL_DELAY, DIVERTED FROM eda"))
def p3_eda_filter(spark, d):
    """Exploratory frame (diverted rows kept)."""
    return eda(spark, d).select("flight_id", "MONTH", "ROUTE", "DEP_HOUR", "ARR_HOUR", "ARRIVAL_DELAY", "DIVERTED")


@query("p4_split_by_month", with_(["clean"],
       f"SELECT 'train' AS split, \"MONTH\", count(*) AS n, sum(ARRIVAL_DELAY) AS sum_delay FROM clean "
       f"WHERE \"MONTH\" IN {TRAIN} GROUP BY \"MONTH\" UNION ALL "
       f"SELECT 'test', \"MONTH\", count(*), sum(ARRIVAL_DELAY) FROM clean WHERE \"MONTH\" IN {TEST} GROUP BY \"MONTH\""))
def p4_split_by_month(spark, d):
    """Temporal split; rows and delay sum per split and month."""
    tr, te = P.split_by_month(cleaned(spark, d))
    agg = lambda df, s: df.groupBy(F.lit(s).alias("split"), "MONTH").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ARRIVAL_DELAY").alias("sum_delay"))
    return agg(tr, "train").unionByName(agg(te, "test"))


@query("p5_temporal_folds", with_(["clean"],
       "SELECT 0 AS fold, 'train' AS role, flight_id, \"MONTH\" FROM clean WHERE \"MONTH\" <= 6 UNION ALL "
       "SELECT 0, 'validation', flight_id, \"MONTH\" FROM clean WHERE \"MONTH\" BETWEEN 7 AND 8 UNION ALL "
       "SELECT 1, 'train', flight_id, \"MONTH\" FROM clean WHERE \"MONTH\" <= 8 UNION ALL "
       "SELECT 1, 'validation', flight_id, \"MONTH\" FROM clean WHERE \"MONTH\" BETWEEN 9 AND 10"))
def p5_temporal_folds(spark, d):
    """P5: expanding temporal folds as a long (fold, role, row) table."""
    return P.temporal_folds(cleaned(spark, d).select("flight_id", "MONTH"))


REQ_SQL = ("req AS (SELECT flight_id, \"MONTH\" AS month, DAY_OF_WEEK AS day_of_week, "
           "CAST(SCHEDULED_DEPARTURE // 100 AS INTEGER) AS scheduled_departure_hour, "
           "CAST(SCHEDULED_ARRIVAL // 100 AS INTEGER) AS scheduled_arrival_hour, "
           "ORIGIN_AIRPORT AS origin_airport_code, DESTINATION_AIRPORT AS destination_airport_code, "
           "AIRLINE AS airline_code, DISTANCE AS distance FROM trips)")


def requests(spark, d):
    """Scoring requests shaped from trips (hours are HHMM // 100, so 24 occurs
    and is rejected by validation)."""
    return as_requests(trips(spark, d))


def as_requests(t):
    """``requests`` of given trips."""
    return t.select("flight_id", F.col("MONTH").alias("month"), F.col("DAY_OF_WEEK").alias("day_of_week"),
                    F.floor(F.col("SCHEDULED_DEPARTURE") / 100).cast("int").alias("scheduled_departure_hour"),
                    F.floor(F.col("SCHEDULED_ARRIVAL") / 100).cast("int").alias("scheduled_arrival_hour"),
                    F.col("ORIGIN_AIRPORT").alias("origin_airport_code"),
                    F.col("DESTINATION_AIRPORT").alias("destination_airport_code"),
                    F.col("AIRLINE").alias("airline_code"), F.col("DISTANCE").alias("distance"))


def _p6_sql() -> str:
    checks = [f"CASE WHEN {n} IS NULL OR {n} < {lo} OR {n} > {hi} THEN '{n} must be in [{lo}, {hi}]' END"
              for n, lo, hi in C.REQUEST_RULES]
    checks += [f"CASE WHEN {n} IS NULL OR length({n}) < 1 THEN '{n} must not be empty' END"
               for n in ("origin_airport_code", "destination_airport_code", "airline_code")]
    checks.append("CASE WHEN distance IS NULL OR isnan(distance) OR distance < 0 THEN 'distance must be >= 0' END")
    errs = "concat_ws('; ', " + ", ".join(checks) + ")"
    return with_(["trips"], f"SELECT flight_id, errors FROM (SELECT flight_id, {errs} AS errors FROM req) "
                 "WHERE errors <> ''", extra=[REQ_SQL])


@query("p6_validate_requests", _p6_sql())
def p6_validate_requests(spark, d):
    """Quarantined requests with their reasons (valid rows continue)."""
    _, bad = P.split_valid(requests(spark, d))
    return bad.select("flight_id", F.array_join("errors", "; ").alias("errors"))


@query("p7_late_rows", with_(["clean"], f"SELECT {CLEAN_COLS} FROM clean WHERE ARRIVAL_DELAY > 15"))
def p7_late_rows(spark, d):
    """Late rows of the cleaned frame."""
    return P.late_rows(cleaned(spark, d))


@query("p8_feature_projection", with_(["prep"],
       "SELECT round(MONTH_SIN, 6) AS MONTH_SIN, round(MONTH_COS, 6) AS MONTH_COS, round(DAY_SIN, 6) AS DAY_SIN, "
       "round(DAY_COS, 6) AS DAY_COS, round(DEP_HOUR_SIN, 6) AS DEP_HOUR_SIN, round(DEP_HOUR_COS, 6) AS DEP_HOUR_COS, "
       "round(ARR_HOUR_SIN, 6) AS ARR_HOUR_SIN, round(ARR_HOUR_COS, 6) AS ARR_HOUR_COS, IS_WEEKEND, IS_SUMMER, "
       "IS_HOLIDAY_SEASON, DEP_TIME_SLOT, DEP_IS_PEAK_HOUR, DEP_IS_RED_EYE, ARR_TIME_SLOT, ARR_IS_PEAK_HOUR, "
       "ARR_IS_RED_EYE, ORIGIN_AIRPORT, DESTINATION_AIRPORT, AIRLINE FROM prep"))
def p8_feature_projection(spark, d):
    """P8 + P13: project the classification features that exist before
    fitting (columns absent from the frame are skipped)."""
    pre = FE.preprocess_flights(trips(spark, d))
    return r6(P.select_features(pre, P.existing(pre, C.FEATURES_CLS)))


@query("p9_ensure_columns", with_(["prep"],
       "SELECT flight_id, IS_WEEKEND, DEP_IS_PEAK_HOUR, 0 AS IS_ORIGIN_HUB, 0 AS IS_DEST_HUB, "
       "0 AS \"DEP_TIME_SLOT_morning\" FROM prep"))
def p9_ensure_columns(spark, d):
    """Required columns in order, absent ones filled with 0."""
    pre = FE.preprocess_flights(trips(spark, d))
    return P.ensure_columns(pre, ["flight_id", "IS_WEEKEND", "DEP_IS_PEAK_HOUR", "IS_ORIGIN_HUB",
                                  "IS_DEST_HUB", "DEP_TIME_SLOT_morning"])


@query("p10_min_support", with_(["eda"],
       "SELECT ROUTE, count(*) AS n FROM eda WHERE ROUTE IS NOT NULL GROUP BY ROUTE HAVING count(*) >= 100"))
def p10_min_support(spark, d):
    """P10: routes with at least 100 flights (HAVING)."""
    g = eda(spark, d).filter(F.col("ROUTE").isNotNull()).groupBy("ROUTE").agg(F.count(F.lit(1)).alias("n"))
    return P.min_support(g, "n")


@query("p11_j6_top_route_stats", with_(["eda"],
       "SELECT ROUTE, round(avg(ARRIVAL_DELAY), 6) AS delay_mean, "
       f"round(avg({LATE}) * 100, 6) AS delay_rate FROM eda WHERE ROUTE IN "
       "(SELECT ROUTE FROM eda WHERE ROUTE IS NOT NULL GROUP BY ROUTE ORDER BY count(*) DESC, ROUTE LIMIT 20) "
       "GROUP BY ROUTE"))
def p11_j6_top_route_stats(spark, d):
    """Rows of the 20 busiest routes (left-semi join on the key
    set), then mean delay and late % per route."""
    e = eda(spark, d)
    top = PR.top_routes(e).select("ROUTE")
    sub = P.in_key_set(e, top, "ROUTE", key_rows=C.TOP_ROUTES)    # a top-20 list: bounded by construction
    g = A.group_stats(sub, "ROUTE", pct=True)
    return r6(g.select("ROUTE", "delay_mean", "delay_rate"))


# ============================================================================
# Scalar functions

@query("f1_f4_time_features", with_(["hours"],
       f"SELECT flight_id, DEP_HOUR, ARR_HOUR, {slot_case('DEP_HOUR')} AS DEP_TIME_SLOT, "
       f"{slot_case('ARR_HOUR')} AS ARR_TIME_SLOT, "
       "CAST(coalesce(DEP_HOUR IN (7, 8, 9, 17, 18, 19, 20), false) AS INTEGER) AS DEP_IS_PEAK_HOUR, "
       "CAST(coalesce(ARR_HOUR IN (0, 1, 2, 3, 4, 5, 21, 22, 23), false) AS INTEGER) AS ARR_IS_RED_EYE, "
       "CAST(coalesce(DEP_HOUR BETWEEN 14 AND 22, false) AS INTEGER) AS NB_DEP_PEAK, "
       "CAST(coalesce(ARR_HOUR BETWEEN 16 AND 23, false) AS INTEGER) AS NB_ARR_PEAK, "
       "CAST(coalesce(DEP_HOUR IN (0, 1, 2, 3, 4, 5), false) AS INTEGER) AS NB_DEP_RED_EYE, "
       "CASE WHEN DEP_HOUR >= 0 AND DEP_HOUR < 6 THEN 'night' WHEN DEP_HOUR >= 6 AND DEP_HOUR < 12 THEN 'morning' "
       "WHEN DEP_HOUR >= 12 AND DEP_HOUR < 18 THEN 'afternoon' ELSE 'evening' END AS NB_DEP_TIME_SLOT FROM hours"))
def f1_f4_time_features(spark, d):
    """F1–F4 (+F3b/F4/F2 notebook variants): hour folding, slots, peak and
    red-eye flags."""
    t = FE.add_time_features(cleaned(spark, d))
    t = t.withColumnsRenamed({"DEP_IS_PEAK_HOUR": "_dep_peak", "ARR_IS_RED_EYE": "_arr_red_eye"})
    nb = FE.add_notebook_time_flags(t)
    return nb.select("flight_id", "DEP_HOUR", "ARR_HOUR", "DEP_TIME_SLOT", "ARR_TIME_SLOT",
                     F.col("_dep_peak").alias("DEP_IS_PEAK_HOUR"), F.col("_arr_red_eye").alias("ARR_IS_RED_EYE"),
                     F.col("DEP_IS_PEAK_HOUR").alias("NB_DEP_PEAK"), F.col("ARR_IS_PEAK_HOUR").alias("NB_ARR_PEAK"),
                     F.col("DEP_IS_RED_EYE").alias("NB_DEP_RED_EYE"),
                     X.time_slot_notebook("DEP_HOUR").alias("NB_DEP_TIME_SLOT"))


@query("f5_f6_calendar_cyclic", with_(["prep"],
       "SELECT flight_id, IS_WEEKEND, IS_SUMMER, IS_HOLIDAY_SEASON, round(MONTH_SIN, 6) AS MONTH_SIN, "
       "round(MONTH_COS, 6) AS MONTH_COS, round(DAY_SIN, 6) AS DAY_SIN, round(DAY_COS, 6) AS DAY_COS, "
       "round(DEP_HOUR_SIN, 6) AS DEP_HOUR_SIN, round(DEP_HOUR_COS, 6) AS DEP_HOUR_COS, "
       "round(ARR_HOUR_SIN, 6) AS ARR_HOUR_SIN, round(ARR_HOUR_COS, 6) AS ARR_HOUR_COS FROM prep"))
def f5_f6_calendar_cyclic(spark, d):
    """F5 + F6 (E7 chain): calendar flags and cyclic encodings."""
    p = FE.preprocess_flights(trips(spark, d))
    return r6(p.select("flight_id", "IS_WEEKEND", "IS_SUMMER", "IS_HOLIDAY_SEASON", "MONTH_SIN", "MONTH_COS",
                       "DAY_SIN", "DAY_COS", "DEP_HOUR_SIN", "DEP_HOUR_COS", "ARR_HOUR_SIN", "ARR_HOUR_COS"))


@query("f7_f8_route_distance", with_(["trips"],
       "SELECT flight_id, ORIGIN_AIRPORT || '-' || DESTINATION_AIRPORT AS ROUTE, "
       f"{DIST_CASE} AS DISTANCE_CAT, "
       "CASE WHEN DISTANCE < 500 THEN 'short' WHEN DISTANCE < 1500 THEN 'medium' ELSE 'long' END AS NB_DISTANCE_CAT "
       "FROM trips"))
def f7_f8_route_distance(spark, d):
    """F7 + F8: route key and distance class (pipeline and notebook forms)."""
    t = trips(spark, d)
    return t.select("flight_id", X.route().alias("ROUTE"), X.distance_class("DISTANCE").alias("DISTANCE_CAT"),
                    X.distance_class_notebook("DISTANCE").alias("NB_DISTANCE_CAT"))


@query("f9_a14_delay_classes", with_(["eda"],
       "SELECT delay_class, count(*) AS n FROM (SELECT CASE WHEN ARRIVAL_DELAY <= 0 THEN 'Early' "
       "WHEN ARRIVAL_DELAY > 0 AND ARRIVAL_DELAY <= 15 THEN 'On-time' "
       "WHEN ARRIVAL_DELAY > 15 AND ARRIVAL_DELAY <= 60 THEN 'Slight delay' "
       "WHEN ARRIVAL_DELAY > 60 THEN 'Severe delay' END AS delay_class FROM eda) WHERE delay_class IS NOT NULL "
       "GROUP BY delay_class"))
def f9_a14_delay_classes(spark, d):
    """F9 + A14: right-closed delay classes and their counts."""
    return PR.delay_class_counts(eda(spark, d))


@query("f10_clip", with_(["eda"],
       "SELECT flight_id, CASE WHEN ARRIVAL_DELAY IS NULL THEN NULL ELSE greatest(-60.0, least(ARRIVAL_DELAY, 180.0)) END "
       "AS clipped, CASE WHEN ARRIVAL_DELAY > 15 THEN greatest(15.0, least(ARRIVAL_DELAY, 180.0)) END AS late_clipped "
       "FROM eda"))
def f10_clip(spark, d):
    """two-sided clip for the histogram and the regression target."""
    e = eda(spark, d)
    return e.select("flight_id", X.clip("ARRIVAL_DELAY", -60, 180).alias("clipped"),
                    F.when(F.col("ARRIVAL_DELAY") > 15, X.clip("ARRIVAL_DELAY", 15, 180)).alias("late_clipped"))


@query("f12_j2_route_distances", with_(["trips", "airports"],
       "SELECT o AS origin_code, dd AS dest_code, "
       "round(3958.8 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS distance_miles, "
       "CASE WHEN ao.IATA_CODE IS NULL OR ad.IATA_CODE IS NULL THEN 'airport_not_found' "
       "WHEN a IS NULL THEN 'missing_coordinates' END AS error FROM ("
       "SELECT r.o, r.dd, ao.IATA_CODE AS oc, ad.IATA_CODE AS dc, "
       "pow(sin(radians(ad.LATITUDE - ao.LATITUDE) / 2), 2) + cos(radians(ao.LATITUDE)) * cos(radians(ad.LATITUDE)) * "
       "pow(sin(radians(ad.LONGITUDE - ao.LONGITUDE) / 2), 2) AS a, ao.IATA_CODE AS ao_code, ad.IATA_CODE AS ad_code "
       "FROM (SELECT DISTINCT lower(ORIGIN_AIRPORT) AS o, DESTINATION_AIRPORT AS dd FROM trips) r "
       "LEFT JOIN airports ao ON upper(r.o) = ao.IATA_CODE LEFT JOIN airports ad ON upper(r.dd) = ad.IATA_CODE) x "
       "LEFT JOIN airports ao ON x.ao_code = ao.IATA_CODE LEFT JOIN airports ad ON x.ad_code = ad.IATA_CODE"))
def f12_j2_route_distances(spark, d):
    """F12 + F13 + J2: great-circle miles for every route seen in the facts
    (origin given in lower case to exercise the code normalisation);
    unknown codes and missing coordinates give a null distance + reason."""
    pairs = trips(spark, d).select(F.lower("ORIGIN_AIRPORT").alias("origin_code"),
                                   F.col("DESTINATION_AIRPORT").alias("dest_code")).distinct()
    out = J.distance_between(pairs, FX.airports(spark, d))
    return r6(out.select("origin_code", "dest_code", "distance_miles", "error"))


@query("f15_timestamp_parts", with_(["slot_log"],
       "SELECT seq, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, "
       "CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) AS INTEGER) AS iso_weekday, CAST(hour(ts) AS INTEGER) AS hour, "
       "CAST(minute(ts) AS INTEGER) AS minute, dayname(ts) AS weekday_name FROM slot_log"))
def f15_timestamp_parts(spark, d):
    """calendar parts of event timestamps (ISO weekday, day name)."""
    return FX.slot_log(spark, d).select("seq", *X.timestamp_parts("ts"))


@query("f16_f17_round_fill", with_(["trips"],
       "SELECT flight_id, round_even(DISTANCE / 7, 1) AS distance_r1, "
       "coalesce(ARRIVAL_DELAY, -999.0) AS delay_filled FROM trips"))
def f16_f17_round_fill(spark, d):
    """F16 (half-even display rounding) + F17 (fill missing with a
    fallback) over every trip."""
    t = trips(spark, d)
    return t.select("flight_id", X.round_half_even(F.col("DISTANCE") / 7, 1).alias("distance_r1"),
                    X.fill("ARRIVAL_DELAY", -999.0).alias("delay_filled"))


@query("f18_f22_decisions", scored_with(
       "SELECT label, round(score, 6) AS score, (score >= 0.2) AS delayed, "
       "round(CASE WHEN score >= 0.2 THEN pred ELSE 0.0 END, 6) AS minutes, "
       "round(pred - y, 6) AS residual, DEP_HOUR * 100 AS departure_hhmm FROM scored"))
def f18_f22_decisions(spark, d):
    """F18 (label), F20 (p >= t), F21 (second stage only when flagged),
    F22 (residual), F19 (departure hour -> HHMM) over hold-out scores."""
    s = scored_test(spark, d)
    flagged = X.decide("score", 0.2)
    return r6(s.select("label", "score", flagged.alias("delayed"),
                       X.second_stage(flagged, "pred").alias("minutes"),
                       X.residual("pred", "y").alias("residual"),
                       X.hour_to_hhmm("DEP_HOUR").alias("departure_hhmm")))


@query("f24_json_fields", with_(["slot_log"],
       "SELECT seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text, "
       "CAST(to_json({'slot': slot, 'k': CAST(json_extract_string(props, '$.k') AS INTEGER)}) AS VARCHAR) AS record "
       "FROM slot_log"))
def f24_json_fields(spark, d):
    """decode a JSON payload (malformed -> null) and encode a record."""
    lg = FX.slot_log(spark, d)
    parsed = X.parse_json("props", "k INT")
    return lg.select("seq", parsed["k"].alias("k"), X.json_field("props", "$.k").alias("k_text"),
                     F.to_json(F.struct(F.col("slot"), parsed["k"].alias("k"))).alias("record"))


# ============================================================================
# Joins and lookups

@query("j1_airport_lookup", with_(["trips", "airports"],
       "SELECT r.code, a.AIRPORT AS name, a.CITY AS city FROM "
       "(SELECT DISTINCT lower(ORIGIN_AIRPORT) AS code FROM trips UNION SELECT 'zz9') r "
       "LEFT JOIN airports a ON upper(r.code) = a.IATA_CODE"))
def j1_airport_lookup(spark, d):
    """J1 + F13: code -> airport (first match, upper-cased probe; unknown
    -> nulls). Probe codes: every origin in the facts (lower-cased) plus an
    unknown code."""
    t = trips(spark, d)
    codes = t.select(F.lower("ORIGIN_AIRPORT").alias("code")).union(
        spark.range(1).select(F.lit("zz9").alias("code"))).distinct()
    out = J.lookup_codes(codes, "code", FX.airports(spark, d), prefix="a_")
    return out.select("code", F.col("a_AIRPORT").alias("name"), F.col("a_CITY").alias("city"))


@query("j3_historical_features", with_(["te"] + FEATURE_CTES,
       "SELECT flight_id, round(ROUTE_DELAY_MEAN, 6) AS ROUTE_DELAY_MEAN, round(ROUTE_DELAY_RATE_15, 6) AS ROUTE_DELAY_RATE_15, "
       "round(AIRLINE_DELAY_MEAN, 6) AS AIRLINE_DELAY_MEAN, round(AIRLINE_DELAY_RATE_15, 6) AS AIRLINE_DELAY_RATE_15, "
       "round(HOUR_DELAY_MEAN, 6) AS HOUR_DELAY_MEAN, round(HOUR_DELAY_RATE_15, 6) AS HOUR_DELAY_RATE_15, "
       "IS_ORIGIN_HUB, IS_DEST_HUB FROM ft", extra=[featured("te", "ft")]))
def j3_historical_features(spark, d):
    """J3 + F11 (E8): statistics fitted on train months, applied to the
    hold-out months (unseen keys -> global train values)."""
    fm, tr, te = fitted(spark, d)
    t = fm.transform(te)
    return r6(t.select("flight_id", "ROUTE_DELAY_MEAN", "ROUTE_DELAY_RATE_15", "AIRLINE_DELAY_MEAN",
                       "AIRLINE_DELAY_RATE_15", "HOUR_DELAY_MEAN", "HOUR_DELAY_RATE_15",
                       "IS_ORIGIN_HUB", "IS_DEST_HUB"))


@query("j4_e3_target_encoding", with_(["te"] + FEATURE_CTES,
       "SELECT flight_id, round(ROUTE_TE, 6) AS ROUTE_TE, round(ORIGIN_AIRPORT_TE, 6) AS ORIGIN_AIRPORT_TE, "
       "round(DESTINATION_AIRPORT_TE, 6) AS DESTINATION_AIRPORT_TE, round(AIRLINE_TE, 6) AS AIRLINE_TE FROM ft",
       extra=[featured("te", "ft")]))
def j4_e3_target_encoding(spark, d):
    """E3/E4 + J4: target means of the high-cardinality keys from train,
    global-mean fallback, applied to the hold-out rows."""
    fm, tr, te = fitted(spark, d)
    t = fm.transform(te)
    return r6(t.select("flight_id", "ROUTE_TE", "ORIGIN_AIRPORT_TE", "DESTINATION_AIRPORT_TE", "AIRLINE_TE"))


@query("j5_a20_airport_traffic", with_(["tr", "traffic"],
       "SELECT airport, departures, arrivals, total_movements FROM traffic"))
def j5_a20_airport_traffic(spark, d):
    """J5 + A20: departures/arrivals aligned per airport (missing = 0)."""
    tr, _ = P.split_by_month(prepared(spark, d))
    return PR.traffic_table(A.airport_traffic(tr))


@query("a19_hub_airports", with_(["hubs"], "SELECT airport AS HUB_AIRPORT FROM hubs"))
def a19_hub_airports(spark, d):
    """Airports with train traffic >= the 0.90 traffic quantile."""
    tr, _ = P.split_by_month(prepared(spark, d))
    return A.hub_airports(tr)


# ============================================================================
# Aggregations

@query("a1_global_stats", with_(["g"], "SELECT round(gm, 6) AS global_delay_mean, round(gr, 6) AS global_delay_rate FROM g"))
def a1_global_stats(spark, d):
    """A1: train mean delay and late rate."""
    tr, _ = P.split_by_month(prepared(spark, d))
    return r6(A.global_stats(tr))


@query("a2_a3_a5_airline_stats", with_(["eda"],
       "SELECT AIRLINE, round(avg(ARRIVAL_DELAY), 6) AS delay_mean, "
       f"round(avg({LATE}) * 100, 6) AS delay_rate, count(*) AS n FROM eda WHERE AIRLINE IS NOT NULL GROUP BY AIRLINE"))
def a2_a3_a5_airline_stats(spark, d):
    """A2 + A3 + A5: per-airline mean, late % and count."""
    return r6(A.group_stats(eda(spark, d), "AIRLINE", pct=True))


@query("a4_historical_bundle", with_(["tr"],
       "SELECT CASE WHEN grouping(ROUTE) = 0 THEN 'ROUTE' WHEN grouping(AIRLINE) = 0 THEN 'AIRLINE' "
       "WHEN grouping(DEP_HOUR) = 0 THEN 'DEP_HOUR' ELSE 'GLOBAL' END AS level, ROUTE, AIRLINE, DEP_HOUR, "
       f"count(*) AS n, round(avg(ARRIVAL_DELAY), 6) AS delay_mean, round(avg({LATE}), 6) AS delay_rate "
       "FROM tr GROUP BY GROUPING SETS ((ROUTE), (AIRLINE), (DEP_HOUR), ())"))
def a4_historical_bundle(spark, d):
    """A4: route/airline/hour/global mean and late rate in one pass."""
    tr, _ = P.split_by_month(prepared(spark, d))
    return r6(A.historical_bundle(tr))


@query("a6_distinct_routes", with_(["eda"], "SELECT count(DISTINCT ROUTE) AS n_distinct_ROUTE FROM eda"))
def a6_distinct_routes(spark, d):
    """Number of distinct routes."""
    return A.distinct_count(eda(spark, d), "ROUTE")


TRIPS_COLUMNS = ["flight_id", "YEAR", "MONTH", "DAY", "DAY_OF_WEEK", "AIRLINE", "TAIL_NUMBER", "ORIGIN_AIRPORT",
                 "DESTINATION_AIRPORT", "SCHEDULED_DEPARTURE", "SCHEDULED_ARRIVAL", "DISTANCE", "ARRIVAL_DELAY",
                 "CANCELLED", "DIVERTED"]


@query("a7_missing_profile", with_(["trips"],
       "SELECT column_name AS \"column\", missing_count, round_even(missing_count * 100.0 / n, 2) AS missing_pct FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count(\"{c}\") AS missing_count, count(*) AS n "
                            "FROM trips" for c in TRIPS_COLUMNS) + ") WHERE missing_count > 0"))
def a7_missing_profile(spark, d):
    """Null count and percent per column (only columns with nulls)."""
    return PR.missing_profile(trips(spark, d))


@query("a8_a9_delay_quantiles", with_(["tr"],
       "SELECT p, round(value, 6) AS value FROM (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS p, "
       "unnest(quantile_cont(ARRIVAL_DELAY, [0.5, 0.75, 0.9, 0.95, 0.99])) AS value FROM tr WHERE ARRIVAL_DELAY > 15)"))
def a8_a9_delay_quantiles(spark, d):
    """A8 + A9: exact (interpolated) quantiles of late train delays,
    median included."""
    tr, _ = P.split_by_month(prepared(spark, d))
    return r6(A.exact_quantiles(P.late_rows(tr), "ARRIVAL_DELAY", [0.5, 0.75, 0.9, 0.95, 0.99]))


@query("a10_route_mean_range", with_(["eda"],
       "SELECT round(min(m), 6) AS min_delay_mean, round(max(m), 6) AS max_delay_mean FROM "
       "(SELECT avg(ARRIVAL_DELAY) AS m FROM eda WHERE ROUTE IS NOT NULL GROUP BY ROUTE)"))
def a10_route_mean_range(spark, d):
    """A10: range of the per-route mean delay (two-level aggregation)."""
    return r6(A.min_max_of(A.group_stats(eda(spark, d), "ROUTE"), "delay_mean"))


CORR_COLS = ["ARRIVAL_DELAY", "MONTH", "DAY_OF_WEEK", "DEP_HOUR", "DISTANCE", "IS_WEEKEND", "IS_SUMMER"]


def _corr_sql():
    pairs = [(i, j) for i in range(len(CORR_COLS)) for j in range(len(CORR_COLS)) if i >= j]
    sel = " UNION ALL ".join(
        f"SELECT '{CORR_COLS[i]}' AS col_a, '{CORR_COLS[j]}' AS col_b, "
        f"round(corr(CAST(\"{CORR_COLS[i]}\" AS DOUBLE), CAST(\"{CORR_COLS[j]}\" AS DOUBLE)), 6) AS r FROM ce"
        for i, j in pairs)
    return with_(["eda"], sel, extra=[
        "ce AS (SELECT *, CAST(coalesce(DAY_OF_WEEK IN (6, 7), false) AS INTEGER) AS IS_WEEKEND, "
        "CAST(coalesce(\"MONTH\" IN (6, 7, 8), false) AS INTEGER) AS IS_SUMMER FROM eda)"])


@query("a11_correlations", _corr_sql())
def a11_correlations(spark, d):
    """Pearson matrix (lower triangle incl. diagonal) in one pass."""
    e = FE.add_calendar_flags(eda(spark, d))
    return r6(PR.correlation_matrix(e, CORR_COLS))


HIST_CTES = [
    "hx AS (SELECT greatest(-60.0, least(ARRIVAL_DELAY, 180.0)) AS x FROM eda WHERE ARRIVAL_DELAY IS NOT NULL)",
    "hr AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS f, "
    "CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS l FROM hx)",
    "hp AS (SELECT f, l, (l - f) / 100 AS step, 100 / (l - f) AS norm FROM hr)",
    "h0 AS (SELECT x, f, l, step, least(CAST(floor((x - f) * norm) AS INTEGER), 99) AS i0 FROM hx, hp)",
    "h1 AS (SELECT *, CASE WHEN x < (CASE WHEN i0 >= 100 THEN l ELSE f + i0 * step END) THEN i0 - 1 ELSE i0 END AS i1 "
    "FROM h0)",
    "h2 AS (SELECT *, CASE WHEN i1 <> 99 AND x >= (CASE WHEN i1 + 1 >= 100 THEN l ELSE f + (i1 + 1) * step END) "
    "THEN i1 + 1 ELSE i1 END AS bin FROM h1)",
]


@query("a12_histogram", with_(["eda"],
       "SELECT bin, round(CASE WHEN bin >= 100 THEN l ELSE f + bin * step END, 6) AS \"left\", "
       "round(CASE WHEN bin + 1 >= 100 THEN l ELSE f + (bin + 1) * step END, 6) AS \"right\", n FROM "
       "(SELECT bin, any_value(f) AS f, any_value(l) AS l, any_value(step) AS step, count(*) AS n FROM h2 GROUP BY bin)",
       extra=HIST_CTES))
def a12_histogram(spark, d):
    """100-bin histogram of delays clipped to [-60, 180], edges from
    the clipped data's range (NumPy binning)."""
    return r6(PR.histogram(eda(spark, d)))


@query("a13_box_by_distance", with_(["eda"],
       "SELECT DISTANCE_CAT, q1, median, q3, min(CASE WHEN inside THEN ARRIVAL_DELAY END) AS whisker_low, "
       "max(CASE WHEN inside THEN ARRIVAL_DELAY END) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers, "
       "count(*) AS n FROM (SELECT e.DISTANCE_CAT, e.ARRIVAL_DELAY, q.q1, q.median, q.q3, "
       "e.ARRIVAL_DELAY >= q.q1 - 1.5 * (q.q3 - q.q1) AND e.ARRIVAL_DELAY <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside "
       "FROM de e JOIN (SELECT DISTANCE_CAT, quantile_cont(ARRIVAL_DELAY, 0.25) AS q1, "
       "quantile_cont(ARRIVAL_DELAY, 0.5) AS median, quantile_cont(ARRIVAL_DELAY, 0.75) AS q3 FROM de "
       "GROUP BY DISTANCE_CAT) q ON e.DISTANCE_CAT = q.DISTANCE_CAT) GROUP BY DISTANCE_CAT, q1, median, q3",
       extra=["de AS (SELECT ARRIVAL_DELAY, CASE WHEN DISTANCE < 500 THEN 'short' WHEN DISTANCE < 1500 "
              "THEN 'medium' ELSE 'long' END AS DISTANCE_CAT FROM eda)"]))
def a13_box_by_distance(spark, d):
    """Box-plot summary of delay per notebook distance class."""
    e = eda(spark, d).withColumn("DISTANCE_CAT", X.distance_class_notebook("DISTANCE"))
    return r6(PR.box_summary(e, by=["DISTANCE_CAT"]))


@query("a15_distance_class_stats", with_(["eda"],
       "SELECT DISTANCE_CAT, round(avg(ARRIVAL_DELAY), 6) AS mean_delay, "
       f"round(avg({LATE}) * 100, 6) AS delay_rate, count(ARRIVAL_DELAY) AS \"count\" FROM "
       "(SELECT *, CASE WHEN DISTANCE < 500 THEN 'short (<500mi)' WHEN DISTANCE < 1500 THEN 'medium (500-1500mi)' "
       "ELSE 'long (>1500mi)' END AS DISTANCE_CAT FROM eda) GROUP BY DISTANCE_CAT"))
def a15_distance_class_stats(spark, d):
    """A15 (+D6): named mean / late % / count per notebook distance class."""
    label = (F.when(F.col("DISTANCE") < 500, "short (<500mi)").when(F.col("DISTANCE") < 1500, "medium (500-1500mi)")
              .otherwise("long (>1500mi)"))
    return r6(PR.named_stats(eda(spark, d).withColumn("DISTANCE_CAT", label), "DISTANCE_CAT"))


EDA_HUBS = ("eh AS (SELECT airport FROM (SELECT airport, sum(c) AS total FROM (SELECT ORIGIN_AIRPORT AS airport, "
            "1 AS c FROM eda UNION ALL SELECT DESTINATION_AIRPORT, 1 FROM eda) WHERE airport IS NOT NULL "
            "GROUP BY airport) WHERE total >= (SELECT quantile_cont(total, 0.95) FROM (SELECT airport, sum(c) AS total "
            "FROM (SELECT ORIGIN_AIRPORT AS airport, 1 AS c FROM eda UNION ALL SELECT DESTINATION_AIRPORT, 1 FROM eda) "
            "WHERE airport IS NOT NULL GROUP BY airport)))")
EDA_HUB_FLAGS = ("eflag AS (SELECT e.*, CASE WHEN ho.airport IS NULL THEN 0 ELSE 1 END AS IS_ORIGIN_HUB, "
                 "CASE WHEN hd.airport IS NULL THEN 0 ELSE 1 END AS IS_DEST_HUB FROM eda e "
                 "LEFT JOIN eh ho ON e.ORIGIN_AIRPORT = ho.airport LEFT JOIN eh hd ON e.DESTINATION_AIRPORT = hd.airport)")


def eda_with_hubs(spark, d):
    e = eda(spark, d)
    return J.add_hub_flags(e, A.hub_airports(e, C.EDA_HUB_QUANTILE))


@query("a15_hub_origin_stats", with_(["eda"],
       "SELECT IS_ORIGIN_HUB, round(avg(ARRIVAL_DELAY), 6) AS mean_delay, "
       f"round(avg({LATE}) * 100, 6) AS delay_rate, count(ARRIVAL_DELAY) AS \"count\" FROM eflag GROUP BY IS_ORIGIN_HUB",
       extra=[EDA_HUBS, EDA_HUB_FLAGS]))
def a15_hub_origin_stats(spark, d):
    """A15 + F11 + A19 (0.95, EDA): stats by origin hub flag."""
    return r6(PR.named_stats(eda_with_hubs(spark, d), "IS_ORIGIN_HUB"))


@query("a16_f23_hub_combos", with_(["eda"],
       f"SELECT IS_ORIGIN_HUB, IS_DEST_HUB, round(r, 6) AS delay_rate, "
       "CASE WHEN IS_ORIGIN_HUB = 1 THEN 'Hub' ELSE 'Non-Hub' END || '→' || "
       "CASE WHEN IS_DEST_HUB = 1 THEN 'Hub' ELSE 'Non-Hub' END AS combo, "
       "round(avg(r) OVER (), 6) AS mean_of_combos, r > avg(r) OVER () AS above_mean FROM "
       f"(SELECT IS_ORIGIN_HUB, IS_DEST_HUB, avg({LATE}) * 100 AS r FROM eflag GROUP BY IS_ORIGIN_HUB, IS_DEST_HUB)",
       extra=[EDA_HUBS, EDA_HUB_FLAGS]))
def a16_f23_hub_combos(spark, d):
    """A16 + F23 + W1: late % per hub combination vs. their plain mean."""
    return r6(PR.hub_combo_rates(eda_with_hubs(spark, d)))


@query("a17_late_pct", with_(["eda"], f"SELECT round(avg({LATE}) * 100, 6) AS pct_delayed FROM eda"))
def a17_late_pct(spark, d):
    """Overall late percentage of the exploratory frame."""
    return r6(PR.overall_late_pct(eda(spark, d)))


@query("a18_class_balance", with_(["tr"],
       "SELECT count(*) FILTER (WHERE NOT ARRIVAL_DELAY > 15) AS n0, count(*) FILTER (WHERE ARRIVAL_DELAY > 15) AS n1, "
       "round(count(*) FILTER (WHERE NOT ARRIVAL_DELAY > 15) / count(*) FILTER (WHERE ARRIVAL_DELAY > 15), 6) "
       "AS imbalance_ratio FROM tr"))
def a18_class_balance(spark, d):
    """Train class counts and imbalance ratio n0/n1."""
    tr, _ = P.split_by_month(prepared(spark, d))
    return r6(M.class_balance(tr.select(X.late_label("ARRIVAL_DELAY").alias("label"))))


@query("a21_a22_classifier_metrics", scored_with(
       "SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(pr, 6) AS precision, "
       "round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1_score "
       "FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, "
       "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rc FROM ("
       "SELECT count(*) FILTER (WHERE label = 0 AND score < 0.25) AS tn, count(*) FILTER (WHERE label = 0 AND score >= 0.25) AS fp, "
       "count(*) FILTER (WHERE label = 1 AND score < 0.25) AS fn, count(*) FILTER (WHERE label = 1 AND score >= 0.25) AS tp "
       "FROM scored))"))
def a21_a22_classifier_metrics(spark, d):
    """A21 + A22: confusion counts and accuracy/precision/recall/F1 at 0.25."""
    return r6(M.classifier_metrics(scored_test(spark, d), threshold=0.25))


A23_CTES = [
    "cm AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.25)::DOUBLE AS tn, "
    "count(*) FILTER (WHERE label = 0 AND score >= 0.25)::DOUBLE AS fp, "
    "count(*) FILTER (WHERE label = 1 AND score < 0.25)::DOUBLE AS fn, "
    "count(*) FILTER (WHERE label = 1 AND score >= 0.25)::DOUBLE AS tp FROM scored)",
    "pc AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1, "
    "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1, CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0, "
    "CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0 FROM cm)",
    "ff AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1, "
    "CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0, tn + fp AS s0, tp + fn AS s1 FROM pc)",
]


@query("a23_class_report", scored_with(
       "SELECT 'On-time' AS cls, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, s0 AS support FROM ff "
       "UNION ALL SELECT 'Delayed', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM ff "
       "UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM ff "
       "UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6), "
       "round((f0 * s0 + f1 * s1) / (s0 + s1), 6), s0 + s1 FROM ff", extra=A23_CTES))
def a23_class_report(spark, d):
    """Per-class report with macro and weighted averages."""
    return r6(M.class_report(scored_test(spark, d), threshold=0.25))


@query("a24_roc_auc", scored_with(
       "SELECT round(sum(pos * (neg_below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS roc_auc FROM ("
       "SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
       "AS neg_below FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg "
       "FROM scored WHERE score IS NOT NULL GROUP BY score))"))
def a24_roc_auc(spark, d):
    """Exact ROC-AUC of the hold-out pseudo-score (ties = 1/2)."""
    return r6(M.roc_auc(scored_test(spark, d)))


PR_SQL = ("pr AS (SELECT score AS threshold, tp, fp, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, "
          "CASE WHEN P = 0 THEN 0 ELSE tp / P END AS recall FROM (SELECT score, "
          "sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, "
          "sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp, "
          "sum(pos) OVER () AS P FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, "
          "count(*) FILTER (WHERE label <> 1) AS neg FROM scored WHERE score IS NOT NULL GROUP BY score)))")


@query("a25_w4_pr_curve", scored_with(
       "SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
       "round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr", extra=[PR_SQL]))
def a25_w4_pr_curve(spark, d):
    """A25 + W4: precision/recall at every distinct score, via the bucketed
    distributed prefix sum."""
    return r6(M.pr_curve(scored_test(spark, d)))


@query("a26_best_threshold", scored_with(
       "SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       "round(f1, 6) AS f1 FROM (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr) "
       "ORDER BY f1 DESC, threshold ASC LIMIT 1", extra=[PR_SQL]))
def a26_best_threshold(spark, d):
    """F1-optimal decision threshold (lowest wins ties)."""
    return r6(M.best_f1_threshold(scored_test(spark, d)))


@query("a27_a28_regression_metrics", scored_with(
       "SELECT round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, "
       "round(avg(pred - y), 6) AS mean_error, round(stddev_pop(pred - y), 6) AS std_error, "
       "round(avg(abs(y - b)), 6) AS baseline_mae, "
       "round(1 - avg((pred - y) * (pred - y)) / var_pop(y), 6) AS r2, "
       "round(avg(abs(y - b)) - avg(abs(pred - y)), 6) AS mae_improvement "
       "FROM scored, (SELECT avg(ARRIVAL_DELAY) AS b FROM tr WHERE ARRIVAL_DELAY > 15) WHERE y > 15"))
def a27_a28_regression_metrics(spark, d):
    """A27 + A28: MAE/RMSE/R²/error stats of the route-mean prediction on
    late hold-out rows, against the train late-mean baseline (D8)."""
    fits = fitted(spark, d)
    base = P.late_rows(fits[1]).agg(F.avg("ARRIVAL_DELAY")).first()[0]
    s = scored_test(spark, d, fits).filter(F.col("y") > C.DELAY_THRESHOLD)
    return r6(M.regression_metrics(s, baseline=base))


@query("a29_row_funnel", with_(["trips"],
       "SELECT count(*) AS rows_raw, count(*) FILTER (WHERE c) AS rows_clean, "
       f"count(*) FILTER (WHERE c AND \"MONTH\" IN {TRAIN}) AS rows_train, count(*) FILTER (WHERE c AND \"MONTH\" IN {TEST}) AS rows_test, "
       f"count(*) FILTER (WHERE c AND \"MONTH\" IN {TRAIN} AND ARRIVAL_DELAY > 15) AS late_train, "
       f"count(*) FILTER (WHERE c AND \"MONTH\" IN {TEST} AND ARRIVAL_DELAY > 15) AS late_test FROM ("
       "SELECT *, CANCELLED = 0 AND DIVERTED = 0 AND ARRIVAL_DELAY IS NOT NULL AND SCHEDULED_DEPARTURE IS NOT NULL "
       "AND TAIL_NUMBER IS NOT NULL AS c FROM trips)"))
def a29_row_funnel(spark, d):
    """Raw -> clean -> train/test -> late row counts in one pass."""
    return PR.row_funnel(trips(spark, d))


# ============================================================================
# Windows, top-k, set operations

@query("w1_hour_rates_above_mean", with_(["eda"],
       f"SELECT DEP_HOUR, round(r, 6) AS delay_rate, round(avg(r) OVER (), 6) AS mean_of_groups, "
       f"r > avg(r) OVER () AS above_mean FROM (SELECT DEP_HOUR, avg({LATE}) * 100 AS r FROM eda "
       "WHERE DEP_HOUR IS NOT NULL GROUP BY DEP_HOUR)"))
def w1_hour_rates_above_mean(spark, d):
    """W1 + A3: late % by departure hour flagged against the plain mean."""
    g = A.group_stats(eda(spark, d), "DEP_HOUR", pct=True).select("DEP_HOUR", "delay_rate")
    return r6(PR.above_group_mean(g, "delay_rate"))


@query("w3_session_history",
       "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn "
       "FROM conversations) WHERE rn <= 30")
def w3_session_history(spark, d):
    """Last 30 messages per conversation."""
    c = TB.read_table(spark, d, "conversations")
    return K.keep_last(c).select("conv_id", "turn", "role", "text")


@query("t1_top_routes", with_(["eda"],
       "SELECT ROUTE, count(*) AS n FROM eda WHERE ROUTE IS NOT NULL GROUP BY ROUTE ORDER BY n DESC, ROUTE LIMIT 20"))
def t1_top_routes(spark, d):
    """20 busiest routes."""
    return PR.top_routes(eda(spark, d))


BEST_WORST_SQL = with_(["eda"],
    "(SELECT ROUTE, round(mean_delay, 6) AS mean_delay, \"count\", 'best' AS side FROM rs ORDER BY mean_delay ASC, ROUTE LIMIT 5) "
    "UNION ALL (SELECT ROUTE, round(mean_delay, 6) AS mean_delay, \"count\", 'worst' AS side FROM rs "
    "ORDER BY mean_delay DESC, ROUTE LIMIT 5)",
    extra=["rs AS (SELECT ROUTE, avg(ARRIVAL_DELAY) AS mean_delay, count(ARRIVAL_DELAY) AS \"count\" FROM eda "
           "WHERE ROUTE IS NOT NULL GROUP BY ROUTE HAVING count(ARRIVAL_DELAY) >= 100)"])


@query("t2_u1_best_worst_routes", BEST_WORST_SQL)
def t2_u1_best_worst_routes(spark, d):
    """P10 + T2 + U1 (flagship): the 5 best and 5 worst routes by mean
    delay among routes with >= 100 flights."""
    return r6(PR.best_worst_routes(eda(spark, d)))


@query("t3_airlines_by_delay", with_(["eda"],
       "SELECT AIRLINE, round(avg(ARRIVAL_DELAY), 6) AS delay_mean FROM eda WHERE AIRLINE IS NOT NULL GROUP BY AIRLINE "
       "ORDER BY delay_mean DESC, AIRLINE"))
def t3_airlines_by_delay(spark, d):
    """Airlines sorted by mean delay."""
    g = A.group_stats(eda(spark, d), "AIRLINE").select("AIRLINE", "delay_mean")
    return r6(g.orderBy(F.col("delay_mean").desc(), "AIRLINE"))


@query("t4_preview", with_(["trips"], "SELECT * FROM trips ORDER BY flight_id, AIRLINE, ORIGIN_AIRPORT, DESTINATION_AIRPORT, "
       "SCHEDULED_DEPARTURE, ARRIVAL_DELAY LIMIT 20"))
def t4_preview(spark, d):
    """T4: ``head(20)`` made deterministic by a key order."""
    return trips(spark, d).orderBy("flight_id", "AIRLINE", "ORIGIN_AIRPORT", "DESTINATION_AIRPORT",
                                   "SCHEDULED_DEPARTURE", "ARRIVAL_DELAY").limit(20)


# ============================================================================
# Encoding (E1, E5–E9, U2)

@query("e1_one_hot", with_(["routed"],
       "SELECT flight_id, CAST(coalesce(DEP_TIME_SLOT = 'evening', false) AS INTEGER) AS DEP_TIME_SLOT_evening, "
       "CAST(coalesce(DEP_TIME_SLOT = 'morning', false) AS INTEGER) AS DEP_TIME_SLOT_morning, "
       "CAST(coalesce(DEP_TIME_SLOT = 'night', false) AS INTEGER) AS DEP_TIME_SLOT_night, "
       "CAST(coalesce(DISTANCE_CAT = 'medium', false) AS INTEGER) AS DISTANCE_CAT_medium, "
       "CAST(coalesce(DISTANCE_CAT = 'short', false) AS INTEGER) AS DISTANCE_CAT_short FROM routed "
       f"WHERE \"MONTH\" IN {TEST}"))
def e1_one_hot(spark, d):
    """Drop-first one-hot with the TRAIN vocabulary on hold-out rows."""
    tr, te = P.split_by_month(prepared(spark, d))
    vocab = E.one_hot_vocab(tr, ["DEP_TIME_SLOT", "DISTANCE_CAT"])
    return E.one_hot(te, vocab).select("flight_id", *[f"{c}_{v}" for c in vocab for v in vocab[c][1:]])


@query("e5_u2_classification_matrix", with_(["te"] + FEATURE_CTES,
       "SELECT flight_id, round(MONTH_SIN, 6) AS MONTH_SIN, IS_WEEKEND, DEP_IS_PEAK_HOUR, IS_ORIGIN_HUB, IS_DEST_HUB, "
       "round(ROUTE_DELAY_RATE_15, 6) AS ROUTE_DELAY_RATE_15, round(HOUR_DELAY_RATE_15, 6) AS HOUR_DELAY_RATE_15, "
       "CAST(coalesce(DEP_TIME_SLOT = 'evening', false) AS INTEGER) AS DEP_TIME_SLOT_evening, "
       "CAST(coalesce(DISTANCE_CAT = 'short', false) AS INTEGER) AS DISTANCE_CAT_short, "
       "CAST(coalesce(ARR_TIME_SLOT = 'night', false) AS INTEGER) AS ARR_TIME_SLOT_night, "
       "round(ROUTE_TE, 6) AS ROUTE_TE, round(AIRLINE_TE, 6) AS AIRLINE_TE FROM ft", extra=[featured("te", "ft")]))
def e5_u2_classification_matrix(spark, d):
    """E5 + U2: classification matrix columns (dummies and target
    encodings added beside the originals on the same frame)."""
    fm, tr, te = fitted(spark, d)
    m = E.classification_matrix(fm.transform(te), fm, keep=("flight_id",))
    return r6(m.select("flight_id", "MONTH_SIN", "IS_WEEKEND", "DEP_IS_PEAK_HOUR", "IS_ORIGIN_HUB", "IS_DEST_HUB",
                       "ROUTE_DELAY_RATE_15", "HOUR_DELAY_RATE_15", "DEP_TIME_SLOT_evening", "DISTANCE_CAT_short",
                       "ARR_TIME_SLOT_night", "ROUTE_TE", "AIRLINE_TE"))


@query("e6_regression_matrix", with_(["te"] + FEATURE_CTES,
       "SELECT flight_id, DISTANCE, round(ROUTE_DELAY_MEAN, 6) AS ROUTE_DELAY_MEAN, "
       "round(AIRLINE_DELAY_MEAN, 6) AS AIRLINE_DELAY_MEAN, round(HOUR_DELAY_MEAN, 6) AS HOUR_DELAY_MEAN, "
       "round(ORIGIN_AIRPORT_TE, 6) AS ORIGIN_AIRPORT_TE, round(DESTINATION_AIRPORT_TE, 6) AS DESTINATION_AIRPORT_TE "
       "FROM ft", extra=[featured("te", "ft")]))
def e6_regression_matrix(spark, d):
    """Regression matrix columns on hold-out rows."""
    fm, tr, te = fitted(spark, d)
    m = E.regression_matrix(fm.transform(te), fm, keep=("flight_id",))
    return r6(m.select("flight_id", "DISTANCE", "ROUTE_DELAY_MEAN", "AIRLINE_DELAY_MEAN", "HOUR_DELAY_MEAN",
                       "ORIGIN_AIRPORT_TE", "DESTINATION_AIRPORT_TE"))


@query("e7_preprocess", with_(["prep"],
       "SELECT flight_id, DEP_HOUR, ARR_HOUR, DEP_TIME_SLOT, ARR_TIME_SLOT, DEP_IS_RED_EYE, ARR_IS_PEAK_HOUR, "
       "IS_WEEKEND, round(ARR_HOUR_COS, 6) AS ARR_HOUR_COS FROM prep"))
def e7_preprocess(spark, d):
    """Clean -> time -> calendar -> cyclic chain (one projection)."""
    p = FE.preprocess_flights(trips(spark, d))
    return r6(p.select("flight_id", "DEP_HOUR", "ARR_HOUR", "DEP_TIME_SLOT", "ARR_TIME_SLOT", "DEP_IS_RED_EYE",
                       "ARR_IS_PEAK_HOUR", "IS_WEEKEND", "ARR_HOUR_COS"))


@query("e8_train_features", with_(["tr"] + FEATURE_CTES,
       "SELECT flight_id, round(ROUTE_DELAY_MEAN, 6) AS ROUTE_DELAY_MEAN, round(HOUR_DELAY_RATE_15, 6) AS HOUR_DELAY_RATE_15, "
       "IS_ORIGIN_HUB, IS_DEST_HUB, round(DESTINATION_AIRPORT_TE, 6) AS DESTINATION_AIRPORT_TE FROM ft",
       extra=[featured("tr", "ft")]))
def e8_train_features(spark, d):
    """The fitted chain applied back to the training rows (in-sample,
    as the reference does: D13)."""
    fm, tr, te = fitted(spark, d)
    t = fm.transform(tr)
    return r6(t.select("flight_id", "ROUTE_DELAY_MEAN", "HOUR_DELAY_RATE_15", "IS_ORIGIN_HUB", "IS_DEST_HUB",
                       "DESTINATION_AIRPORT_TE"))


# ============================================================================
# Sessions (K1, K2, W2, W5, P12, P14)

SLOTS = ["click", "error", "purchase", "signup", "view"]


def _slot_sql(cols_only=False):
    sel = ", ".join(f"max(CASE WHEN slot = '{s}' AND rn = 1 AND value IS NOT NULL THEN value END) AS {s}" for s in SLOTS)
    return ("st AS (SELECT session_id, " + sel + " FROM (SELECT *, row_number() OVER (PARTITION BY session_id, slot, "
            "value IS NOT NULL ORDER BY ts DESC, seq DESC) AS rn FROM slot_log) GROUP BY session_id)")


@query("k1_w2_slot_state", with_(["slot_log"], "SELECT * FROM st", extra=[_slot_sql()]))
def k1_w2_slot_state(spark, d):
    """K1 + W2: latest non-null value per (session, slot), one row per session."""
    return K.slot_state(FX.slot_log(spark, d), SLOTS)


@query("k1_f24_tool_call_slots", with_(["slot_log"], "SELECT * FROM st", extra=[_slot_sql()]))
def k1_f24_tool_call_slots(spark, d):
    """K1 + F24 in the tool-call form: JSON argument objects parsed with the
    slot schema, latest non-null value per slot and session (must equal
    k1_w2_slot_state on the same events)."""
    return K.slot_state_from_calls(FX.tool_call_log(spark, d), SLOTS)


MISSING_SQL = "concat_ws(', ', " + ", ".join(f"CASE WHEN {s} IS NULL THEN '{s}' END" for s in SLOTS) + ")"


@query("p12_p14_slot_completeness", with_(["slot_log"],
       f"SELECT session_id, {MISSING_SQL} AS missing, ({' AND '.join(f'{s} IS NOT NULL' for s in SLOTS)}) AS complete, "
       f"CASE WHEN NOT ({' AND '.join(f'{s} IS NOT NULL' for s in SLOTS)}) THEN 'missing: ' || {MISSING_SQL} END AS reason "
       "FROM st", extra=[_slot_sql()]))
def p12_p14_slot_completeness(spark, d):
    """P12 + P14: missing-slot list per session and the prediction gate —
    complete sessions pass, the others are rejected with a reason."""
    gated = P.gate(K.slot_state(FX.slot_log(spark, d), SLOTS), SLOTS)
    return gated.select("session_id", F.array_join("missing", ", ").alias("missing"), "complete", "reason")


@query("w5_k2_session_status", with_(["slot_log"],
       f"SELECT st.session_id, {MISSING_SQL} AS missing, ({' AND '.join(f'{s} IS NOT NULL' for s in SLOTS)}) AS complete, "
       "lr.last_k, CASE WHEN lr.last_k IS NOT NULL THEN 'Prediction complete: delay probability ' || "
       "CAST(round_even(lr.last_k / 100.0::DOUBLE * 100, 1) AS VARCHAR) || '%.' "
       f"WHEN NOT ({' AND '.join(f'{s} IS NOT NULL' for s in SLOTS)}) THEN 'To complete the prediction, I still need: ' || "
       f"{MISSING_SQL} || '.' ELSE 'How can I help you predict your flight delay?' END AS reply FROM st LEFT JOIN (SELECT session_id, "
       "arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), (ts, seq)) FILTER "
       "(WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL) AS last_k "
       "FROM slot_log GROUP BY session_id) lr ON st.session_id = lr.session_id", extra=[_slot_sql()]))
def w5_k2_session_status(spark, d):
    """W5 + K2 + F26: slots, missing list, completeness, the latest parsed
    payload carried per session, and the reply fallback text. The payload's
    number stands in for a prediction's percentage."""
    lg = FX.slot_log(spark, d)
    rec = X.parse_json("props", "k INT")
    rec = F.when(rec["k"].isNotNull(), F.struct(rec["k"].alias("k"), (rec["k"] / 100.0).alias("delay_probability")))
    s = K.session_status(lg, SLOTS, rec)
    return s.select("session_id", F.array_join("missing", ", ").alias("missing"), "complete",
                    F.col("last_record.k").alias("last_k"), "reply")


# ============================================================================
# Retrieval

@query("r1_entity_documents", with_(["airports", "airlines"],
       "SELECT 'airport:' || IATA_CODE AS doc_id, format('Airport {}: {}, {}, {}', IATA_CODE, AIRPORT, "
       "CITY, COUNTRY) AS text, 'airport' AS type FROM airports UNION ALL "
       "SELECT 'airline:' || IATA_CODE, format('Airline {}: {}', IATA_CODE, AIRLINE), 'airline' FROM airlines"))
def r1_entity_documents(spark, d):
    """One text document per airport and airline, with metadata."""
    docs = S.entity_documents(FX.airports(spark, d), FX.airlines(spark, d))
    return docs.select("doc_id", "text", F.col("metadata.type").alias("type"))


@query("r2_j7_t6_vector_search",
       "SELECT query_id, match_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT "
       "q.vec_id AS query_id, c.vec_id AS match_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance, "
       "row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), "
       "c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def r2_j7_t6_vector_search(spark, d):
    """R2 + J7 + T6: exact L2 top-5 neighbours, among all embeddings, of the
    query set (ids divisible by 100)."""
    e = TB.read_table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return r6(S.knn(q, e, k=C.SEARCH_K, metric="l2"))


@query("r2_cosine_search",
       "SELECT query_id, match_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT "
       "q.vec_id AS query_id, c.vec_id AS match_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance, "
       "row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(q.embedding::DOUBLE[], "
       "c.embedding::DOUBLE[]), c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def r2_cosine_search(spark, d):
    """R2 with the cosine metric (D9: the metric is explicit)."""
    e = TB.read_table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return r6(S.knn(q, e, k=C.SEARCH_K, metric="cosine"))


def resolved_sql(names: str, ents: str) -> str:
    """Every distinct name against every entity (name_id, name; entity_id, code, entity_name)."""
    grams = "unnest(list_transform(range(1, len(p) - 1), lambda i: substr(p, i, 3)))"
    return (f"WITH names AS ({names}), ents AS ({ents}), "
            f"eg AS (SELECT entity_id, gram, count(*) AS tf FROM (SELECT entity_id, {grams} AS gram FROM "
            "(SELECT entity_id, '  ' || lower(entity_name) || ' ' AS p FROM ents)) GROUP BY ALL), "
            f"ng AS (SELECT name, gram, count(*) AS tf FROM (SELECT name, {grams} AS gram FROM "
            "(SELECT DISTINCT name, '  ' || lower(name) || ' ' AS p FROM names WHERE name IS NOT NULL)) GROUP BY ALL), "
            "idf AS (SELECT gram, ln((SELECT count(*) + 1 FROM ents) / (count(*) + 1)) AS idf FROM eg GROUP BY gram), "
            "ew AS (SELECT entity_id, gram, tf * idf AS x FROM eg JOIN idf USING (gram)), "
            "nw AS (SELECT name, gram, tf * coalesce(idf, ln((SELECT count(*) + 1 FROM ents))) AS x FROM ng LEFT JOIN idf USING (gram)), "
            "en AS (SELECT entity_id, sqrt(sum(x * x)) AS l FROM ew GROUP BY entity_id), "
            "nn AS (SELECT name, sqrt(sum(x * x)) AS l FROM nw GROUP BY name), "
            "dots AS (SELECT name, entity_id, sum(nw.x * ew.x) AS s FROM nw JOIN ew USING (gram) GROUP BY ALL), "
            "dist AS (SELECT nn.name, en.entity_id, CASE WHEN nn.l > 0 AND en.l > 0 "
            "THEN round(greatest(0.0::DOUBLE, 1 - coalesce(s, 0) / (nn.l * en.l)), 9) ELSE 1.0::DOUBLE END AS d "
            "FROM nn CROSS JOIN en LEFT JOIN dots ON dots.name = nn.name AND dots.entity_id = en.entity_id), "
            "best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, entity_id) <= 5), "
            "ranked AS (SELECT name, d, code, row_number() OVER (PARTITION BY name "
            "ORDER BY d, levenshtein(lower(name), lower(entity_name)), code) AS r FROM best JOIN ents USING (entity_id)), "
            "top AS (SELECT name, min(d) AS d, min_by(code, r) AS code, string_agg(code, ',' ORDER BY r) AS candidates "
            "FROM ranked GROUP BY name), "
            "exact AS (SELECT upper(code) AS u, min(code) AS code FROM ents GROUP BY 1) "
            "SELECT name_id, coalesce(exact.code, top.code) AS code, CASE WHEN exact.code IS NOT NULL THEN 'exact' "
            "WHEN names.name IS NOT NULL THEN 'similarity' END AS \"match\", round(d, 6) AS best_distance, candidates "
            "FROM names LEFT JOIN top ON names.name = top.name LEFT JOIN exact ON upper(names.name) = exact.u")


def _resolved(names, ents):
    return S.resolve_names(names, ents).select(
        "name_id", "code", "match", F.round("best_distance", 6).alias("best_distance"),
        F.array_join("candidates", ",").alias("candidates"))


def nation_entities(spark, d):
    return TB.read_table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("entity_id"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
        F.col("n_name").alias("entity_name"))


NATION_ENTITIES_SQL = ("SELECT n_nationkey::BIGINT AS entity_id, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS code, "
                       "n_name AS entity_name FROM nation")


@query("r3_resolve_names", resolved_sql("SELECT p_partkey AS name_id, p_name AS name FROM part", NATION_ENTITIES_SQL))
def r3_resolve_names(spark, d):
    """Resolve every part name to the closest nation name
    (character-trigram TF-IDF cosine; exact code first)."""
    names = TB.read_table(spark, d, "part").select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"))
    return _resolved(names, nation_entities(spark, d))


@query("r3_codes_and_names", resolved_sql(
    "SELECT c_custkey AS name_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'n' || lpad(c_nationkey::VARCHAR, 2, '0') "
    "WHEN c_mktsegment = 'FURNITURE' THEN 'port of ' || lower(n_name) || ' ' || r_name "
    "WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN c_acctbal >= 0 THEN replace(n_name, 'NATION', 'ntion') ELSE '' END "
    "WHEN c_mktsegment = 'MACHINERY' THEN CASE WHEN c_acctbal >= 0 THEN c_name END ELSE n_name END AS name "
    "FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
    NATION_ENTITIES_SQL + " UNION ALL SELECT 100 + r_regionkey, 'R' || r_regionkey::VARCHAR, r_name FROM region"))
def r3_codes_and_names(spark, d):
    """Codes in lower case (exact), misspelled, embedded, foreign, empty
    and null names of all customers, among nations and regions."""
    region = TB.read_table(spark, d, "region")
    nation = TB.read_table(spark, d, "nation")
    seg, rich = F.col("c_mktsegment"), F.col("c_acctbal") >= 0
    names = (TB.read_table(spark, d, "customer")
             .join(F.broadcast(nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")),
                   F.col("n_nationkey") == F.col("c_nationkey"), "left")  # nations and regions: a bounded list
             .select(F.col("c_custkey").alias("name_id"),
                     F.when(seg == "BUILDING", F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))
                     .when(seg == "FURNITURE", F.concat(F.lit("port of "), F.lower("n_name"), F.lit(" "), "r_name"))
                     .when(seg == "HOUSEHOLD", F.when(rich, F.replace("n_name", F.lit("NATION"), F.lit("ntion"))).otherwise(""))
                     .when(seg == "MACHINERY", F.when(rich, F.col("c_name"))).otherwise(F.col("n_name")).alias("name")))
    ents = nation_entities(spark, d).unionByName(region.select(
        (F.col("r_regionkey") + 100).cast("long").alias("entity_id"),
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("entity_name")))
    return _resolved(names, ents)


# ============================================================================
# Reports, persistence round trips and the metrics table

@query("f25_prediction_report", with_(["te", "airports", "airlines"] + FEATURE_CTES,
       "SELECT flight_id, concat_ws(chr(10), "
       "'Origin airport: ' || CASE WHEN ao.AIRPORT IS NOT NULL THEN ao.AIRPORT || ' (' || f.ORIGIN_AIRPORT || ')' "
       "ELSE f.ORIGIN_AIRPORT END, "
       "'Destination airport: ' || CASE WHEN ad.AIRPORT IS NOT NULL THEN ad.AIRPORT || ' (' || f.DESTINATION_AIRPORT || ')' "
       "ELSE f.DESTINATION_AIRPORT END, "
       "'Airline: ' || coalesce(al.AIRLINE, f.AIRLINE), "
       "'Departure time: ' || CAST(f.DEP_HOUR AS VARCHAR) || ':00', "
       "'Delay probability: ' || CAST(round_even(f.ROUTE_DELAY_RATE_15 * 100, 1) AS VARCHAR) || '%', "
       "'Model prediction: ' || CASE WHEN f.ROUTE_DELAY_RATE_15 >= 0.25 THEN 'delayed' ELSE 'on time' END, "
       "CASE WHEN CAST(round_even(CASE WHEN f.ROUTE_DELAY_RATE_15 >= 0.25 THEN f.ROUTE_DELAY_MEAN ELSE 0.0 END, 0) "
       "AS BIGINT) > 0 THEN 'Estimated delay (if delayed): ' || CAST(CAST(round_even(f.ROUTE_DELAY_MEAN, 0) AS BIGINT) "
       "AS VARCHAR) || ' minutes' ELSE '' END) AS report "
       "FROM ft f LEFT JOIN airports ao ON f.ORIGIN_AIRPORT = ao.IATA_CODE "
       "LEFT JOIN airports ad ON f.DESTINATION_AIRPORT = ad.IATA_CODE LEFT JOIN airlines al ON f.AIRLINE = al.IATA_CODE",
       extra=[featured("te", "ft")]))
def f25_prediction_report(spark, d):
    """F25 + J1: the prediction report for every hold-out flight — names
    in place of codes (dimension lookups), probability in percent with one
    half-even decimal, decision, and the minutes line only when > 0. The
    probability is the train-fitted route late rate, the minutes the route
    mean (a deterministic stand-in for the model so SQL can check it)."""
    fm, tr, te = fitted(spark, d)
    t = fm.transform(te)
    ap, al = FX.airports(spark, d), FX.airlines(spark, d)
    t = J.lookup_codes(t, "ORIGIN_AIRPORT", ap.select("IATA_CODE", "AIRPORT"), prefix="o_")
    t = J.lookup_codes(t, "DESTINATION_AIRPORT", ap.select("IATA_CODE", "AIRPORT"), prefix="d_")
    t = J.lookup_codes(t, "AIRLINE", al, prefix="a_")
    flagged = X.decide("ROUTE_DELAY_RATE_15", 0.25)
    t = t.withColumns({"_p": F.col("ROUTE_DELAY_RATE_15"), "_flag": flagged,
                       "_min": X.second_stage(flagged, "ROUTE_DELAY_MEAN")})
    rep = X.prediction_report("o_AIRPORT", "ORIGIN_AIRPORT", "d_AIRPORT", "DESTINATION_AIRPORT", "a_AIRLINE",
                              "AIRLINE", "DEP_HOUR", "_p", "_flag", "_min")
    return t.select("flight_id", rep.alias("report"))


@query("a11_target_correlations", with_(["eda"],
       " UNION ALL ".join(
           f"SELECT '{c}' AS feature, round(corr(ARRIVAL_DELAY, CAST(\"{c}\" AS DOUBLE)), 6) AS r FROM ce"
           for c in ["MONTH", "DAY_OF_WEEK", "DEP_HOUR", "DISTANCE", "IS_WEEKEND", "IS_SUMMER"]),
       extra=["ce AS (SELECT *, CAST(coalesce(DAY_OF_WEEK IN (6, 7), false) AS INTEGER) AS IS_WEEKEND, "
              "CAST(coalesce(\"MONTH\" IN (6, 7, 8), false) AS INTEGER) AS IS_SUMMER FROM eda)"]))
def a11_target_correlations(spark, d):
    """Correlation of each pre-departure column with the target."""
    e = FE.add_calendar_flags(eda(spark, d))
    return r6(PR.target_correlations(e, ["MONTH", "DAY_OF_WEEK", "DEP_HOUR", "DISTANCE", "IS_WEEKEND", "IS_SUMMER"]))


def _saved_and_loaded(spark, d):
    from ..session import shared_path
    fm, tr, te = fitted(spark, d)
    path = shared_path(spark, "feature-model")
    fm.save(path)
    return E.FeatureModel.load(spark, path), te


@query("s3_stats_roundtrip", with_(["tr"],
       "SELECT CASE WHEN grouping(ROUTE) = 0 THEN 'ROUTE' WHEN grouping(AIRLINE) = 0 THEN 'AIRLINE' "
       "WHEN grouping(DEP_HOUR) = 0 THEN 'DEP_HOUR' ELSE 'GLOBAL' END AS level, ROUTE, AIRLINE, DEP_HOUR, "
       f"count(*) AS n, round(avg(ARRIVAL_DELAY), 6) AS delay_mean, round(avg({LATE}), 6) AS delay_rate "
       "FROM tr GROUP BY GROUPING SETS ((ROUTE), (AIRLINE), (DEP_HOUR), ())"))
def s3_stats_roundtrip(spark, d):
    """S3 + S4: fitted statistics written as typed Parquet and read back."""
    fm, _ = _saved_and_loaded(spark, d)
    s = fm.stats.filter(F.col("level").isin("ROUTE", "AIRLINE", "DEP_HOUR", "GLOBAL"))
    return r6(s.select("level", "ROUTE", "AIRLINE", "DEP_HOUR", "n", "delay_mean", "delay_rate"))


@query("e4_stored_target_encoding", with_(["te"] + FEATURE_CTES,
       "SELECT flight_id, round(ROUTE_TE, 6) AS ROUTE_TE, round(ORIGIN_AIRPORT_TE, 6) AS ORIGIN_AIRPORT_TE, "
       "round(DESTINATION_AIRPORT_TE, 6) AS DESTINATION_AIRPORT_TE, round(AIRLINE_TE, 6) AS AIRLINE_TE, "
       "round(HOUR_DELAY_MEAN, 6) AS HOUR_DELAY_MEAN FROM ft", extra=[featured("te", "ft")]))
def e4_stored_target_encoding(spark, d):
    """E4 (+D1): encodings applied from the SAVED statistics; the int hour
    key still matches after the reload."""
    fm, te = _saved_and_loaded(spark, d)
    t = fm.transform(te)
    return r6(t.select("flight_id", "ROUTE_TE", "ORIGIN_AIRPORT_TE", "DESTINATION_AIRPORT_TE", "AIRLINE_TE",
                       "HOUR_DELAY_MEAN"))


S6_CTES = [
    "cm AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.25)::DOUBLE AS tn, "
    "count(*) FILTER (WHERE label = 0 AND score >= 0.25)::DOUBLE AS fp, "
    "count(*) FILTER (WHERE label = 1 AND score < 0.25)::DOUBLE AS fn, "
    "count(*) FILTER (WHERE label = 1 AND score >= 0.25)::DOUBLE AS tp FROM scored)",
    "pr1 AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, "
    "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM cm)",
    "auc AS (SELECT sum(pos * (neg_below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS v FROM ("
    "SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS neg_below FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg "
    "FROM scored WHERE score IS NOT NULL GROUP BY score)))",
    "rg AS (SELECT avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse, "
    "1 - avg((pred - y) * (pred - y)) / var_pop(y) AS r2 FROM scored WHERE y > 15)",
]


@query("s6_metrics_table", scored_with(
       "SELECT 'classification' AS task, 'accuracy' AS metric, round((tp + tn) / (tp + tn + fp + fn), 6) AS value FROM pr1 "
       "UNION ALL SELECT 'classification', 'precision', round(p, 6) FROM pr1 "
       "UNION ALL SELECT 'classification', 'recall', round(r, 6) FROM pr1 "
       "UNION ALL SELECT 'classification', 'f1_score', round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) FROM pr1 "
       "UNION ALL SELECT 'classification', 'roc_auc', round(v, 6) FROM auc "
       "UNION ALL SELECT 'regression', 'mae', round(mae, 6) FROM rg "
       "UNION ALL SELECT 'regression', 'rmse', round(rmse, 6) FROM rg "
       "UNION ALL SELECT 'regression', 'r2', round(r2, 6) FROM rg", extra=S6_CTES))
def s6_metrics_table(spark, d):
    """Metrics as a long (task, metric, value) table and its API subset
    (core metrics, absent -> 0.0), for the route-rate pseudo-score."""
    s = materialize(scored_test(spark, d), "scored-test")     # read by three metric families
    cls = M.classifier_metrics(s, threshold=0.25)
    auc = M.roc_auc(s)
    reg = M.regression_metrics(s.filter(F.col("y") > C.DELAY_THRESHOLD))
    return r6(M.core_metrics(M.metrics_table({"classification": [cls, auc], "regression": reg})))


EDA_TRAFFIC = ("et AS (SELECT airport, CAST(sum(d) + sum(a) AS BIGINT) AS total_movements FROM ("
               "SELECT ORIGIN_AIRPORT AS airport, 1 AS d, 0 AS a FROM eda UNION ALL "
               "SELECT DESTINATION_AIRPORT AS airport, 0 AS d, 1 AS a FROM eda) WHERE airport IS NOT NULL GROUP BY airport)")


@query("a20_traffic_quantiles", with_(["eda"],
       "SELECT p, round(value, 6) AS value FROM (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS p, "
       "unnest(quantile_cont(total_movements, [0.5, 0.75, 0.9, 0.95, 0.99])) AS value FROM et)",
       extra=[EDA_TRAFFIC]))
def a20_traffic_quantiles(spark, d):
    """A20 + A9: quantiles (median included) of total movements per
    airport over the exploratory frame."""
    t = A.airport_traffic(eda(spark, d))
    # one row per airport code: bounded distinct values
    return r6(A.exact_quantiles(t, "total_movements", [0.5, 0.75, 0.9, 0.95, 0.99], bounded=True))


LEAKAGE_CORR = ["ARRIVAL_DELAY", "DEPARTURE_DELAY", "TAXI_OUT", "TAXI_IN", "AIR_TIME", "ELAPSED_TIME", "DISTANCE"]


@query("a11_p13_leakage_correlations", with_(["eda"],
       "SELECT 'ARRIVAL_DELAY' AS col_a, 'ARRIVAL_DELAY' AS col_b, round(corr(ARRIVAL_DELAY, ARRIVAL_DELAY), 6) AS r "
       "FROM eda UNION ALL SELECT 'DISTANCE', 'ARRIVAL_DELAY', round(corr(DISTANCE, ARRIVAL_DELAY), 6) FROM eda "
       "UNION ALL SELECT 'DISTANCE', 'DISTANCE', round(corr(DISTANCE, DISTANCE), 6) FROM eda"))
def a11_p13_leakage_correlations(spark, d):
    """A11 + P13: correlation matrix over the post-departure column list,
    restricted to the columns the frame actually has."""
    e = eda(spark, d)
    return r6(PR.correlation_matrix(e, P.existing(e, LEAKAGE_CORR)))


@query("a2_a3_w1_arr_hour_rates", with_(["eda"],
       f"SELECT ARR_HOUR, round(m, 6) AS delay_mean, round(r, 6) AS delay_rate, n, "
       f"round(avg(r) OVER (), 6) AS mean_of_groups, r > avg(r) OVER () AS above_mean FROM "
       f"(SELECT ARR_HOUR, avg(ARRIVAL_DELAY) AS m, avg({LATE}) * 100 AS r, count(*) AS n FROM eda "
       "WHERE ARR_HOUR IS NOT NULL GROUP BY ARR_HOUR)"))
def a2_a3_w1_arr_hour_rates(spark, d):
    """A2 + A3 + W1 by arrival hour: mean delay, late % and count, flagged
    against the plain mean of the hourly rates."""
    g = A.group_stats(eda(spark, d), "ARR_HOUR", pct=True)
    return r6(PR.above_group_mean(g, "delay_rate"))
