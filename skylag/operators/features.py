"""Row-local feature steps (E7 and the route part of E8).

Each step is a ``DataFrame -> DataFrame`` transform built from native
expressions; chaining them with ``.transform`` yields one projection, so
the whole preprocess runs in a single codegen stage after the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .clean import clean_flights


def add_time_features(df: DataFrame, dep="SCHEDULED_DEPARTURE", arr="SCHEDULED_ARRIVAL") -> DataFrame:
    """Hours, time slots, peak and red-eye flags."""
    df = df.withColumns({"DEP_HOUR": X.hhmm_to_hour(dep), "ARR_HOUR": X.hhmm_to_hour(arr)})
    return df.withColumns({
        "DEP_TIME_SLOT": X.time_slot("DEP_HOUR"),
        "ARR_TIME_SLOT": X.time_slot("ARR_HOUR"),
        "DEP_IS_PEAK_HOUR": X.is_peak_hour("DEP_HOUR"),
        "ARR_IS_PEAK_HOUR": X.is_peak_hour("ARR_HOUR"),
        "DEP_IS_RED_EYE": X.is_red_eye("DEP_HOUR"),
        "ARR_IS_RED_EYE": X.is_red_eye("ARR_HOUR"),
    })


def add_notebook_time_flags(df: DataFrame) -> DataFrame:
    """F3b / F4 notebook variants: peak ranges and the shorter red-eye set."""
    lo_d, hi_d = C.NOTEBOOK_DEP_PEAK
    lo_a, hi_a = C.NOTEBOOK_ARR_PEAK
    return df.withColumns({
        "DEP_IS_PEAK_HOUR": X.in_range_flag("DEP_HOUR", lo_d, hi_d),
        "ARR_IS_PEAK_HOUR": X.in_range_flag("ARR_HOUR", lo_a, hi_a),
        "DEP_IS_RED_EYE": X.is_red_eye("DEP_HOUR", C.NOTEBOOK_RED_EYE_HOURS),
        "ARR_IS_RED_EYE": X.is_red_eye("ARR_HOUR", C.NOTEBOOK_RED_EYE_HOURS),
    })


def add_calendar_flags(df: DataFrame) -> DataFrame:
    """F5."""
    return df.withColumns({
        "IS_WEEKEND": X.is_weekend("DAY_OF_WEEK"),
        "IS_SUMMER": X.is_summer("MONTH"),
        "IS_HOLIDAY_SEASON": X.is_holiday_season("MONTH"),
    })


def add_cyclic_features(df: DataFrame, specs=C.CYCLIC) -> DataFrame:
    """F6."""
    out = {}
    for src, period, prefix in specs:
        out[f"{prefix}_SIN"] = X.cyclic_sin(src, period)
        out[f"{prefix}_COS"] = X.cyclic_cos(src, period)
    return df.withColumns(out)


def add_route_features(df: DataFrame) -> DataFrame:
    """F7, F8."""
    return df.withColumns({"ROUTE": X.route(), "DISTANCE_CAT": X.distance_class("DISTANCE")})


def preprocess_flights(df: DataFrame) -> DataFrame:
    """Clean -> time -> calendar -> cyclic."""
    return (clean_flights(df).transform(add_time_features)
            .transform(add_calendar_flags).transform(add_cyclic_features))


def with_route_and_hours(df: DataFrame) -> DataFrame:
    """Exploratory frame helpers: hours and route on any flights frame."""
    return df.withColumns({"DEP_HOUR": X.hhmm_to_hour("SCHEDULED_DEPARTURE"),
                           "ARR_HOUR": X.hhmm_to_hour("SCHEDULED_ARRIVAL"),
                           "ROUTE": X.route()})
