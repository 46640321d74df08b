"""Column -> Column building blocks.

All are native Spark expressions, so they stay inside whole-stage codegen.
Null rules follow the pandas pipeline being reproduced:

* ``isin`` on null is False (Spark's IN gives null)  -> ``in_set``
* binning outside the bins or on null gives null      -> ``when`` chains without ``otherwise``
* ``str + null`` is null                              -> ``concat`` (not ``concat_ws``)
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c, values: Iterable) -> Column:
    """pandas ``isin``: null -> False."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def flag(c: Column) -> Column:
    """Boolean -> 0/1 int with null as 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


# F1
def hhmm_to_hour(c) -> Column:
    """HHMM integer -> hour 0..23 (2400 folds to 0)."""
    return F.pmod(F.floor(col(c) / 100), F.lit(24)).cast("int")


# F2
def time_slot(hour) -> Column:
    """Right-closed bins (-1,5] (5,11] (11,17] (17,23]; other values -> null."""
    h = col(hour)
    expr = None
    for label, lo, hi in C.TIME_SLOTS:
        cond = (h > lo) & (h <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def time_slot_notebook(hour) -> Column:
    """Notebook form: night [0,6), morning [6,12), afternoon [12,18), else evening."""
    h = col(hour)
    return (F.when((h >= 0) & (h < 6), "night").when((h >= 6) & (h < 12), "morning")
             .when((h >= 12) & (h < 18), "afternoon").otherwise("evening"))


# F3 / F4
def is_peak_hour(hour) -> Column:
    return flag(in_set(hour, C.PEAK_HOURS))


def is_red_eye(hour, hours=C.RED_EYE_HOURS) -> Column:
    return flag(in_set(hour, hours))


# F3b
def in_range_flag(c, lo, hi) -> Column:
    """Notebook ``between`` flags (inclusive)."""
    return flag(col(c).between(lo, hi))


# F5
def is_weekend(dow) -> Column:
    return flag(in_set(dow, C.WEEKEND_DAYS))


def is_summer(month) -> Column:
    return flag(in_set(month, C.SUMMER_MONTHS))


def is_holiday_season(month) -> Column:
    return flag(in_set(month, C.HOLIDAY_MONTHS))


# F6
def cyclic_sin(c, period) -> Column:
    return F.sin(F.lit(2 * math.pi) * col(c) / F.lit(float(period)))


def cyclic_cos(c, period) -> Column:
    return F.cos(F.lit(2 * math.pi) * col(c) / F.lit(float(period)))


# F7
def route(origin="ORIGIN_AIRPORT", dest="DESTINATION_AIRPORT") -> Column:
    return F.concat(col(origin), F.lit("-"), col(dest))


# F8
def distance_class(d) -> Column:
    """Left-closed [0,500) [500,1500) [1500,inf); negative or null -> null."""
    x = col(d)
    expr = None
    for label, lo, hi in C.DISTANCE_CLASSES:
        cond = x >= lo if hi is None else (x >= lo) & (x < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def distance_class_notebook(d) -> Column:
    """Notebook lambda: no lower bound, and null falls through to long."""
    x = col(d)
    return F.when(x < 500, "short").when(x < 1500, "medium").otherwise("long")


# F9
def delay_class(y) -> Column:
    x = col(y)
    expr = None
    for label, lo, hi in C.DELAY_CLASSES:
        if lo is None:
            cond = x <= hi
        elif hi is None:
            cond = x > lo
        else:
            cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


# F10
def clip(c, lo=None, hi=None) -> Column:
    """pandas ``clip``: nulls stay null."""
    x = col(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(x.isNotNull(), out)


# F12
def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle miles, atan2 form; any null input -> null."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlat = F.radians(col(lat2) - col(lat1))
    dlon = F.radians(col(lon2) - col(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(C.EARTH_RADIUS_MILES) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


# F13
def norm_code(c) -> Column:
    return F.upper(col(c))


# F14
def airport_text(code="IATA_CODE", name="AIRPORT", city="CITY", country="COUNTRY") -> Column:
    return F.format_string("Airport %s: %s, %s, %s", col(code), col(name), col(city), col(country))


def airline_text(code="IATA_CODE", name="AIRLINE") -> Column:
    return F.format_string("Airline %s: %s", col(code), col(name))


# F15
def timestamp_parts(ts) -> list[Column]:
    t = col(ts)
    return [F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
            (F.weekday(t) + 1).alias("iso_weekday"), F.hour(t).alias("hour"),
            F.minute(t).alias("minute"), F.date_format(t, "EEEE").alias("weekday_name")]


# F16
def round_half_even(c, digits: int) -> Column:
    return F.bround(col(c), digits)


# F17
def fill(c, fallback) -> Column:
    return F.coalesce(col(c), fallback if isinstance(fallback, Column) else F.lit(fallback))


# F18
def late_label(y, threshold=C.DELAY_THRESHOLD) -> Column:
    """``y > thr`` as 0/1; null delay counts as not late (pandas NaN > x is False)."""
    return flag(col(y) > threshold)


# F19
def hour_to_hhmm(h) -> Column:
    return (col(h) * 100).cast("int")


# F20
def decide(p, threshold) -> Column:
    return col(p) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))


# F21
def second_stage(flagged, minutes) -> Column:
    return F.when(col(flagged), col(minutes)).otherwise(F.lit(0.0))


# F22
def residual(pred, truth) -> Column:
    return col(pred) - col(truth)


# F23
def hub_combo_label(origin_hub="IS_ORIGIN_HUB", dest_hub="IS_DEST_HUB") -> Column:
    part = lambda c: F.when(col(c) == 1, "Hub").otherwise("Non-Hub")
    return F.concat(part(origin_hub), F.lit("→"), part(dest_hub))


# F24
def json_field(c, path: str) -> Column:
    """``get_json_object``; malformed JSON gives null instead of an error."""
    return F.get_json_object(col(c), path)


def parse_json(c, schema: str) -> Column:
    """PERMISSIVE ``from_json``: malformed records become null fields."""
    return F.from_json(col(c), schema, {"mode": "PERMISSIVE"})


# F25
def prediction_report(origin_name, origin_code, dest_name, dest_code, airline_name, airline_code,
                      dep_hour, prob, delayed, minutes) -> Column:
    """Report text: names instead of codes when known, percent with one
    decimal (half-even), minutes line only when the rounded value is > 0."""
    def named(n, c):
        return F.when(col(n).isNotNull(), F.format_string("%s (%s)", col(n), col(c))).otherwise(col(c))
    pct = F.bround(col(prob) * 100, 1)
    mins = F.bround(col(minutes), 0).cast("bigint")
    minutes_line = F.when(mins > 0, F.format_string("Estimated delay (if delayed): %d minutes", mins)).otherwise("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Origin airport: "), named(origin_name, origin_code)),
        F.concat(F.lit("Destination airport: "), named(dest_name, dest_code)),
        F.concat(F.lit("Airline: "), F.coalesce(col(airline_name), col(airline_code))),
        F.concat(F.lit("Departure time: "), col(dep_hour).cast("string"), F.lit(":00")),
        F.concat(F.lit("Delay probability: "), pct.cast("string"), F.lit("%")),
        F.concat(F.lit("Model prediction: "), F.when(col(delayed), "delayed").otherwise("on time")),
        minutes_line,
    )


# F26
# fixed values: the three texts
REPLY_PREDICTED = "Prediction complete: delay probability %s%%."
REPLY_MISSING = "To complete the prediction, I still need: %s."
REPLY_DEFAULT = "How can I help you predict your flight delay?"


def reply_fallback(prob, missing) -> Column:
    """The last prediction (percent, one decimal, half-even) if there is one,
    whatever is missing; else the missing-field list; else a default."""
    pct = F.bround(col(prob) * 100, 1).cast("string")
    return (F.when(col(prob).isNotNull(), F.format_string(REPLY_PREDICTED, pct))
             .when(F.size(col(missing)) > 0, F.format_string(REPLY_MISSING, F.array_join(col(missing), ", ")))
             .otherwise(F.lit(REPLY_DEFAULT)))


# P12
def missing_fields(fields: list[str]) -> Column:
    """Names of the null fields, in declared order."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]),
                    lambda x: x.isNotNull())
