"""Registered queries of the message log, the CSV source, the full matrices and
the half of scoring that needs no model, each with its DuckDB text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import config as C
from ..operators import clean as P
from ..operators import encode as E
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import sessions as K
from ..session import materialize, shared_path
from ..sources import fixtures as FX
from ..sources import tables as TB
from . import catalog as CT
from .sqltext import CTE, FEATURE_CTES, featured, with_

Q: dict = {}


def query(name, sql=None):
    def deco(fn):
        Q[name] = (fn, sql)
        return fn
    return deco


# -- message log (K1, W5, P12, P14, K2, F26) ------------------------------------

#: What each turn of the log sets, as typed columns: slot -> value.
_SETS = {
    "month": "CASE turn WHEN 0 THEN i % 12 + 1 WHEN 1 THEN i % 12 + 1 END::INTEGER",
    "day_of_week": "CASE turn WHEN 0 THEN i % 7 + 1 WHEN 1 THEN 5 END::INTEGER",
    "scheduled_departure_hour": "CASE turn WHEN 1 THEN i % 24 WHEN 7 THEN 6 END::INTEGER",
    "scheduled_arrival_hour": "CASE turn WHEN 1 THEN v % 24 END::INTEGER",
    "origin_airport_code": "CASE WHEN turn IN (0, 1) THEN code END",
    "destination_airport_code": "CASE turn WHEN 1 THEN 'N01' WHEN 2 THEN code END",
    "airline_code": "CASE turn WHEN 1 THEN 'A0' || (i % 9) WHEN 7 THEN 'A07' END",
    "distance": "CASE turn WHEN 1 THEN v WHEN 6 THEN v + 0.5 WHEN 7 THEN v END::DOUBLE",
    "delay_probability": "CASE WHEN turn IN (4, 5) THEN v / 1000.0::DOUBLE END",
    "delayed": "CASE turn WHEN 4 THEN true WHEN 5 THEN false END",
    "delay_minutes": "CASE turn WHEN 4 THEN v WHEN 5 THEN 0 END::DOUBLE",
}
_MISSING = "concat_ws(', ', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in C.SLOT_FIELDS) + ")"
MESSAGE_SQL = (
    f"WITH log AS ({FX.MESSAGES_SQL}), sets AS (SELECT session_id, ts, seq, "
    + ", ".join(f"{v} AS {n}" for n, v in _SETS.items()) + " FROM log), st AS (SELECT session_id, "
    + ", ".join(f"arg_max({n}, (ts, seq)) FILTER (WHERE {n} IS NOT NULL) AS {n}" for n in _SETS)
    + f" FROM sets GROUP BY session_id), m AS (SELECT *, {_MISSING} AS missing FROM st) "
    "SELECT *, missing = '' AS complete, CASE WHEN missing <> '' THEN 'missing: ' || missing END AS reason, "
    "CASE WHEN delay_probability IS NOT NULL THEN 'Prediction complete: delay probability ' || "
    "CAST(round_even(delay_probability * 100, 1) AS VARCHAR) || '%.' "
    "WHEN missing <> '' THEN 'To complete the prediction, I still need: ' || missing || '.' "
    "ELSE 'How can I help you predict your flight delay?' END AS reply FROM m")


@query("k1_w5_k2_message_status", MESSAGE_SQL)
def k1_w5_k2_message_status(spark, d):
    """K1 + W5 + P12 + P14 + K2 + F26 from the message log: string and number
    slots by the tool rules, the last prediction with its defaults, missing
    slots, gate and reply, in one group-by."""
    s = K.status_from_messages(FX.message_log(spark, d))
    return s.select("session_id", *C.SLOT_FIELDS, "last_prediction.*", F.array_join("missing", ", ").alias("missing"),
                    "complete", "reason", "reply")


# -- CSV source with quarantine (S1) -----------------------------------------------

_BAD = {"MONTH": "flight_id % 37 = 0", "DISTANCE": "flight_id % 41 = 0", "columns": "flight_id % 43 = 0"}


@query("s1_csv_quarantine", with_(["trips"], f"""
    SELECT outcome, count(*) AS lines, sum(DISTANCE) FILTER (WHERE outcome = 'accepted') AS distance,
           CASE WHEN outcome = 'accepted' THEN count(ARRIVAL_DELAY) END AS with_delay
    FROM (SELECT *, CASE WHEN {_BAD['columns']} THEN 'columns' WHEN {_BAD['MONTH']} THEN 'MONTH' WHEN {_BAD['DISTANCE']} THEN 'DISTANCE'
          ELSE 'accepted' END AS outcome FROM trips) GROUP BY outcome"""))
def s1_csv_quarantine(spark, d):
    """The trips written as the flights CSV, some lines with a word for a
    number or with fields too many, and loaded again: accepted rows by the
    explicit schema, malformed ones set apart with their line and its reason."""
    t = CT.trips(spark, d).withColumn("id", F.col("flight_id"))
    given = {c: F.col(c).cast("string") for c in t.columns}
    for c in ("MONTH", "DISTANCE"):
        given[c] = F.when(F.expr(_BAD[c].replace("flight_id", "id")), F.lit(f"bad {c}")).otherwise(given[c])
    line = F.concat_ws(",", *[F.coalesce(given.get(f.name, F.lit("")), F.lit("")) for f in TB.FLIGHTS.fields])
    line = F.when(F.expr(_BAD["columns"].replace("flight_id", "id")), F.concat(line, F.lit(",too,many"))).otherwise(line)
    path = shared_path(spark, "flights-csv")
    header = ",".join(f.name for f in TB.FLIGHTS.fields)  # one column that holds whole lines, under the real header
    t.select(line.alias(header)).write.option("header", True).option("quote", "").option("sep", "\x01").csv(path)
    good, bad = TB.read_flights_csv(spark, path), TB.rejected_flights(spark, path)
    accepted = good.agg(F.lit("accepted").alias("outcome"), F.count("*").alias("lines"), F.sum("DISTANCE").alias("distance"),
                        F.count("ARRIVAL_DELAY").alias("with_delay"))
    return accepted.unionByName(TB.rejection_reasons(bad).groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("lines"))
                                .withColumns({"distance": F.lit(None).cast("double"), "with_delay": F.lit(None).cast("long")}))


# -- full matrices (E5, E6, U2) and the features of raw requests (E9) ---------------

#: The one-hot vocabularies of the training rows, first category left out.
_DUMMIES = {"DEP_TIME_SLOT": ("evening", "morning", "night"), "DISTANCE_CAT": ("medium", "short"), "ARR_TIME_SLOT": ("evening", "morning", "night")}


def matrix_names(features, cat_low) -> list[str]:
    return E.matrix_columns(features, cat_low, C.CAT_HIGH, {c: ["", *v] for c, v in _DUMMIES.items()})


def _matrix_sql(names) -> str:
    dummy = {f"{c}_{v}": f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS {c}_{v}" for c, vs in _DUMMIES.items() for v in vs}
    real = ("_SIN", "_COS", "_TE", "_MEAN", "_RATE_15")
    return ", ".join(dummy.get(n, f"round({n}, 6) AS {n}" if n.endswith(real) else n) for n in names)


def _both_sql(names) -> str:
    rows = lambda part, src: f"SELECT '{part}' AS part, flight_id, {_matrix_sql(names)} FROM {src}"
    return with_(["tr", "te"] + FEATURE_CTES, rows("train", "fa") + " UNION ALL " + rows("holdout", "fb"),
                 extra=[featured("tr", "fa"), featured("te", "fb")])


def _both(spark, d, matrix):
    prepared = materialize(CT.prepared(spark, d), "prepared", partition_by="MONTH")  # fit and apply read one written source
    tr, te = P.split_by_month(prepared)
    fm = E.fit_features(tr)
    part = lambda df, name: matrix(fm.transform(df), fm, keep=("flight_id",)).withColumn("part", F.lit(name))
    return CT.r6(part(tr, "train").unionByName(part(te, "holdout")))


@query("e5_full_matrix", _both_sql(matrix_names(C.FEATURES_CLS, C.CAT_LOW_CLS)))
def e5_full_matrix(spark, d):
    """E5 + U2: every column of the classification matrix, training and hold-out rows."""
    return _both(spark, d, E.classification_matrix)


@query("e6_full_matrix", _both_sql(matrix_names(C.FEATURES_REG, C.CAT_LOW_REG)))
def e6_full_matrix(spark, d):
    """Every column of the regression matrix, training and hold-out rows."""
    return _both(spark, d, E.regression_matrix)


_REQUEST_CTES = [
    "rhours AS (SELECT flight_id, \"MONTH\", DAY_OF_WEEK, ORIGIN_AIRPORT, DESTINATION_AIRPORT, AIRLINE, DISTANCE, "
    "CAST(SCHEDULED_DEPARTURE // 100 AS INTEGER) AS DEP_HOUR, CAST(SCHEDULED_ARRIVAL // 100 AS INTEGER) AS ARR_HOUR FROM trips "
    "WHERE SCHEDULED_DEPARTURE // 100 BETWEEN 0 AND 23 AND SCHEDULED_ARRIVAL // 100 BETWEEN 0 AND 23)",
    CTE["prep"].replace("prep AS", "rprep AS", 1).replace("FROM hours", "FROM rhours"),
    CTE["routed"].replace("routed AS", "rrouted AS", 1).replace("FROM prep", "FROM rprep"),
    featured("rrouted", "rf")]


@query("e9_request_features", with_(["tr"] + FEATURE_CTES, "SELECT flight_id, "
       + _matrix_sql(matrix_names(C.FEATURES_CLS, C.CAT_LOW_CLS)) + " FROM rf", extra=_REQUEST_CTES))
def e9_request_features(spark, d):
    """E9 + F19: the classification matrix of every valid raw request, by the
    statistics of the training months; no model is needed."""
    flights = CT.written_trips(spark, d)  # fit and requests read one written source
    fm = E.fit_features(P.split_by_month(CT.prepared(spark, d, flights))[0])
    feats = MD.request_features(CT.as_requests(flights)).where(F.size("errors") == 0).withColumn("flight_id", F.col("_req.flight_id"))
    # the statistics are rounded in their small tables, once a value instead of once a row
    g = CT.r6(fm.level("GLOBAL").select("delay_mean", "delay_rate")).first() or (None, None)
    fm = replace(fm, stats=CT.r6(fm.stats), airports=CT.r6(fm.airports), global_mean=g[0], global_rate=g[1])
    out = E.classification_matrix(fm.transform(feats), fm, keep=("flight_id",))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("_SIN", "_COS")) else c for c in out.columns])


@query("s5_model_status", f"""SELECT 'ok' AS status, true AS model_loaded, '1' AS version, threshold AS classification_threshold
       FROM ({CT.Q['a26_best_threshold'][1]}) UNION ALL SELECT 'model_missing', false, '', NULL""")
def s5_model_status(spark, d):
    """Status of a model folder from its metadata alone (no trees are
    read), and of a folder without a model."""
    best = M.best_f1_threshold(CT.scored_test(spark, d)).first()
    path = shared_path(spark, "status")
    MD.write_meta(spark, path, {"classification_threshold": round(float(best["threshold"]), 6), "version": "1"})
    return MD.model_status(spark, path).unionByName(MD.model_status(spark, path + "-none"))
