"""Corrections: slots and predictions from messages, search roles, quantiles."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylag.functions import exprs as X
from skylag.operators import search as S
from skylag.operators import sessions as K
from skylag.operators import stats as A
from skylag.sources import tables as TB

FIELDS = {"origin_airport_code": "STRING", "destination_airport_code": "STRING", "airline_code": "STRING", "month": "INT",
          "distance": "DOUBLE"}


def messages(spark, rows):
    out = [(s, i, i, kind, tool, body if isinstance(body, str) or body is None else json.dumps(body))
           for i, (s, kind, tool, body) in enumerate(rows)]
    return spark.createDataFrame(out, "session_id int, ts int, seq int, kind string, tool string, body string")


def test_slots_and_prediction_from_messages(spark):
    log = messages(spark, [
        (1, "call", "update_flight_slots", {"origin_airport_code": "JFK", "month": 3}),
        (1, "call", "update_flight_slots", {"origin_airport_code": None, "airline_code": "AA"}),
        (1, "call", "search_airports", {"origin_airport_code": "XXX"}),
        (1, "call", "calculate_distance", {"origin_airport_code": "", "destination_airport_code": "LAX", "month": 9}),
        (1, "result", None, {"distance_miles": 2475.5, "updated_slots": {"month": 4, "other": 1}}),
        (1, "result", None, {"delay_probability": 0.345}),
        (1, "result", None, "{broken"), (1, "result", None, None),
        (2, "call", "call_predict_api", {"distance": 10}),
        (2, "result", None, {"delay_probability": 0.5, "delayed": True, "delay_minutes": 12.5}),
        (2, "result", None, {"distance_miles": 7, "updated_slots": {"distance": 8}, "delay_probability": None}),
        (3, "result", None, {"note": "nothing"})])
    got = {r.session_id: r for r in K.state_from_messages(log, FIELDS).collect()}
    assert tuple(got[1][f] for f in FIELDS) == ("JFK", "LAX", "AA", 4, 2475.5)
    assert tuple(got[1].last_prediction) == (0.345, False, 0.0)
    assert got[2].distance == 8 and tuple(got[2].last_prediction) == (0.5, True, 12.5)
    assert got[3].last_prediction is None and got[3].month is None


def test_string_slots_of_tool_calls(spark):
    calls = spark.createDataFrame([(1, 1, 1, '{"code": "JFK", "n": 2}')], "session_id int, ts int, seq int, args string")
    assert K.slot_state_from_calls(calls, {"code": "STRING", "n": "INT"}).first()[1:] == ("JFK", 2)


def test_prediction_is_told_whatever_is_missing(spark):
    df = spark.createDataFrame([(0.345, ["b"]), (None, ["b", "c"]), (None, [])], "p double, m array<string>")
    assert [r[0] for r in df.select(X.reply_fallback("p", "m")).collect()] == [
        "Prediction complete: delay probability 34.5%.", "To complete the prediction, I still need: b, c.",
        "How can I help you predict your flight delay?"]


def test_airport_text(spark):
    ap = spark.createDataFrame([("JFK", "Kennedy", "New York", "NY", "USA")], "IATA_CODE string, AIRPORT string, CITY string, STATE string, COUNTRY string")
    al = spark.createDataFrame([("AA", "American")], "IATA_CODE string, AIRLINE string")
    rows = {r.doc_id: r for r in S.entity_documents(ap, al).collect()}
    assert rows["airport:JFK"].text == "Airport JFK: Kennedy, New York, USA"
    assert set(rows["airport:JFK"].metadata.asDict()) == {"type", "code", "name", "city", "country"}


def test_a_task_returns_its_best_once(spark):
    import pyarrow as pa
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((100, 4)), 1)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 10)), pa.array(x[a:a + 10].tolist(), pa.list_(pa.float64()))], ["id", "v"])
               for a in range(0, 100, 10)]

    class Shared:
        value = (np.array([7]), x[:1])
    out = list(S._local_topk(Shared, 5, "l2", "id", "v")(iter(batches)))
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    assert len(out) == 1 and sorted(out[0].column(1).to_pylist()) == sorted(np.lexsort((np.arange(100), d))[:5].tolist())


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_null_names_and_both_search_forms(spark, monkeypatch, limit):
    monkeypatch.setattr(S.nearest_entities, "__defaults__", (*S.nearest_entities.__defaults__[:-1], limit))
    ents = spark.createDataFrame([(1, "JFK", "john f kennedy"), (2, "LAX", "los angeles")], "entity_id int, code string, entity_name string")
    names = spark.createDataFrame([(1, "lax"), (2, "Los Angels"), (3, None), (4, "")], "name_id int, name string")
    out = {r.name_id: r for r in S.resolve_names(names, ents, k=2).collect()}
    assert (out[1].code, out[1].match) == ("LAX", "exact") and (out[2].code, out[2].match) == ("LAX", "similarity")
    assert out[3].code is None and out[3].match is None and out[3].candidates is None and out[4].match == "similarity"


def test_quantiles_leave_out_null_groups_in_both_paths(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in range(5)], "g string, v double")
    want = [("a", 2.0)]
    rows = lambda **k: [(r.g, r.value) for r in A.exact_quantiles(df, "v", [0.5], by=["g"], **k).collect()]
    assert rows() == rows(bounded=True) == want
    monkeypatch.setattr(A, "BOUNDED_VALUES", 2)
    assert rows(bounded=True) == want


def test_running_sums_with_nan_and_infinities_at_any_width(spark):
    vals = [float("-inf"), *[i / 7 for i in range(900)], float("inf"), float("nan")]
    df = spark.createDataFrame([(v, 1) for v in vals], "v double, n long")
    for buckets in (4, 300, 700):
        rows = A.prefix_sums(df, "v", ["n"], buckets=buckets).collect()
        by = {("nan" if math.isnan(r.v) else r.v): r.cum_n for r in rows}
        assert [by["nan" if math.isnan(v) else v] for v in vals] == list(range(1, len(vals) + 1))


def test_malformed_csv_rows_are_set_apart(spark, tmp_path):
    names = [f.name for f in TB.FLIGHTS.fields]
    good = ["1" if f.dataType.typeName() in ("integer", "long", "double") else "x" for f in TB.FLIGHTS.fields]
    at = next(i for i, f in enumerate(TB.FLIGHTS.fields) if f.dataType.typeName() in ("integer", "long"))
    bad = [*good[:at], "oops", *good[at + 1:]]
    path = tmp_path / "flights.csv"
    path.write_text("\n".join(",".join(r) for r in (names, good, bad, good)) + "\n")
    assert TB.read_flights_csv(spark, str(path)).count() == 2
    assert TB.read_flights_csv(spark, str(path)).columns == names
    rows = TB.rejected_flights(spark, str(path)).collect()
    assert len(rows) == 1 and "oops" in rows[0]["_corrupt_record"]


def test_wide_lookups_are_not_broadcast(spark):
    from skylag.operators import lookups as L
    df = spark.range(10).select("id", F.array("id").alias("a"))
    assert L.row_width(df) == 16 + 8 + 256
    assert "broadcast" in L.sized(df, 1000)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in L.sized(df, 1_500_000)._jdf.queryExecution().toString().lower()


def test_parquet_nan_becomes_null(spark, tmp_path):
    full = spark.createDataFrame([(1, float("nan"))], "event_id long, value double")
    schema = TB.TABLE_SCHEMAS["events"]
    cols = [F.col(f.name).cast(f.dataType) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    full.select(*cols).write.parquet(str(tmp_path / "events.parquet"))
    r = TB.read_table(spark, str(tmp_path), "events").select("value").first()
    assert r.value is None


def test_each_algorithm_has_its_own_candidates():
    from skylag.operators import model as MD
    grid = {"maxDepth": [3, 5], "maxIter": [5, 10], "stepSize": [0.1, 0.2]}
    got = MD.candidates(grid, ("GBT", "RandomForest", "LogisticRegression"))
    assert [sum(a == n for a, _ in got) for n in ("GBT", "RandomForest", "LogisticRegression")] == [8, 4, 2]
    assert len({(a, str(sorted(p.items()))) for a, p in got}) == 14


def test_refit_is_scored_at_the_tuned_threshold(spark):
    from skylag.operators import clean as P
    from skylag.operators import encode as E
    from skylag.operators import features as FE
    from skylag.operators import model as MD
    from skylag.sources import fixtures as FX
    tr, te = P.split_by_month(FE.add_route_features(FE.preprocess_flights(FX.trips(spark, "/root/testdata/sf0.001"))))
    fm = E.fit_features(tr)
    rank = spark.createDataFrame([("LogisticRegression", '{"maxIter": 5}', 0.3, 1), ("GBT", "{}", 0.2, 2)],
                                 "algorithm string, params string, cv_score double, rank int")
    rows = {r["rank"]: r for r in MD.refit_best(tr, te, fm, "classification", rank).collect()}
    best = rows[1]
    assert 0 <= best.holdout_auc <= 1 and 0 < best.holdout_threshold < 1
    p, r = best.holdout_precision, best.holdout_recall
    assert best.holdout_score == pytest.approx(2 * p * r / (p + r) if p + r else 0) and rows[2].holdout_score is None
