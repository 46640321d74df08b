"""Fit/apply discipline, persistence, one-hot vocabulary, sessions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylag.operators import clean as P
from skylag.operators import encode as E
from skylag.operators import features as FE
from skylag.operators import sessions as K
from skylag.session import shared_path
from skylag.sources import fixtures as FX

SF001 = "/root/testdata/sf0.001"


def _prepared(spark):
    return FE.add_route_features(FE.preprocess_flights(FX.trips(spark, SF001)))


def test_unseen_and_null_keys_fall_back(spark):
    tr, _ = P.split_by_month(_prepared(spark))
    fm = E.fit_features(tr)
    probe = spark.createDataFrame(pd.DataFrame({
        "ORIGIN_AIRPORT": ["ZZZ", None], "DESTINATION_AIRPORT": ["YYY", "N01"], "AIRLINE": ["QQ", None],
        "DEP_HOUR": [99, None], "DISTANCE": [100.0, None]}))
    out = fm.transform(probe).collect()
    for r in out:
        assert r["ROUTE_DELAY_MEAN"] == pytest.approx(fm.global_mean)
        assert r["AIRLINE_DELAY_RATE_15"] == pytest.approx(fm.global_rate)
        assert r["HOUR_DELAY_MEAN"] == pytest.approx(fm.global_mean)
        assert r["IS_ORIGIN_HUB"] == 0


def test_stats_use_train_rows_only(spark):
    p = _prepared(spark)
    tr, _ = P.split_by_month(p)
    a = E.fit_features(tr)
    # change every hold-out delay; the fitted statistics must not move
    p2 = p.withColumn("ARRIVAL_DELAY", F.when(F.col("MONTH") >= 11, F.col("ARRIVAL_DELAY") + 1000)
                      .otherwise(F.col("ARRIVAL_DELAY")))
    tr2, _ = P.split_by_month(p2)
    b = E.fit_features(tr2)
    assert a.global_mean == b.global_mean
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, a.stats.collect()), key=key) == sorted(map(tuple, b.stats.collect()), key=key)


def test_roundtrip_keeps_typed_hour_keys(spark):
    """A reloaded hour table still matches int hours."""
    tr, te = P.split_by_month(_prepared(spark))
    fm = E.fit_features(tr)
    path = shared_path(spark, "fm-test")
    fm.save(path)
    fm2 = E.FeatureModel.load(spark, path)
    key = lambda r: tuple(str(x) for x in r)  # noqa: E731  (flight_id is not unique)
    a = sorted(fm.transform(te).select("flight_id", "DEP_HOUR", "HOUR_DELAY_MEAN").collect(), key=key)
    b = sorted(fm2.transform(te).select("flight_id", "DEP_HOUR", "HOUR_DELAY_MEAN").collect(), key=key)
    assert a == b
    assert fm2.stats.schema["DEP_HOUR"].dataType.typeName() == "integer"


def test_one_hot_uses_train_vocabulary(spark):
    """A test split without the train baseline category keeps the
    train columns."""
    tr = spark.createDataFrame(pd.DataFrame({"S": ["afternoon", "evening", "night"]}))
    te = spark.createDataFrame(pd.DataFrame({"S": ["night", "night", None]}))
    vocab = E.one_hot_vocab(tr, ["S"])
    out = E.one_hot(te, vocab).collect()
    assert vocab["S"] == ["afternoon", "evening", "night"]
    assert [(r["S_evening"], r["S_night"]) for r in out] == [(0, 1), (0, 1), (0, 0)]


def test_slot_state_latest_non_null(spark):
    from datetime import datetime
    rows = [(1, datetime(2024, 1, 1, 1), 1, "a", 1.0), (1, datetime(2024, 1, 1, 2), 2, "a", 2.0),
            (1, datetime(2024, 1, 1, 3), 3, "a", None), (2, datetime(2024, 1, 1, 1), 4, "b", 5.0)]
    log = spark.createDataFrame(rows, "session_id int, ts timestamp_ntz, seq long, slot string, value double")
    st = {r["session_id"]: (r["a"], r["b"]) for r in K.slot_state(log, ["a", "b"]).collect()}
    assert st == {1: (2.0, None), 2: (None, 5.0)}


def test_keep_last_cuts_history(spark):
    from skylag.sources.tables import read_table
    c = read_table(spark, SF001, "conversations")
    kept = K.keep_last(c, n=3).toPandas()
    full = c.toPandas()
    exp = full.sort_values("turn", ascending=False).groupby("conv_id").head(3)
    assert len(kept) == len(exp)
    assert kept.groupby("conv_id")["turn"].min().to_dict() == exp.groupby("conv_id")["turn"].min().to_dict()


def test_validation_reasons(spark):
    df = spark.createDataFrame([(13, 1, 25, 3, "A", "B", "X", -1.0), (1, 1, 5, 3, "A", "", "X", 10.0)],
                               "month int, day_of_week int, scheduled_departure_hour int, scheduled_arrival_hour int, "
                               "origin_airport_code string, destination_airport_code string, airline_code string, "
                               "distance double")
    good, bad = P.split_valid(df)
    assert good.count() == 0
    errs = sorted(len(r["errors"]) for r in bad.collect())
    assert errs == [1, 3]


def test_empty_train_gives_missing_globals(spark):
    """FIXTURES §5.3: an empty training split fits nothing; lookups give
    null (pandas: NaN), not a made-up 0."""
    tr, te = P.split_by_month(_prepared(spark))
    fm = E.fit_features(tr.filter("false"))
    assert fm.global_mean is None and fm.global_rate is None
    r = fm.transform(te).select("ROUTE_DELAY_MEAN", "HOUR_DELAY_RATE_15", "IS_ORIGIN_HUB").first()
    assert r["ROUTE_DELAY_MEAN"] is None and r["HOUR_DELAY_RATE_15"] is None and r["IS_ORIGIN_HUB"] == 0


def test_all_null_keys_and_top_k_ties(spark):
    from skylag.operators import profile as PR
    from skylag.operators import stats as A
    df = spark.createDataFrame([(None, 10.0), (None, 20.0)], "ROUTE string, ARRIVAL_DELAY double")
    assert A.group_stats(df, "ROUTE").count() == 0
    ties = spark.createDataFrame([("B-C",), ("A-B",), ("C-D",), ("A-B",), ("B-C",)], "ROUTE string")
    assert [r["ROUTE"] for r in PR.top_routes(ties, n=2).collect()] == ["A-B", "B-C"]


def test_profile_job_writes_every_table(spark):
    from jobs.eda_tables import run
    out = shared_path(spark, "profile-job")
    names = run(spark, FX.trips(spark, SF001), out)
    assert len(names) == 21
    assert spark.read.parquet(f"{out}/row_funnel").first()["rows_raw"] == FX.trips(spark, SF001).count()
    assert spark.read.parquet(f"{out}/by_dep_hour").count() == 24


def test_slot_state_from_tool_calls(spark):
    from datetime import datetime
    rows = [(1, datetime(2024, 1, 1, 1), 1, '{"month": 12, "distance": 199.2}'),
            (1, datetime(2024, 1, 1, 2), 2, '{"month": null, "day_of_week": 5}'),     # null never overwrites
            (1, datetime(2024, 1, 1, 3), 3, "not json"),                              # ignored
            (1, datetime(2024, 1, 1, 4), 4, '{"distance": 250.0}'),
            (2, datetime(2024, 1, 1, 1), 5, '{"month": 3}')]
    calls = spark.createDataFrame(rows, "session_id int, ts timestamp_ntz, seq long, args string")
    out = {r["session_id"]: r.asDict() for r in K.slot_state_from_calls(
        calls, ["month", "day_of_week", "distance"]).collect()}
    assert (out[1]["month"], out[1]["day_of_week"], out[1]["distance"]) == (12.0, 5.0, 250.0)
    assert (out[2]["month"], out[2]["day_of_week"], out[2]["distance"]) == (3.0, None, None)


def test_matrix_column_order():
    from skylag import config as C
    vocab = {"DEP_TIME_SLOT": ["afternoon", "evening", "morning", "night"], "DISTANCE_CAT": ["long", "medium", "short"],
             "ARR_TIME_SLOT": ["afternoon", "evening", "morning", "night"]}
    cols = E.matrix_columns(C.FEATURES_CLS, C.CAT_LOW_CLS, C.CAT_HIGH, vocab)
    assert cols == [
        "MONTH_SIN", "MONTH_COS", "DAY_SIN", "DAY_COS", "DEP_HOUR_SIN", "DEP_HOUR_COS", "ARR_HOUR_SIN", "ARR_HOUR_COS",
        "IS_WEEKEND", "IS_SUMMER", "IS_HOLIDAY_SEASON", "DEP_IS_PEAK_HOUR", "DEP_IS_RED_EYE", "ARR_IS_PEAK_HOUR",
        "ARR_IS_RED_EYE", "IS_ORIGIN_HUB", "IS_DEST_HUB", "ROUTE_DELAY_RATE_15", "AIRLINE_DELAY_RATE_15",
        "HOUR_DELAY_RATE_15", "DEP_TIME_SLOT_evening", "DEP_TIME_SLOT_morning", "DEP_TIME_SLOT_night",
        "DISTANCE_CAT_medium", "DISTANCE_CAT_short", "ARR_TIME_SLOT_evening", "ARR_TIME_SLOT_morning",
        "ARR_TIME_SLOT_night", "ROUTE_TE", "ORIGIN_AIRPORT_TE", "DESTINATION_AIRPORT_TE", "AIRLINE_TE"]
    reg = E.matrix_columns(C.FEATURES_REG, C.CAT_LOW_REG, C.CAT_HIGH, vocab)
    assert reg[-4:] == ["ROUTE_TE", "ORIGIN_AIRPORT_TE", "DESTINATION_AIRPORT_TE", "AIRLINE_TE"] and len(reg) == 21


def test_add_missing_columns_keeps_others(spark):
    df = spark.createDataFrame([(1, 2.0)], "flight_id int, A double")
    out = P.add_missing_columns(df, ["A", "B_evening"]).first()
    assert out["flight_id"] == 1 and out["A"] == 2.0 and out["B_evening"] == 0


def test_feature_estimator_in_pipeline(spark):
    from pyspark.ml import Pipeline
    tr, te = P.split_by_month(_prepared(spark))
    pm = Pipeline(stages=[E.DelayFeatureEstimator()]).fit(tr)
    path = shared_path(spark, "feature-est")
    pm.stages[0].write().overwrite().save(path)
    cols = ["flight_id", "ROUTE_DELAY_MEAN", "HOUR_DELAY_RATE_15", "IS_ORIGIN_HUB", "DESTINATION_AIRPORT_TE"]
    key = lambda r: tuple(str(x) for x in r)
    a = sorted(pm.transform(te).select(*cols).collect(), key=key)
    b = sorted(E.DelayFeatureModel.load(path).transform(te).select(*cols).collect(), key=key)
    assert a == b and len(a) == te.count()


def test_scratch_scope_removes_intermediates(spark):
    from skylag.session import materialize, scratch_scope
    from skylag.sources.tables import path_exists
    with scratch_scope(spark, "t") as root:
        m = materialize(spark.range(10), "x")
        assert m.count() == 10 and path_exists(spark, root)
    assert not path_exists(spark, root)
    assert spark.conf.get("skylag.scratch.root", None) is None


def test_intermediates_live_under_the_checkpoint_dir(spark):
    from skylag.session import ensure_checkpoint_dir, shared_path
    base = ensure_checkpoint_dir(spark).rstrip("/")
    assert shared_path(spark, "x").startswith(base + "/skylag/")
    assert spark.conf.get("spark.checkpoint.dir") == base or spark.sparkContext.getCheckpointDir()
